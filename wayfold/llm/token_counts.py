"""Token counts kept by signed deltas: additive totals by source, language and tokenizer version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, worker_state
from .packing import word_encoder

KEYS = ["source", "lang", "tokenizer"]
DDL = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch string"


#: Tokenizer versions: a name, the vocabulary file, and the library that reads it.
TOKENIZERS = {"word_bpe_49k@1": ("word_bpe_49k.json", "words"), "byte_bpe_50k@1": ("byte_bpe_50k.tiktoken", "ranks")}


def token_counter(file: str, kind: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of whole texts under one public vocabulary; special tokens in a text are ordinary text."""
    if kind == "words":
        encode = word_encoder(vocabulary_path(file))
        return lambda texts: [len(ids) // 4 for ids in encode(texts)]
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(file), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    ordinary = tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(ordinary.encode_ordinary(t)) for t in texts]


def vocabulary_path(file: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(file)


def with_counts(docs: DataFrame, keep: dict[str, Column], texts: dict[str, Column]) -> DataFrame:
    """``keep`` and, for every named text and tokenizer version, the column ``version/name`` (or ``version`` for the name ""): the number of
    tokens of the whole text. A null text has none; a text that repeats the row's first one is not read again."""
    rows = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(keep.values())), *(c.alias(f"t{i}") for i, c in enumerate(texts.values())))
    names = [f"{v}/{n}" if n else v for n in texts for v in TOKENIZERS]
    fields = [(name, rows.schema[i].dataType.simpleString()) for i, name in enumerate(keep)] + [(n, "bigint") for n in names]
    held = len(keep)

    def make():
        counters = worker_state("token counters", lambda: [token_counter(*spec) for spec in TOKENIZERS.values()])

        def fn(*columns):
            first, *others = columns[held:]
            counts = [[*counter([t or "" for t in first])] for counter in counters]
            out = [*columns[:held], *counts]
            for texts in others:
                new = [i for i, (t, f) in enumerate(zip(texts, first, strict=True)) if t is not None and t != f]
                for known, counter in zip(counts, counters, strict=True):
                    mine = [0 if t is None else n for t, n in zip(texts, known, strict=True)]
                    for i, n in zip(new, counter([texts[i] for i in new]), strict=True):
                        mine[i] = n
                    out.append(mine)
            return out

        return fn

    return map_columns(rows, ", ".join(f"`{n}` {t}" for n, t in fields), make, owner="token counters")


def inserted(rows: DataFrame, tokenizer: str, tokens: str | Column, *, sign: int = 1) -> DataFrame:
    """Signed counts of documents with their ``tokens``: ``sign`` 1 inserts them, -1 deletes them."""
    n = F.col(f"`{tokens}`") if isinstance(tokens, str) else tokens
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), (n * sign).cast("long").alias("n_tokens"))


def revised(rows: DataFrame, tokenizer: str, *, old: str, new: str) -> DataFrame:
    """Signed counts of documents whose text changed: the old count leaves, the new one enters, the number stays."""
    change = F.col(f"`{new}`") - F.col(f"`{old}`")
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("n_docs"), change.cast("long").alias("n_tokens"))


class TokenLedger:
    """Totals that change by committed batches of signed counts.

    A batch is pre-aggregated (partial sums before the shuffle, so a source with a third of all rows is one row per task), written
    under its own id, and counted only once its commit file exists. The file is created once and never replaced: committing an id again
    does nothing, and a batch whose job died before its commit is overwritten by the next try. Totals are the sums over
    committed batches; ``compact`` folds them into one without changing them. Null source or language is a group of its own;
    null and empty texts count zero tokens; an empty batch commits and changes nothing; repeated rows count each; groups
    that fall to nothing are left out of the totals.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _exists(self, path: str) -> bool:
        fs, jpath = self._fs(path)
        return fs.exists(jpath)

    def _mark(self, name: str, text: str = "") -> None:
        fs, jpath = self._fs(f"{self.path}/commits/{name}")
        out = fs.create(jpath, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _state(self) -> tuple[int, dict, list[str]]:
        """The highest fold number, the latest whole fold (each fold stands for itself, so one is enough), and committed
        batches that it doesn't hold."""
        fs, jpath = self._fs(f"{self.path}/commits")
        names = sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []
        folds = [n for n in names if n.startswith("fold-")]
        latest = {"names": [], "batches": [], "data": None}
        for name in reversed(folds):
            ffs, fpath = self._fs(f"{self.path}/commits/{name}")
            stream = ffs.open(fpath)
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            if text.endswith("\n"):  # else its writer died
                latest = json.loads(text)
                break
        covered = set(latest["batches"])
        return int(folds[-1][5:]) if folds else 0, latest, [n for n in names if not n.startswith("fold-") and n not in covered]

    def batches(self) -> list[str]:
        """What the totals read: the latest fold's table and the batches committed since."""
        _, latest, since = self._state()
        return [*([latest["data"]] if latest["data"] else []), *since]

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of ``source, lang, tokenizer, n_docs, n_tokens`` rows; False when it was committed before."""
        if "/" in batch or "\n" in batch or batch.startswith("fold-"):
            raise ValueError("a batch id is a plain name")
        if self._exists(f"{self.path}/commits/{batch}"):
            return False
        totals = signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        totals.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        self._mark(batch)
        return True

    def _sum(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], DDL).drop("batch")
        read = self.spark.read.schema(DDL).parquet(*(f"{self.path}/deltas/{n}" for n in names))
        return read.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        return self._sum(self.batches()).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, name: str) -> bool:
        """Fold all batches committed so far into one table; their ids stay known, so they still can't be committed twice. A ``name``
        that a fold already has does nothing. A fold holds the totals of all its batches, so of two made at once the higher counts."""
        number, latest, since = self._state()
        if name in latest["names"]:
            return False
        data = f"fold-{uuid.uuid4().hex}"
        self._sum([*([latest["data"]] if latest["data"] else []), *since]).withColumn("batch", F.lit(data)).write.parquet(f"{self.path}/deltas/{data}")
        text = json.dumps({"names": [*latest["names"], name], "batches": [*latest["batches"], *since], "data": data}) + "\n"
        while True:
            number += 1
            if not self._exists(f"{self.path}/commits/fold-{number:08d}"):
                self._mark(f"fold-{number:08d}", text)
                return True
