"""Language identification: known words by per-language log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_columns


_RUNS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case. The pattern's runs may hold numerals that are neither letters nor digits (fractions, raised and
    circled digits, letter numbers): those part words as well."""
    found = _RUNS(text.lower())
    if found and not "".join(found).isalpha():
        found = [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split(" ")) if w]
    return found


class WordFirstModel:
    """Log frequencies per language: one vector per known word, and per n-gram of 1 to ``order`` characters (with word ends)."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray], prior: np.ndarray, order: int):
        self.langs, self.words, self.grams, self.prior, self.order = langs, words, grams, prior, order

    def places(self, word: str) -> list[str]:
        """The longest known n-gram at each place of the word with its end marks; places without any are left out."""
        marked, grams = f"^{word}$", self.grams
        out = []
        for at in range(len(marked)):
            for k in range(self.order, 0, -1):
                gram = marked[at : at + k]
                if gram in grams:
                    out.append(gram)
                    break
        return out

    def back_off(self, word: str) -> np.ndarray:
        """Mean over the word's places of the vector of the longest n-gram known there."""
        found = [self.grams[g] for g in self.places(word)]
        return np.mean(found, axis=0) if found else np.zeros(len(self.langs))


def fit_counts(counts: dict[str, Counter], order: int = 4, least: int = 3) -> WordFirstModel:
    """A model from word counts per language. Words and n-grams seen fewer than ``least`` times in all languages stay unseen."""
    langs = sorted(counts)
    total_words = Counter()
    for c in counts.values():
        total_words.update(c)

    def vectors(tables: list[Counter], wanted: list[str]) -> dict[str, np.ndarray]:
        sums = [sum(t.values()) for t in tables]
        raw = np.array([[t[w] for w in wanted] for t in tables], dtype=float).reshape(len(tables), len(wanted))
        probs = (raw + 0.5) / (np.array(sums)[:, None] + 0.5 * max(1, len(wanted)))
        logs = np.log(probs)
        return dict(zip(wanted, (logs - logs.mean(axis=0)).T, strict=True))

    words = vectors([counts[g] for g in langs], sorted(w for w, c in total_words.items() if c >= least))
    grams: dict[str, np.ndarray] = {}
    for k in range(1, order + 1):
        tables = []
        for g in langs:
            t: Counter = Counter()
            for w, c in counts[g].items():
                marked = f"^{w}$"
                for i in range(len(marked) - k + 1):
                    t[marked[i : i + k]] += c
            tables.append(t)
        every = Counter()
        for t in tables:
            every.update(t)
        grams |= vectors(tables, sorted(x for x, c in every.items() if c >= least))
    docs = np.ones(len(langs))
    return WordFirstModel(langs, words, grams, np.log(docs / docs.sum()) if langs else docs, order)


def spread_words(words: list[str], k: int) -> list[str]:
    """All words, or where there are more than ``k`` those at ``k`` evenly spaced places of the whole list."""
    return words if len(words) <= k else [words[i * len(words) // k] for i in range(k)]


def learn_languages(docs: DataFrame, *, sample_rows: int = 1500, sample_words: int = 400, order: int = 4, seed: int = 9) -> WordFirstModel:
    """Fit on a bounded sample: of each language at most ``sample_rows`` training documents (crc32 of the id mod 3 is not 1, text
    and lang not null) in hash order, and of each at most ``sample_words`` words from evenly spaced places. Counts are summed
    per language before they come to the driver, so the model is bounded by the two parameters and the number of languages."""
    from pyspark.sql import Window

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(crc_mod("doc_id", 3) != 1)
    # hash slices of 1/64 are added until a language has enough rows: only ids are ranked, by a bounded top list per language
    keys = rows.select("doc_id", "lang", F.xxhash64(F.lit(seed), "doc_id").alias("r"))
    slices = keys.withColumn("slice", F.pmod("r", F.lit(4096))).groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = slices.withColumn("before", before).where(F.col("before") < sample_rows).select("lang", "slice", F.when(F.col("before") + F.col("n") > sample_rows, F.lit(sample_rows) - F.col("before")).otherwise(F.col("n")).alias("room"))
    near = rows.withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(4096))).join(F.broadcast(wanted), ["lang", "slice"])
    rank = F.row_number().over(Window.partitionBy("lang", "slice").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id"))
    ids = near.select("doc_id", "lang", "slice", "room").withColumn("k", rank).where("k <= room").select("doc_id", "lang").distinct()
    sample = rows.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")

    def make():
        counts: dict[str, Counter] = {}

        def fn(langs, texts):
            for g, t in zip(langs, texts, strict=True):
                counts.setdefault(g, Counter()).update(spread_words(words_of(t), sample_words))
            return [], [], []

        def finish():
            flat = [(g, w, n) for g, c in counts.items() for w, n in c.items()]
            return [list(c) for c in zip(*flat, strict=True)] if flat else []

        fn.finish = finish
        return fn

    tallies = map_columns(sample, "lang string, word string, n long", make).groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    return fit_counts({g: Counter(dict(zip(t["word"], t["n"].astype(int), strict=True))) for g, t in tallies.groupby("lang")}, order)


class LanguageScorer:
    def __init__(self, model: WordFirstModel, cache_size: int = 300_000):
        self.model, self.cache_size = model, cache_size
        self.index: dict[str, int] = {}
        self.gram_at = {g: i for i, g in enumerate(model.grams)}
        self.gram_table = np.array(list(model.grams.values()), np.float32).reshape(len(model.grams), len(model.langs))
        self._reset()

    def _reset(self) -> None:
        self.index = {w: i for i, w in enumerate(self.model.words)}
        self.table = np.zeros((len(self.index) + self.cache_size + 1, len(self.model.langs)), np.float32)
        if self.index:
            self.table[: len(self.index)] = np.array(list(self.model.words.values()))
        self.room = len(self.table)

    def _learn(self, words: list[str]) -> None:
        """Vectors of unseen words by back-off, all at once."""
        places = [[self.gram_at[g] for g in self.model.places(w)] for w in words]
        sizes = np.array([len(p) for p in places])
        rows = self.gram_table[[i for p in places for i in p]]
        at = len(self.index)
        some = np.flatnonzero(sizes)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            self.table[at + some] = np.add.reduceat(rows, starts, axis=0) / sizes[some, None]
        self.table[at + np.flatnonzero(sizes == 0)] = 0
        self.index.update(zip(words, range(at, at + len(words)), strict=True))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share of the posterior over mean word scores, sharpened by up to 20 words."""
        found = words_of(text) if text else []
        if not found or not self.model.langs:
            return "und", 0.0
        total, n = np.zeros(len(self.model.langs)), len(found)
        for at in range(0, n, 1 << 16):
            part = found[at : at + (1 << 16)]
            fresh = [w for w in set(part) if w not in self.index]
            if fresh:
                if len(self.index) + len(fresh) > self.room:
                    self._reset()
                    fresh = [w for w in set(part) if w not in self.index]
                self._learn(fresh)
            total += self.table[list(map(self.index.__getitem__, part))].sum(axis=0, dtype=np.float64)
        logits = self.model.prior + total / n * min(n, 20)
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(np.argmax(p))
        return self.model.langs[best], float(p[best])


def identify_languages(docs: DataFrame, model: WordFirstModel, *, text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row from its whole text alone.

    ``und`` with score 0 where the text is null, empty or has no letter (or nothing was learned). Ties fall to the language
    first in order. Repeated rows are scored alike, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = LanguageScorer(shared.value)

        def fn(ids, held, texts):
            found = [scorer.predict(t) for t in texts]
            return ids, held, [f[0] for f in found], [f[1] for f in found]

        return fn

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", 3) == 1).alias("held_out"), text_col)
    return map_columns(rows, "doc_id long, held_out boolean, lang_pred string, score double", make)


