"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, releasing, worker_state

WINDOW = 2048
SEPARATOR = (1).to_bytes(4, "little")
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Lower-case letters, then ASCII punctuation but the apostrophe (which joins the letters after it).
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def _lower(text: str) -> str:
    """Lower case where no letter's case or composition depends on its neighbours; the vocabulary has lower case only."""
    try:
        if "<|" in text:
            return text
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def word_encoder(path: str, cache_size: int = 150_000) -> Callable[[Sequence[str]], list[bytes]]:
    """Token ids of whole texts, as little-endian 32-bit bytes, for a vocabulary with word ends.

    No token of such a vocabulary crosses a space or line feed, so each distinct word is encoded once and kept in a table that
    the caller keeps over tasks. Beyond ``cache_size`` entries the table becomes the older of two: words met again
    move to the new one, the others go with the next change. A word of plain letters, with closing punctuation or none, shares
    the entry of its letters; new ones are encoded together and parted where a token ends a word.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    plain_words = Tokenizer(tokenizer.model)  # for lower-case letters alone: nothing to normalise, nothing to part but at spaces
    plain_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    if hasattr(plain_words.model, "_resize_cache"):
        plain_words.model._resize_cache(0)  # words are kept here
    ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def alone(words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def together(words: list[str]) -> list[bytes]:
        ids = np.array(plain_words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(words):
            return alone(words)
        blob = ids.tobytes()
        return [blob[4 * a : 4 * b] for a, b in zip([0, *stops.tolist()], stops.tolist(), strict=False)]

    def recall(words: set[str]) -> set[str]:
        """Move words from the older table to the new one; the words that neither holds."""
        missing = words.difference(known)
        if older:
            found = {w: older[w] for w in missing if w in older}
            known.update(found)
            missing.difference_update(found)
        return missing

    def learn(words: set[str]) -> None:
        plain = {w: m.groups() for w in words if (m := _PLAIN(w))}
        letters = list(recall({p[0] for p in plain.values()}))
        for at in range(0, len(letters), 2000):
            known.update(zip(letters[at : at + 2000], together(letters[at : at + 2000]), strict=True))
        odd = [*recall({p[1] for p in plain.values()}), *(w for w in words if w not in plain)]
        known.update(zip(odd, alone(odd), strict=True))
        known.update((w, known[a] + known[b]) for w, (a, b) in plain.items() if b)

    def encode(texts: Sequence[str]) -> list[bytes]:
        nonlocal known, older
        if len(known) > cache_size:
            known, older = {}, known
        words = [_lower(t).replace("\n", " ").split(" ") if t else [] for t in texts]
        fresh = recall(set().union(*words))
        if fresh:
            learn(fresh)
        return [b"".join(map(known.__getitem__, ws)) for ws in words]

    return encode


def difference(sizes: Sequence[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp differencing into ``k`` groups: the two partial partitions of largest spread merge, the heaviest
    group of one with the lightest of the other. Returns the indexes of each group, heaviest group first."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap: list = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, i)] + [(0, None)] * (k - 1)))
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = [(x[0] + y[0], y[1] if x[1] is None else x[1] if y[1] is None else (x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)]
        merged.sort(key=_weight, reverse=True)
        low = merged[-1][0]
        if low:
            merged = [(s - low, m) for s, m in merged]
        heapq.heappush(heap, (-merged[0][0], fresh, merged))
        fresh += 1
    groups = []
    for _, tree in heap[0][2] if heap else []:
        members, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            elif x is not None:
                members.append(x)
        groups.append(sorted(members))
    return groups


def _weight(x: tuple) -> int:
    return x[0]


def fit_windows(sizes: Sequence[int], window: int) -> list[list[int]]:
    """Groups of indexes whose sizes sum to at most ``window``: the count starts at the smallest possible one and rises
    while differencing exceeds the capacity."""
    if not sizes:
        return []
    k = max(1, math.ceil(sum(sizes) / window))
    while True:
        groups = [g for g in difference(sizes, k) if g]
        if all(sum(sizes[i] for i in g) <= window for g in groups):
            return groups
        k += 1


def cut(length: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then a rest in near-equal pieces of at most ``piece``."""
    out = [(at, window) for at in range(0, length - window + 1, window)]
    start = len(out) * window
    rest = length - start
    if rest:
        n = math.ceil(rest / piece)
        bounds = [start + rest * i // n for i in range(n + 1)]
        out += [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece: int = 512, group_windows: int = 64) -> DataFrame:
    """Cut every document's ids (its text's, then id 1) into pieces and place them into windows.

    Each task reads its documents once, fills a group of about ``group_windows`` windows' tokens at a time and divides
    that group by differencing; there is no shuffle, and a task holds one group. Sequence ids carry the input partition, so
    a task run again after a lost executor gives the same ids. Null and empty texts give the single id 1. Repeated rows are
    packed each time they occur; other columns are ignored; an empty table gives no rows. A group of one window or less is
    padded only at its end.
    """
    _, out = arrow_schema(DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_state(f"words of {tokenizer_path}", lambda: word_encoder(tokenizer_path))
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        waiting: list[tuple] = []
        held = 0

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        def flush() -> list[tuple]:
            nonlocal sequence, waiting, held
            rows = []
            for group in fit_windows([w[2] for w in waiting], window):
                offset = 0
                for i in group:
                    rows.append((*waiting[i], sequence, offset))
                    offset += waiting[i][2]
                sequence += 1
            waiting, held = [], 0
            return rows

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows: list[tuple] = []
                for name, ids in zip(names, encode([t or "" for t in texts]), strict=True):
                    ids += SEPARATOR
                    tokens = len(ids) // 4
                    for start, length in cut(tokens, window, piece):
                        row = (name, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), tokens)
                        if length == window:
                            rows.append((*row, sequence, 0))
                            sequence += 1
                        else:
                            waiting.append(row)
                            held += length
                            if held >= group_windows * window:
                                rows += flush()
                if rows:
                    yield emit(rows)
        if waiting:
            yield emit(flush())

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(releasing(run), arrow_schema(DDL)[0])
