"""Exact Jaccard join of documents on word shingles by a size-aware heavy-light scheme."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, arrow_schema, heavy_light_join, map_columns, min_label_components, releasing, saved

SHINGLE = 5
#: Least similarity as a fraction: 100 * intersection >= 80 * union.
NUM, DEN = 4, 5
#: A shingle in more sets than this and than HOT_SHARE of all has its list dealt over salts, about as many sets to each.
HOT_LIST = 500

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_BASE, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return cls.up[:n], cls.down


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; with fewer words, of the whole sequence; empty without words."""
    if not text:
        return np.zeros(0, np.uint64)
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    if len(words) < SHINGLE:
        return mix(np.array([(words * _PLACE[: len(words)]).sum() + np.uint64(len(words))], np.uint64))
    n = len(words) - SHINGLE + 1
    total = words[:n] * _PLACE[0]
    for i in range(1, SHINGLE):
        total += words[i : i + n] * _PLACE[i]
    return np.unique(mix(total))


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    return int(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(tokens + np.uint64(0x14057B7EF767814F))).view(np.int64)) if len(tokens) else 0


def least_overlap(n: int) -> int:
    return (NUM * n + DEN - 1) // DEN


def similar_sizes(a, b):
    return DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not similar_sizes(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def parity_marks(tokens: np.ndarray, most: int = 1 << 16) -> bytes:
    """Parity of the set's hashes over 2 to 4 bits a shingle (a power of two, at most ``most``): two sets differ in at least as many
    shingles as their marks in bits."""
    bits = min(most, max(64, 1 << int(2 * len(tokens) - 1).bit_length())) if len(tokens) else 64
    flags = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flags.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> bool:
    """False only where the marks prove that two sets differ in more than a ninth of their sizes' sum."""
    (n, x), (m, y) = a, b
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return (DEN + NUM) * int(np.bitwise_count(x ^ y).sum()) <= (DEN - NUM) * (n + m)


def repeated_tokens(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that occur more than twice in the arrays of ``held``, ascending, and their counts; empties ``held``. It sorts one copy
    and looks for equal ends of three in a row, so it holds no second array of that length."""
    tokens = np.concatenate(held)
    held.clear()
    tokens.sort()
    values, counts = np.unique(tokens[2:][tokens[2:] == tokens[:-2]], return_counts=True)
    return values, counts + 2


def profile(docs: DataFrame, flush: int = 2_000_000) -> DataFrame:
    """Per document its set size and signature; and, as rows of null id, shingles met in several sets of one task with their counts."""

    def make():
        held: list[np.ndarray] = []
        size = 0

        def repeats() -> list[list]:
            nonlocal size
            if not held:
                return [[]] * 7
            values, counts = repeated_tokens(held)
            size = 0
            k = len(values)
            return [[None] * k, [None] * k, [None] * k, [None] * k, [None] * k, values.view(np.int64).tolist(), counts.tolist()]

        def fn(ids, texts):
            nonlocal size
            ns, s1, s2, marks = [], [], [], []
            for t in texts:
                tokens = shingle_set(t)
                a, b = signature(tokens)
                ns.append(len(tokens))
                s1.append(a)
                s2.append(b)
                marks.append(parity_marks(tokens))
                held.append(tokens)
                size += len(tokens)
            nulls = [None] * len(ids)
            out = [list(ids), ns, s1, s2, marks, nulls, list(nulls)]
            if size > flush:
                out = [a + b for a, b in zip(out, repeats(), strict=True)]
            return out

        fn.finish = repeats
        return fn

    return map_columns(docs, "doc_id long, n long, s1 long, s2 long, marks binary, token long, cnt long", make)


def choose_boundary(histogram: dict[int, int], repeat_rate: float, check_cost: float = 30.0, top: int = 120) -> int:
    """The set size up to which 2-subsets of prefixes are enumerated: the least cost of subsets on one side, postings and
    the checks that single shared shingles lead to on the other."""

    def subsets(n: int) -> float:
        p = n - least_overlap(n) + 2
        return p * (p - 1) / 2

    def scans(n: int) -> float:
        return (n - least_overlap(n) + 1) * (1 + repeat_rate * check_cost)

    def cost(b: int) -> float:
        return sum(c * ((subsets(n) if n <= b else 0) + (scans(n) if DEN * n > NUM * b else 0)) for n, c in histogram.items() if n <= 2 * top)

    return min(range(top + 1), key=lambda b: (cost(b), b))


def postings(docs: DataFrame, heavy: np.ndarray, parts: np.ndarray, boundary: int) -> DataFrame:
    """Keys under which sets meet. Shingles are ordered with the frequent ones (``heavy``) last, then by hash. A set of at most ``boundary``
    shingles gives every 2-subset of its prefix; a larger one, or one near the boundary, the shingles of its prefix. Sets that a task
    has already met are left out, as are sets under four shingles: at this similarity they only match equal ones.

    ``parts`` tells for every frequent shingle over how many salts its list is dealt; a 2-subset takes the smaller number of its two.
    A list that is not dealt has salt 0, the salts of the others begin at 1."""
    shared = docs.sparkSession.sparkContext.broadcast((heavy, parts))

    def make():
        frequent, dealt = shared.value
        met: set[tuple[int, int]] = set()

        def fn(ids, texts):
            keys, owners, sizes, rare, salts = [], [], [], [], []
            for i, t in zip(ids, texts, strict=True):
                tokens = shingle_set(t)
                n = len(tokens)
                if n < DEN - 1 or i is None:
                    continue
                mark = signature(tokens)
                if mark in met:
                    continue
                if len(met) > 200_000:
                    met.clear()
                met.add(mark)
                often, share = np.zeros(n, bool), np.ones(n, np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                    often = frequent[at] == tokens
                    share = np.where(often, dealt[at], 1)
                ordered, share = (np.concatenate([x[~often], x[often]]) for x in (tokens, share))
                p = n - least_overlap(n) + 1
                found, split = [], []
                if n <= boundary:
                    a, b = np.triu_indices(min(n, p + 1), 1)
                    found.append(mix(ordered[a] * _PLACE[0] + ordered[b] * _PLACE[1]))
                    split.append(np.minimum(share[a], share[b]))
                if DEN * n > NUM * boundary:
                    found.append(ordered[:p])
                    split.append(share[:p])
                k = sum(map(len, found))
                spread = int(mix(np.array([i], np.int64).view(np.uint64))[0] >> np.uint64(1))
                split = np.concatenate(split)
                salts.append(np.where(split > 1, spread % split + 1, 0))
                keys.append(np.concatenate(found).view(np.int64))
                owners += [i] * k
                sizes += [n] * k
                rare += [int(n - often.sum())] * k
            return [np.concatenate(keys) if keys else [], owners, sizes, rare, np.concatenate(salts) if salts else []]

        return fn

    return map_columns(docs, "key long, doc_id long, n int, rare int, salt int", make)


def _runs(keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])]))


def star_pairs(posted: DataFrame, whole: int = 4) -> DataFrame:
    """Candidates from inverted lists: lists of up to ``whole`` sets give all their pairs; longer ones pair each set with the list's first
    (fewest rare shingles), and are kept (``b`` null) for a second look at what stays apart. Lists are streamed: a list of any
    length takes no more memory than a batch. Every salt of a dealt list counts as a longer one, with a first set of its own."""
    schema, out = arrow_schema("a long, b long, key long, n int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # rows of the last, perhaps unfinished list: key, docs, sizes, salts
        center = None  # key, salt, doc and size that a longer list began with

        def emit(pairs, keys, docs, sizes):
            k, m = len(pairs), len(keys)
            null = lambda n, t: pa.nulls(n, t)
            a = pa.array(np.concatenate([pairs[:, 0], docs]))
            b = pa.concat_arrays([pa.array(np.ascontiguousarray(pairs[:, 1])), null(m, pa.int64())])
            key = pa.concat_arrays([null(k, pa.int64()), pa.array(keys)])
            return pa.RecordBatch.from_arrays([a, b, key, pa.concat_arrays([null(k, pa.int32()), pa.array(sizes, type=pa.int32())])], schema=out)

        def unequal(a, b):
            a, b = np.maximum(a, b), np.minimum(a, b)
            return np.unique(np.stack([a[a != b], b[a != b]], axis=1), axis=0)

        def finished(keys, docs, sizes, salts):
            starts = _runs(keys, salts)
            lengths = np.diff(np.append(starts, len(keys)))
            run = np.repeat(np.arange(len(starts)), lengths)
            long = ((lengths > whole) | (salts[starts] > 0))[run]
            parts_a, parts_b = [], []
            for gap in range(1, whole):
                same = np.flatnonzero((run[gap:] == run[:-gap]) & ~long[gap:])
                same = same[similar_sizes(sizes[same], sizes[same + gap])]
                parts_a.append(docs[same + gap])
                parts_b.append(docs[same])
            rows = np.flatnonzero(long)
            first = starts[run[rows]]
            near = similar_sizes(sizes[rows], sizes[first])
            parts_a.append(docs[rows[near]])
            parts_b.append(docs[first[near]])
            return emit(unequal(np.concatenate(parts_a), np.concatenate(parts_b)), keys[rows], docs[rows], sizes[rows])

        for batch in batches:
            keys, docs, sizes, salts = (batch.column(i).to_numpy() for i in range(4))
            if not len(keys):
                continue
            if center is not None:  # a longer list goes on
                same = (keys == center[0]) & (salts == center[1])
                more = len(keys) if same.all() else int(np.argmin(same))
                if more:
                    near = docs[:more][similar_sizes(sizes[:more], center[3])]
                    yield emit(unequal(near, np.full(len(near), center[2])), keys[:more], docs[:more], sizes[:more])
                    keys, docs, sizes, salts = keys[more:], docs[more:], sizes[more:], salts[more:]
                if not len(keys):
                    continue
                center = None
            if tail is not None:
                keys, docs, sizes, salts = (np.concatenate([x, y]) for x, y in zip(tail, (keys, docs, sizes, salts), strict=True))
                tail = None
            last = int(_runs(keys, salts)[-1])
            if salts[last] or len(keys) - last > whole:
                center = (keys[last], salts[last], docs[last], sizes[last])  # surely longer: its rows so far go out with the rest
            else:
                tail = (keys[last:], docs[last:], sizes[last:], salts[last:])
                keys, docs, sizes, salts = keys[:last], docs[:last], sizes[:last], salts[:last]
            if len(keys):
                yield finished(keys, docs, sizes, salts)
        if tail is not None:
            yield finished(*tail)

    return posted.repartition("key", "salt").sortWithinPartitions("key", "salt", "rare", "doc_id").select("key", "doc_id", "n", "salt").mapInArrow(releasing(run), schema)


def mixed_lists(lists: DataFrame, *more) -> DataFrame:
    """``key, c`` and the aggregates ``more`` of the lists that hold several components; of lists with the same members one is taken."""
    counts = lists.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("y"), *more).where("c0 <> c1")
    extra = [n for n in counts.columns if n not in ("key", "c", "c0", "c1", "x", "y")]
    return counts.groupBy("c", "x", "y").agg(F.min("key").alias("key"), *(F.min(n).alias(n) for n in extra)).select("key", "c", *extra)


def center_pairs(lists: DataFrame, seed: int, centers: int = 8) -> DataFrame:
    """Pairs ``a, b`` of every set of a list with several components and each of the list's ``centers`` (``b``) in another component.
    A center is the id nearest to a seeded mask, so lists that share sets share centers. The rows are linear in the lists' lengths."""
    masks = [int(m) for m in np.random.default_rng(seed).integers(0, 1 << 62, centers)]
    near = [F.min(F.col("doc_id").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(masks)]
    dims = mixed_lists(lists, *near)
    dims = saved(dims.select("key", "c", F.array_distinct(F.array(*(F.col(f"m{i}").bitwiseXOR(F.lit(m)) for i, m in enumerate(masks)))).alias("at")))
    rows = heavy_light_join(lists, dims, ["key"], "c")
    pairs = rows.select(F.col("doc_id").alias("a"), F.explode("at").alias("b"), F.col("n").alias("an"), F.col("comp").alias("ac")).where("a <> b").distinct()
    other = lists.select(F.col("doc_id").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc")).join(dims.select(F.explode("at").alias("b")).distinct(), "b", "left_semi").distinct()
    return pairs.join(other, "b").where((F.col("ac") != F.col("bc")) & (DEN * F.least("an", "bn") >= NUM * F.greatest("an", "bn"))).select("a", "b")


def cross_pairs(lists: DataFrame, marks: DataFrame, block: int = 512) -> DataFrame:
    """Pairs of sets of one list that lie in different components and may link by their marks. ``lists(key, doc_id, n, comp)``. Of lists
    with the same members one is looked at. A list is dealt to pairs of blocks, so a task holds about two blocks of it at a time. Its
    largest component has blocks of its own, which only meet those of the rest: near copies that are joined already
    cost one comparison for each set outside, not one for each other."""
    members = saved(heavy_light_join(lists, saved(mixed_lists(lists)), ["key"], "c").drop("c"))
    counts = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.sum("m").alias("c"), F.max(F.struct("m", "comp")).alias("most"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    counts = saved(counts.select("key", "c", F.col("most.comp").alias("lead"), blocks(F.col("most.m")).alias("nl"), blocks(F.col("c") - F.col("most.m")).alias("nr")))
    rows = heavy_light_join(members, counts, ["key"], "c").join(marks.select("doc_id", "marks"), "doc_id")
    leads, spread = F.col("comp") == F.col("lead"), F.xxhash64("doc_id")
    rows = rows.withColumn("k", F.when(leads, F.pmod(spread, "nl")).otherwise(F.col("nl") + F.pmod(spread, "nr")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.when(leads, F.col("nl")).otherwise(F.lit(0)), F.col("nl") + F.col("nr") - 1)))
    rows = rows.select("key", F.least("k", "j").alias("lo"), F.greatest("k", "j").alias("hi"), "k", "doc_id", "n", "comp", "marks")
    schema, out = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def pairs(group: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            _, lo, hi, k, docs, sizes, comps, bits = group
            left = np.flatnonzero(k == lo)
            right = left if lo[0] == hi[0] else np.flatnonzero(k == hi)
            for at in range(0, len(left), 256):
                rows = left[at : at + 256]
                ok = (comps[rows][:, None] != comps[right][None, :]) & similar_sizes(sizes[rows][:, None], sizes[right][None, :])
                if lo[0] == hi[0]:
                    ok &= docs[rows][:, None] > docs[right][None, :]
                i, j = np.nonzero(ok)
                i, j = rows[i], right[j]
                near = _marks_allow(bits, sizes, i, j)
                if near.any():
                    a, b = docs[i[near]], docs[j[near]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], schema=out)

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(7)]
            cols.append(np.array([np.frombuffer(m, "<u8") for m in batch.column(7).to_pylist()] + [None], dtype=object)[:-1])
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            change = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            for s, e in zip(starts[:-1], starts[1:], strict=False):
                if cols[6][s:e].min() != cols[6][s:e].max():
                    yield from pairs([c[s:e] for c in cols])
            held = [c[starts[-1] :] for c in cols]
        if held is not None and len(held[0]):
            yield from pairs(held)

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(releasing(run), schema)


def _marks_allow(marks: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """``may_link`` for many index pairs at once: pairs are taken by the lengths of their marks, the longer folded to the shorter."""
    length = np.array([len(m) for m in marks])
    allow = np.zeros(len(i), bool)
    for u in np.unique(length[i]):
        for v in np.unique(length[j[length[i] == u]]):
            rows = np.flatnonzero((length[i] == u) & (length[j] == v))
            w = min(u, v)
            step = max(1, chunk // int(w))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                x = np.stack(marks[i[part]]).reshape(len(part), -1, w)
                y = np.stack(marks[j[part]]).reshape(len(part), -1, w)
                x, y = np.bitwise_xor.reduce(x, axis=1), np.bitwise_xor.reduce(y, axis=1)
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                allow[part] = (DEN + NUM) * apart <= (DEN - NUM) * (sizes[i[part]].astype(np.int64) + sizes[j[part]])
    return allow


def _check(pairs: DataFrame, counts: DataFrame, table: DataFrame, prepare, test) -> DataFrame:
    """Pairs ``a, b`` that pass ``test`` on what ``prepare`` makes of their rows in ``table(doc_id, x, n)``. A pair is looked at where its ``b``
    is; a ``b`` with many partners is dealt to several tasks with a copy of its row each."""
    dealt = heavy_light_join(pairs, counts, ["b"], "c").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    some = dealt.join(table.withColumnRenamed("doc_id", "a"), "a").select("b", "part", F.lit(1).alias("role"), F.col("a").alias("doc_id"), "x", "n")
    heads = counts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(table.withColumnRenamed("doc_id", "b"), "b").select("b", "part", F.lit(0).alias("role"), F.col("b").alias("doc_id"), "x", "n")

    def make():
        current: list = [None, None]

        def fn(bs, parts, roles, ids, xs, ns):
            out_a, out_b = [], []
            for b, part, role, i, x, n in zip(bs, parts, roles, ids, xs, ns, strict=True):
                if role == 0:
                    current[0], current[1] = (b, part), prepare(x, n)
                elif current[0] == (b, part) and test(prepare(x, n), current[1]):
                    out_a.append(i)
                    out_b.append(b)
            return [out_a, out_b]

        return fn

    rows = some.union(heads).repartition("b", "part").sortWithinPartitions("b", "part", "role")
    return saved(map_columns(rows, "a long, b long", make))


def _partners(pairs: DataFrame, members: int) -> DataFrame:
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    return saved(counts.withColumn("parts", F.ceil(F.col("c") / members).cast("int")))


def _texts_of(docs: DataFrame, wanted: DataFrame, most_bits: int = 1 << 24) -> DataFrame:
    """Texts of the wanted ids. A bit table of bounded size goes out first, so that of the other texts few are shuffled."""
    count = wanted.count()
    bits = min(most_bits, max(1 << 12, 1 << (16 * count).bit_length()))
    spot = f"pmod(xxhash64(doc_id), {bits})"
    word, bit = F.expr(f"{spot} DIV 32").alias("word"), F.expr(f"shiftleft(1L, CAST({spot} % 32 AS INT))").alias("bit")
    words = wanted.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("on"))
    near = docs.select("doc_id", "text", word, bit).join(F.broadcast(words), "word").where(F.col("on").bitwiseAND(F.col("bit")) != 0)
    return near.select("doc_id", "text").join(wanted, "doc_id").dropDuplicates(["doc_id"])


def verify(pairs: DataFrame, docs: DataFrame, marks: DataFrame | None = None, members: int = 256) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough: parity marks drop pairs that can't be, exact intersections decide the rest."""
    pairs = saved(pairs.select("a", "b").distinct())
    if marks is not None:
        small = marks.select("doc_id", F.col("marks").alias("x"), "n")
        pairs = _check(pairs, _partners(pairs, 2 * members), small, lambda x, n: (n, np.frombuffer(x, "<u8")), may_link)
    wanted = saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = saved(_texts_of(docs, wanted).select("doc_id", F.col("text").alias("x"), F.lit(0).cast("long").alias("n")))
    return _check(pairs, _partners(pairs, members), texts, lambda x, n: shingle_set(x), linked)


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", heavy_least: int = 12, heavy_most: int = 200_000, rounds: int = 1) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every document: the size of its set, the smallest id reachable over links
    (100 * intersection >= 80 * union of 5-word shingles), and how many other classes of equal sets its class was found linked to.

    Equal sets are one class and enter the join once. Sets meet by 2-subsets of prefixes when small and by inverted lists of prefixes
    when large; the boundary is chosen by cost from the sizes and the rate of repeated shingles. The order that puts frequent shingles last
    is any fixed order to the join: its table is bounded (``heavy_most`` hashes, broadcast) and what it misses costs time, not links.
    Every link between different components is checked exactly; links inside a component already found need no check, so ``n_links``
    is a lower bound. ``rounds`` of seeded centers join sets at linear cost; any number of them gives the same components.
    Null and empty texts have empty sets and link with nothing; rows of one id must agree in text and count once; null ids are returned
    with their own null component; other columns are ignored; an empty table gives no rows. Hash values have 64 bits.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = saved(profile(rows))
    sets = found.where("token IS NULL").select("doc_id", "n", "s1", "s2")
    marks = found.where("token IS NULL AND doc_id IS NOT NULL").select("doc_id", "marks", "n").dropDuplicates(["doc_id"])
    repeated = found.where("token IS NOT NULL").groupBy("token").agg(F.sum("cnt").alias("c"))
    top = repeated.where(F.col("c") >= heavy_least).orderBy(F.col("c").desc(), "token").limit(heavy_most).toPandas()
    top["token"] = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    top = top.sort_values("token")
    heavy, often = top["token"].to_numpy(), top["c"].to_numpy(dtype=np.int64)
    sizes = {int(r["n"]): int(r["c"]) for r in sets.where("n BETWEEN 1 AND 240").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    totals = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    again = repeated.agg(F.sum("c").alias("c")).first()["c"] or 0
    most = max(HOT_LIST, int(sets.count() * HOT_SHARE))
    boundary = choose_boundary(sizes, again / totals if totals else 0.0)

    # equal sets: one representative, the smallest id
    classes = saved(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    copies = saved(heavy_light_join(sets, classes, ["n", "s1", "s2"], "c").select("doc_id", "rep", "n").distinct())

    looked = saved(star_pairs(postings(rows, heavy, -(-often // most), boundary)))
    to_rep = copies.where("doc_id <> rep").select("doc_id", "rep")

    def as_reps(df: DataFrame, column: str) -> DataFrame:
        named = to_rep.select(F.col("doc_id").alias("__d"), F.col("rep").alias("__r"))
        return df.join(named, F.col(column) == F.col("__d"), "left").withColumn(column, F.coalesce("__r", column)).drop("__d", "__r")

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    first = saved(ordered(as_reps(as_reps(looked.where("b IS NOT NULL").select("a", "b").distinct(), "a"), "b")))
    links = verify(first, rows, marks)
    comps = saved(min_label_components(links))
    lists = saved(as_reps(looked.where("b IS NULL").select("key", F.col("a").alias("doc_id"), "n"), "doc_id").distinct())

    def placed() -> DataFrame:
        return saved(lists.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp")))

    # a few centers a list join most of what its first set did not; what then stays apart is compared in full
    tested = first
    for seed in range(rounds):
        pairs = saved(center_pairs(placed(), seed).join(tested.select(F.col("a").alias("__a"), F.col("b").alias("__b")), (F.greatest("a", "b") == F.col("__a")) & (F.least("a", "b") == F.col("__b")), "left_anti"))
        late = verify(pairs, rows, marks)
        tested = saved(tested.union(ordered(pairs)).distinct())
        if not late.limit(1).count():
            break
        links = saved(links.union(late))
        comps = saved(min_label_components(links))
    second = cross_pairs(placed(), marks).distinct().join(tested, ["a", "b"], "left_anti")
    late = verify(second, rows)
    if late.limit(1).count():
        links = saved(links.union(late))
        comps = saved(min_label_components(links))
    links = ordered(links)
    degree = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))

    out = sets.select("doc_id", F.col("n").alias("n_shingles")).distinct()
    out = as_reps(out.withColumn("rep", F.col("doc_id")), "rep")
    out = out.join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, all columns as they were. Rows of null id stay."""
    parts = similar_components(docs, id_col=id_col, text_col=text_col)
    gone = parts.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
