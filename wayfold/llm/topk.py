"""Exact top-k inner products by a dual-tree search over cover trees of queries and data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, release_memory, saved

LEAF = 192


#: Stands for no id; larger than any.
NONE = np.iinfo(np.int64).max


def slack(bound: float) -> float:
    """A bound with room for rounding."""
    return bound + 1e-9 * abs(bound) + 1e-6


class Node:
    __slots__ = ("center", "children", "length", "lowest", "points", "radius")

    def __init__(self, center: np.ndarray, radius: float, points: np.ndarray | None, children: list[Node]):
        self.center, self.radius, self.points, self.children = center, radius, points, children
        self.length = float(np.sqrt(center @ center))
        self.lowest = -np.inf  # worst k-th score in a query node

    def rows(self) -> np.ndarray:
        """All points below."""
        return self.points if self.points is not None else np.concatenate([c.rows() for c in self.children])


def cover_tree(x: np.ndarray, leaf: int = LEAF, base: float = 1.6, most: int = 24) -> Node | None:
    """Root of a cover tree: the children of a node of scale s have centers more than s / base apart, and each covers its
    points within s / base. ``radius`` is the largest distance from the center to any point below. Points without a
    neighbourhood of their own (few others within the scale, or ``most`` children found already, as where vectors have no
    structure) lie in leaves around the node's own center, which is worth more as array work than as nodes."""
    if not len(x):
        return None

    def distances(rows: np.ndarray, center: np.ndarray) -> np.ndarray:
        d = x[rows] - center
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def build(rows: np.ndarray, d: np.ndarray) -> Node:
        center, radius = x[rows[0]], float(d.max())
        if len(rows) <= leaf or radius == 0:
            return Node(center, radius, rows, [])
        scale, children, loose = radius / base, [], []
        rest, rest_d, tries = rows, d, 0
        while len(rest) > leaf and tries < most:
            near = rest_d <= scale
            group, group_d = rest[near], rest_d[near]
            rest = rest[~near]
            if len(group) < leaf // 8:
                loose.append(group)
            else:
                children.append(build(group, group_d))
            tries += 1
            if len(rest):
                rest_d = distances(rest, x[rest[0]])
        loose = np.concatenate([*loose, rest])
        for at in range(0, len(loose), leaf):
            part = loose[at : at + leaf]
            children.append(Node(center, float(distances(part, center).max()), part, []))
        return Node(center, radius, None, children)

    order = np.arange(len(x))
    return build(order, distances(order, x[0]))


class DualTreeSearch:
    """Best ``k`` data points of each query by integer inner product. Ties go to the smaller id; equal ids never match, and an id counts
    once per score. ``floor`` has scores that each query is known to reach ``k`` times; what lies below is of no use."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, x, k
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.tree = cover_tree(x)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), NONE)
        stack = [self.tree] if self.tree else []
        while stack:
            node = stack.pop()
            stack += node.children
            node.lowest = float(self.floor[node.rows()].min())

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Search another block of data; bounds of earlier blocks keep pruning."""
        tree = cover_tree(x)
        if tree is None or self.tree is None:
            return
        stack = [(np.inf, self.tree, tree)]
        while stack:
            bound, q, p = stack.pop()
            if bound < q.lowest:
                continue
            if q.points is not None and p.points is not None:
                points = p.points
                if p.radius == 0 and len(points) > self.k:  # one vector many times: the smallest ids win, the query's own aside
                    points = points[np.unique(ids[points], return_index=True)[1][: self.k + 1]]
                self._leaf(q, q.points, ids[points], x[points])
                continue
            if p.points is None and (q.points is not None or p.radius >= q.radius):
                pairs = [(q, c) for c in p.children]
            else:
                pairs = [(c, p) for c in q.children]
            stack += sorted(((self._bound(a, b), a, b) for a, b in pairs), key=lambda t: t[0])
            if q.children:
                q.lowest = max(q.lowest, min(c.lowest for c in q.children))

    @staticmethod
    def _bound(q: Node, p: Node) -> float:
        """No inner product below the pair is larger; a little slack covers rounding."""
        return slack(float(q.center @ p.center) + q.radius * p.length + p.radius * q.length + q.radius * p.radius)

    def _leaf(self, node: Node, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        got = self.x[rows] @ x.T
        got[self.ids[rows][:, None] == ids[None, :]] = -np.inf
        got[got < self.floor[rows][:, None]] = -np.inf
        least = self.scores[rows][:, -1:]
        if len(ids) > self.k:  # all ties with the k-th stay in
            least = np.maximum(least, -np.partition(-got, self.k - 1, axis=1)[:, self.k - 1 : self.k])
        new, at = np.nonzero((got >= least) & (got > -np.inf))
        if len(new):
            old, place = np.nonzero(self.scores[rows] > -np.inf)
            row = np.concatenate([old, new])
            score = np.concatenate([self.scores[rows][old, place], got[new, at]])
            found = np.concatenate([self.found[rows][old, place], ids[at]])
            order = np.lexsort((found, -score, row))
            row, score, found = row[order], score[order], found[order]
            fresh = np.ones(len(row), bool)  # an id with several vectors of one score counts once
            fresh[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (found[1:] != found[:-1])
            row, score, found = row[fresh], score[fresh], found[fresh]
            starts = np.searchsorted(row, np.arange(len(rows)))
            place = np.arange(len(row)) - starts[row]
            best = place < self.k
            self.scores[rows[row[best]], place[best]] = score[best]
            self.found[rows[row[best]], place[best]] = found[best]
            node.lowest = max(node.lowest, float(self.scores[rows][:, -1].min()))

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, found ids and scores of all that was found."""
        ok = ~np.isneginf(self.scores)
        return np.broadcast_to(self.ids[:, None], self.found.shape)[ok], self.found[ok], self.scores[ok].astype(np.int64)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, v`` with components floor(scale * x); vectors that are null or hold null or non-finite components are left out."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))


def pick_centers(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows, each the one furthest from those before it: the upper levels of a cover tree."""
    rows = [0]
    near = np.full(len(x), np.inf)
    while len(rows) < most:
        d = x - x[rows[-1]]
        near = np.minimum(near, np.einsum("ij,ij->i", d, d))
        far = int(near.argmax())
        if near[far] == 0:
            break
        rows.append(far)
    return x[rows]


def _vectors(column: pa.ListArray, pick: np.ndarray, n: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    return np.asarray(values[starts[pick][:, None] + np.arange(n)], dtype=np.float64).reshape(len(pick), n)


def assign_cells(rows: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id, v, dim, cell, off`` of every row: the nearest center of its length and the distance to it. Lengths without centers have
    the origin as their only one."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)
    schema, out = arrow_schema("vec_id long, v array<double>, dim int, cell int, off double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            dims = np.diff(column.offsets.to_numpy()).astype(np.int32)
            cell, off = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for n in np.unique(dims):
                c = shared.value.get(int(n), np.zeros((1, n)))
                for pick in np.array_split(at := np.flatnonzero(dims == n), -(-len(at) // 1024)):
                    x = _vectors(column, pick, n)
                    d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0)
                    cell[pick] = d.argmin(axis=1)
                    gap = x - c[cell[pick]]
                    off[pick] = np.sqrt((gap * gap).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), column.cast(out.field("v").type), pa.array(dims), pa.array(cell), pa.array(off)], schema=out)
        release_memory()

    return rows.mapInArrow(run, schema)


def search_groups(queries: DataFrame, data: DataFrame, k: int, block_rows: int, parts: int) -> DataFrame:
    """``query_id, vec_id, score, full`` by dual-tree search within each group. ``queries(dim, grp, vec_id, v, floor)``, of which a group fits a
    worker, come first; ``data(dim, grp, cell, b, vec_id, v)`` is streamed in blocks. ``full``: the query has ``k`` results."""
    schema, out = arrow_schema("query_id long, vec_id long, score long, full boolean")
    rows = queries.select("dim", "grp", F.lit(0).alias("role"), F.lit(0).alias("cell"), F.lit(0).cast("long").alias("b"), "vec_id", "v", "floor")
    rows = rows.union(data.select("dim", "grp", F.lit(1), "cell", "b", "vec_id", "v", F.lit(None).cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, search = None, None
        asked: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal search, held
            if search is None and asked:
                search = DualTreeSearch(*(np.concatenate(c) for c in list(zip(*asked, strict=True))[:2]), k, np.concatenate([a[2] for a in asked]))
            if search is not None and waiting:
                search.add(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
            waiting.clear()
            held = 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal search
            flush()
            if search is not None:
                q, ids, scores = search.results()
                full = ~np.isneginf(search.scores[:, -1])
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(scores), pa.array(np.repeat(full, (~np.isneginf(search.scores)).sum(axis=1)))], schema=out)
            asked.clear()
            search = None

        for batch in batches:
            dims, groups, roles, cells, bs, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            floors = batch.column(7).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((np.diff(dims) != 0) | (np.diff(groups) != 0) | (np.diff(roles) != 0) | (np.diff(cells) != 0) | (np.diff(bs) != 0)) + 1
            for a, e in zip([0, *change.tolist()], [*change.tolist(), len(dims)], strict=True):
                if group != (key := (int(dims[a]), int(groups[a]))):
                    yield from finish()
                    group = key
                for at in range(a, e, block_rows):
                    pick = np.arange(at, min(e, at + block_rows))
                    x = _vectors(batch.column(6), pick, group[0])
                    if roles[a] == 0:
                        asked.append((ids[pick].astype(np.int64), x, np.where(np.isnan(f := floors[pick].astype(float)), -np.inf, f)))
                    elif asked:
                        waiting.append((ids[pick].astype(np.int64), x))
                        held += len(pick)
                        if held >= block_rows:
                            flush()
        yield from finish()
        release_memory()

    return rows.repartition(parts, "dim", "grp").sortWithinPartitions("dim", "grp", "role", "cell", "b").mapInArrow(run, schema)


def top_inner_products(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256,
    centers: int = 64, sample_rows: int = 2048, query_bytes: int = 32 << 20, block_rows: int = 4096, group_rows: int = 262_144,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every vector whose id is divisible by ``every``, its ``k`` best others.

    The upper levels of the cover trees are ``centers`` rows of a sample of ``sample_rows`` (the only vectors that come to the driver);
    every row belongs to the cell of its nearest center. Queries are dealt to blocks of about ``query_bytes``, by cell, data to
    blocks of about ``block_rows`` of a cell. Each query block first searches one data block of its own cells, which gives every
    query a score it reaches ``k`` times; a data block whose covering radius rules all of a query block out is then left out of the
    join. Blocks that stay meet in groups of about ``group_rows`` data rows (a quarter million at most, so that few results go on),
    where trees of both are searched together. A cell with a third of all rows is as many blocks as its rows need.

    Equal rows count once, and so do equal results of a query id with several vectors. Vectors that are null or hold null or non-finite
    components take no part; vectors of another length than the query score nothing with it; other columns are ignored.
    Fewer than ``k`` others give all; empty tables give no rows. Scores are exact below 2^53.
    """
    rows = saved(whole_vectors(vectors, id_col, vector_col, scale).distinct())
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id", F.xxhash64("v")).limit(sample_rows).select("v").toLocalIterator():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    table = {n: pick_centers(np.array(v, dtype=np.float64).reshape(len(v), n), centers) for n, v in sample.items()}
    placed = assign_cells(rows, table)
    asks = F.col("vec_id") % every == 0
    # a row's place in its cell, by a hash of its id, as a fraction
    placed = saved(placed.withColumn("at", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(1 << 30)) / (1 << 30)))
    cells = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("nq"))
    order = Window.partitionBy("dim").orderBy("cell")  # rows of this window: the centers of a length
    before = F.coalesce(F.sum("nq").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = F.greatest(F.lit(64), F.lit(query_bytes) / (8 * F.greatest(F.col("dim"), F.lit(1))))
    total = F.sum("n").over(Window.partitionBy("dim"))
    share = F.least(F.lit(group_rows), F.greatest(F.lit(block_rows), F.ceil(total / 64)))
    cells = saved(cells.select("dim", "cell", "nq", before.alias("before"), per.alias("per"), F.ceil(F.col("n") / block_rows).alias("blocks"), F.ceil(total / share).alias("groups")))
    placed = placed.join(cells, ["dim", "cell"])
    data = placed.withColumn("b", F.floor(F.col("at") * F.col("blocks")))
    queries = placed.where(asks).withColumn("qb", F.floor((F.col("before") + F.col("at") * F.col("nq")) / F.col("per")))

    # first look: the queries of a cell against its first block
    cell_group = lambda: (F.col("qb") * centers + F.col("cell")).cast("long")
    asked = queries.select("dim", "cell", cell_group().alias("grp"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    homes = queries.select("dim", "cell", "qb").distinct().select("dim", "cell", cell_group().alias("grp"))
    first = data.where("b = 0").select("dim", "cell", "b", "vec_id", "v").join(homes, ["dim", "cell"]).select("dim", "grp", "cell", "b", "vec_id", "v")
    spark = vectors.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, 64)
    reached = search_groups(asked, first, k, block_rows, parts).where("full").groupBy("query_id").agg(F.min("score").cast("double").alias("floor"))
    # of a query id with several vectors none may count on what another one reached
    lone = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("query_id")
    reached = reached.join(lone, "query_id", "left_semi")
    queries = saved(queries.join(reached.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("dim", "cell", "qb", "vec_id", "v", "off", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))

    # pairs of blocks that the bound can't rule out
    dots = [(n, i, j, float(c[i] @ c[j]), float(np.sqrt(c[i] @ c[i])), float(np.sqrt(c[j] @ c[j]))) for n, c in table.items() for i in range(len(c)) for j in range(len(c))]
    dots = spark.createDataFrame(dots, "dim int, qcell int, cell int, dot double, qlen double, len double")
    asks_of = queries.groupBy("dim", F.col("cell").alias("qcell"), "qb").agg(F.max("off").alias("qr"), F.min("floor").alias("lowest"))
    blocks = data.groupBy("dim", "cell", "b").agg(F.max("off").alias("r"), F.first("groups").alias("groups"))
    near = blocks.join(asks_of, "dim").join(F.broadcast(dots), ["dim", "qcell", "cell"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    bound = zero(F.col("dot")) + F.col("qr") * zero(F.col("len")) + F.col("r") * zero(F.col("qlen")) + F.col("qr") * F.col("r")
    near = near.where(bound + 1e-6 * F.abs(bound) + 1e-3 >= F.col("lowest"))
    group = (F.col("qb") * 1_000_003 + F.pmod(F.xxhash64("cell", "b"), F.col("groups"))).cast("long")
    near = saved(near.select("dim", "cell", "b", "qb", group.alias("grp")).distinct())

    meets = data.select("dim", "cell", "b", "vec_id", "v").join(near.select("dim", "cell", "b", "grp"), ["dim", "cell", "b"]).select("dim", "grp", "cell", "b", "vec_id", "v")
    sent = queries.join(near.select("dim", "qb", "grp").distinct(), ["dim", "qb"]).select("dim", "grp", "vec_id", "v", "floor")
    many = near.select("dim", "grp").distinct().count()
    found = search_groups(sent, meets, k, block_rows, min(20_000, max(parts, many))).drop("full").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
