"""Walking adjacency, connected components, closure and shortest paths over tile worlds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import saved

#: Neighbour offsets in the order west, east, south, north.
CARDINAL = [(-1, 0), (1, 0), (0, -1), (0, 1)]
DIAGONAL = [(-1, -1), (1, -1), (-1, 1), (1, 1)]


def walk_edges(tiles: DataFrame) -> DataFrame:
    """Directed steps ``s, d`` between walkable tiles that share a side: each tile emits its neighbours' keys, one hash join."""
    offsets = F.array(*(F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in CARDINAL))
    out = tiles.select("tile", "x", "y", "p", F.explode(offsets).alias("o")).where((F.col("x") + F.col("o.dx")).between(0, 32767) & (F.col("y") + F.col("o.dy")).between(0, 32767))
    out = out.select(F.col("tile").alias("s"), S.pack_tile(F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy"), F.col("p")).alias("d"))
    return out.join(tiles.select(F.col("tile").alias("d")), "d").select("s", "d")


def walk_masks(flags: DataFrame) -> DataFrame:
    """``tile, mask`` of eight bits clockwise from north, from ``tile, x, y, p, north, east`` passability. South and west are the
    neighbours' north and east; a diagonal needs all four sides around the corner."""
    at = {}
    base = flags.select("tile", "x", "y", "p", "north", "east")
    for name, dx, dy in (("s", 0, -1), ("w", -1, 0), ("n", 0, 1), ("e", 1, 0), ("sw", -1, -1), ("se", 1, -1), ("nw", -1, 1)):
        other = flags.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), "p", F.col("north").alias(f"n_{name}"), F.col("east").alias(f"e_{name}"))
        base = base.join(other, ["x", "y", "p"], "left")
        at[name] = (F.coalesce(f"n_{name}", F.lit(False)), F.coalesce(f"e_{name}", F.lit(False)))
    n, e = F.col("north"), F.col("east")
    south, west = at["s"][0], at["w"][1]
    ne = n & at["n"][1] & e & at["e"][0]
    se = south & at["s"][1] & e & at["se"][0]
    sw = south & at["sw"][1] & west & at["sw"][0]
    nw = n & at["nw"][1] & west & at["w"][0]
    bits = [n, ne, e, se, south, sw, west, nw]
    mask = sum((F.when(b, F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(bits)), F.lit(0))
    return base.select("tile", mask.cast("int").alias("mask"))


def star_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` with the smallest node of each component, by alternating large and small stars; for graphs of any size."""
    graph = saved(edges.where("s <> d").select(F.greatest("s", "d").alias("u"), F.least("s", "d").alias("v")).distinct())
    for _ in range(rounds):
        both = graph.union(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        graph = saved(small.union(smallest.select("u", F.col("m").alias("v"))).distinct())
        chained = graph.join(graph.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        if not chained and not graph.groupBy("u").count().where("count > 1").limit(1).count():
            return graph.select(F.col("u").alias("node"), F.col("v").alias("root")).union(graph.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("components did not settle")


def natural_components(tiles: DataFrame, edges: DataFrame, region: int = 64) -> DataFrame:
    """``tile, root, component_id``: connected components numbered from 1 by their smallest tile.

    Tiles are joined within regions of ``region`` squared (a bounded group each), then the regions' parts across borders by stars;
    only parts and border steps enter the second step.
    """
    block = lambda t: S.pack_tile(F.floor(S.tile_x(t) / region), F.floor(S.tile_y(t) / region), S.tile_plane(t))
    keyed = edges.withColumn("bs", block(F.col("s"))).withColumn("bd", block(F.col("d")))
    nodes = tiles.select(block(F.col("tile")).alias("block"), F.col("tile").alias("s"), F.col("tile").alias("d"))
    inner = keyed.where("bs = bd").select(F.col("bs").alias("block"), "s", "d").union(nodes)

    def label(group: pd.DataFrame) -> pd.DataFrame:
        s, d = group["s"].to_numpy(), group["d"].to_numpy()
        names = np.unique(s)
        a, b = np.searchsorted(names, s), np.searchsorted(names, d)
        root = np.arange(len(names))
        while True:
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if (new == root).all():
                return pd.DataFrame({"tile": names, "part": names[root]})
            root = new

    parts = saved(inner.groupBy("block").applyInPandas(label, "tile long, part long"))
    border = keyed.where("bs <> bd").select("s", "d").join(parts.select(F.col("tile").alias("s"), F.col("part").alias("ps")), "s").join(parts.select(F.col("tile").alias("d"), F.col("part").alias("pd")), "d").select(F.col("ps").alias("s"), F.col("pd").alias("d"))
    if border.limit(1).count():
        roots = star_components(border)
        parts = parts.join(roots.withColumnRenamed("node", "part"), "part", "left").select("tile", F.coalesce("root", "part").alias("root"))
    else:
        parts = parts.select("tile", F.col("part").alias("root"))
    numbers = numbered(parts.select("root").distinct(), "root", "component_id")
    return parts.join(numbers, "root").select("tile", "root", "component_id")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with ``name``, the place of its distinct ``key`` from 1: ranges are numbered side by side, and only their sizes meet in one task."""
    part, before = f"__part_{name}", f"__before_{name}"
    rows = saved(df.repartitionByRange(key).withColumn(part, F.spark_partition_id()))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(part, F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(part).orderBy(key)) + F.col(before)
    return rows.join(F.broadcast(starts), part).withColumn(name, place.cast("long")).drop(part, before)


def running_sum(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` up to and with its distinct ``key``: ranges are summed side by side, and only their sums meet
    in one task."""
    part, before = f"__part_{name}", f"__before_{name}"
    rows = saved(df.repartitionByRange(key).withColumn(part, F.spark_partition_id()))
    sums = rows.groupBy(part).agg(F.sum(value).alias("__n"))
    starts = sums.select(part, F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    upto = F.sum(value).over(Window.partitionBy(part).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) + F.col(before)
    return rows.join(F.broadcast(starts), part).withColumn(name, upto.cast("long")).drop(part, before)


def closure(seeds: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Nodes reachable from ``seeds(node)`` over ``edges(s, d)``: one semi-naive join a round on the component graph."""
    reached = saved(seeds.select("node").distinct())
    fresh = reached
    for _ in range(rounds):
        step = fresh.join(edges, F.col("node") == F.col("s")).select(F.col("d").alias("node")).distinct()
        fresh = saved(step.join(reached, "node", "left_anti"))
        if not fresh.limit(1).count():
            return reached
        reached = saved(reached.union(fresh))
    raise RuntimeError("closure did not settle")


def shortest_paths(edges: DataFrame, starts: DataFrame, *, per_tile: int = 2, region: int = 128, rounds: int = 1000) -> DataFrame:
    """``query_id, node, cost`` of every node reachable from a query's starts ``query_id, node`` over the state edges ``query_id, s, d, w``.

    A node is ``per_tile`` times a tile and a layer, or a negative number by itself. Regions of ``region`` squared tiles are solved by themselves,
    all side by side, from the costs that reached them; what leaves a region is the next round's start, and only regions that
    got a lower cost are solved again. A group is one region's edges, whatever the size of the world, and rounds count the
    regions that a shortest path enters.
    """

    def block(node):
        tile = F.floor(node / per_tile)
        return F.when(node < 0, node).otherwise(S.pack_tile(F.floor(S.tile_x(tile) / region), F.floor(S.tile_y(tile) / region), F.lit(0)))

    keyed = edges.select(F.col("query_id").cast("long").alias("query_id"), F.col("s").cast("long").alias("s"), F.col("d").cast("long").alias("d"), F.col("w").cast("long").alias("w"))
    keyed = saved(keyed.select("query_id", block(F.col("s")).alias("block"), block(F.col("d")).alias("to"), "s", "d", "w"))
    far = np.iinfo(np.int64).max // 4

    def relax(key, inside: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        s, d, w, stays = inside["s"].to_numpy(), inside["d"].to_numpy(), inside["w"].to_numpy(), inside["to"].to_numpy() == key[1]
        names = np.unique(np.concatenate([s, d[stays], rows["node"].to_numpy()]))
        before, cost = np.full(len(names), far), np.full(len(names), far)
        old = ~rows["fresh"].to_numpy(dtype=bool)
        np.minimum.at(before, np.searchsorted(names, rows["node"].to_numpy()[old]), rows["cost"].to_numpy()[old])
        np.minimum.at(cost, np.searchsorted(names, rows["node"].to_numpy()), rows["cost"].to_numpy())
        a, b, step = np.searchsorted(names, s), np.searchsorted(names, d[stays]), w[stays]
        inner = a[stays]
        live = cost < before  # nodes whose lower cost is still to go on
        while live.any():
            use = live[inner]
            new = cost.copy()
            np.minimum.at(new, b[use], cost[inner[use]] + step[use])
            live, cost = new < cost, new
        better = cost < before
        out = better[a] & ~stays
        return pd.DataFrame({
            "query_id": key[0], "block": np.concatenate([np.full(int(better.sum()), key[1]), inside["to"].to_numpy()[out]]), "node": np.concatenate([names[better], d[out]]),
            "cost": np.concatenate([cost[better], cost[a[out]] + w[out]]), "settled": np.repeat([True, False], [int(better.sum()), int(out.sum())]),
        })

    spark = edges.sparkSession
    fresh = starts.select(F.col("query_id").cast("long").alias("query_id"), block(F.col("node")).alias("block"), F.col("node").cast("long").alias("node"), F.lit(0).cast("long").alias("cost"))
    ddl = "query_id long, block long, node long, cost long, settled boolean"
    solved: list[DataFrame] = []

    def labels() -> DataFrame:
        rows = spark.createDataFrame([], ddl)
        for part in solved:
            rows = rows.union(part)
        return rows.where("settled").groupBy("query_id", "block", "node").agg(F.min("cost").alias("cost"))

    for n in range(rounds):
        if n % 8 == 7:  # few parts to read
            solved = [saved(labels().withColumn("settled", F.lit(True)).select("query_id", "block", "node", "cost", "settled"))]
        fresh = saved(fresh)
        if not fresh.limit(1).count():
            return labels().select("query_id", "node", "cost")
        touched = fresh.select("query_id", "block").distinct()
        known = labels().join(touched, ["query_id", "block"], "left_semi").withColumn("fresh", F.lit(False))
        rows = known.unionByName(fresh.withColumn("fresh", F.lit(True)))
        inside = keyed.join(touched, ["query_id", "block"], "left_semi")
        solved.append(saved(inside.groupBy("query_id", "block").cogroup(rows.groupBy("query_id", "block")).applyInPandas(relax, ddl)))
        sent = solved[-1].where("NOT settled").groupBy("query_id", "block", "node").agg(F.min("cost").alias("cost"))
        at = labels().withColumnRenamed("cost", "have")
        fresh = sent.join(at, ["query_id", "block", "node"], "left").where("have IS NULL OR cost < have").select("query_id", "block", "node", "cost")
    raise RuntimeError("paths did not settle")


def predecessors(edges: DataFrame, costs: DataFrame) -> DataFrame:
    """``query_id, node, prev, step, cost``: of the edges ``query_id, s, d, w, step`` that end a shortest path at ``node``, the one from the smallest
    ``prev``. Starts have none. Edges of cost 0 must not make a circle."""
    side = lambda n, c: costs.select("query_id", F.col("node").alias(n), F.col("cost").alias(c))
    tight = edges.join(side("s", "cs"), ["query_id", "s"]).join(side("d", "cost"), ["query_id", "d"]).where("cs + w = cost AND (w > 0 OR s <> d)")
    best = tight.groupBy("query_id", "d").agg(F.min(F.struct("s", "step", "cost")).alias("e"))
    return best.select("query_id", F.col("d").alias("node"), F.col("e.s").alias("prev"), "e.step", "e.cost")


def route_steps(prev: DataFrame, targets: DataFrame) -> DataFrame:
    """``query_id, target, step_no, step, node, cost`` of the routes to ``targets(query_id, target)``, in order from 1; activations are no steps of a
    route. Ancestors at all distances come by doubling, so rounds grow with the logarithm of the longest route."""
    prev = saved(prev)
    jump = prev.select("query_id", "node", F.col("prev").alias("up"))
    rows = targets.select("query_id", "target", F.col("target").alias("node"), F.lit(0).cast("long").alias("back"))
    reach = 1
    while jump.limit(1).count():
        rows = saved(rows.union(rows.join(jump, ["query_id", "node"]).select("query_id", "target", F.col("up").alias("node"), (F.col("back") + reach).alias("back"))))
        jump = saved(jump.join(jump.select("query_id", F.col("node").alias("up"), F.col("up").alias("top")), ["query_id", "up"]).select("query_id", "node", F.col("top").alias("up")))
        reach *= 2
    steps = rows.join(prev.drop("prev"), ["query_id", "node"]).where("step <> 'activate'")
    number = F.row_number().over(Window.partitionBy("query_id", "target").orderBy(F.desc("back")))
    return steps.select("query_id", "target", number.cast("long").alias("step_no"), "step", "node", "cost")


def walking_steps(flags: DataFrame, origins: DataFrame) -> DataFrame:
    """``s, d, kind`` of all steps of cost 1 over ``flags(tile, x, y, p, north, east)``: ``walk`` in the eight directions of each tile's mask; ``enter`` from
    a walkable tile over a side to one that is not walkable but an origin of transports ``origins(origin)``; ``exit`` from a tile that
    is not walkable to a walkable neighbour, over a corner only where both sides beside it are walkable."""
    ways = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # the mask's bits, clockwise from north
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for i, (dx, dy) in enumerate(ways)))
    # open sides as bits: own north and east, the north of the tile below, the east of the tile to the left
    masks = walk_masks(flags).join(flags.select("tile", "x", "y", "p"), "tile").withColumn("free", F.col("mask").bitwiseAND(F.lit(0b01010101)) != 0)
    masks = saved(masks.select("tile", "x", "y", "p", "mask", "free"))
    near = masks.withColumn("o", F.explode(offsets)).where("x + o.dx BETWEEN 0 AND 32767 AND y + o.dy BETWEEN 0 AND 32767")
    near = near.select(F.col("tile").alias("s"), "free", "mask", F.col("o.i").alias("i"), S.pack_tile(F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy"), F.col("p")).alias("d"))
    walk = near.where("free AND (mask & shiftleft(1, i)) <> 0").select("s", "d", F.lit("walk").alias("kind"))
    side = near.where("i % 2 = 0")
    shut = masks.where("NOT free").select(F.col("tile").alias("d")).join(origins.select(F.col("origin").alias("d")).distinct(), "d", "left_semi")
    enter = side.where("free").join(shut, "d").select("s", "d", F.lit("enter").alias("kind"))
    open_tiles = masks.where("free").select(F.col("tile").alias("d"))
    out = near.where("NOT free").join(open_tiles, "d").select("s", "d", "i")
    around = out.groupBy("s").agg(F.collect_set("i").alias("ways"))  # at most eight
    beside = lambda k: F.array_contains("ways", (F.col("i") + k) % 8)
    out = out.join(around, "s").where((F.col("i") % 2 == 0) | (beside(1) & beside(7))).select("s", "d", F.lit("exit").alias("kind"))
    return walk.union(enter).union(out)


def state_edges(walk: DataFrame, local: DataFrame, banks: DataFrame | None = None, tiles: DataFrame | None = None, globals_: DataFrame | None = None) -> DataFrame:
    """State graph ``s, d, w, step`` over (tile, banked) as 2 * tile + banked and over the abstract nodes -1 - (2 * level + banked):
    walking at cost 1, transports ``origin, destination, cost, banked``, banks at cost 0, activation at cost 0 where a tile's
    capability allows it, and globals ``destination, cost, level, banked`` (level 1: also usable from the wilderness)."""
    layers = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("b")
    out = walk.select("s", "d", layers).select((F.col("s") * 2 + F.col("b")).alias("s"), (F.col("d") * 2 + F.col("b")).alias("d"), F.lit(1).cast("long").alias("w"), F.lit("walk").alias("step"))
    out = out.union(local.select(F.col("origin") * 2 + F.col("banked"), F.col("destination") * 2 + F.col("banked"), "cost", F.lit("transport")))
    if banks is not None:
        out = out.union(banks.select(F.col("tile") * 2, F.col("tile") * 2 + 1, F.lit(0).cast("long"), F.lit("bank")))
    if globals_ is not None:
        cap = S.capability(F.col("x"), F.col("y"))
        level = F.when(cap == "AllGlobals", 0).when(cap == "WildernessGlobals", 1)
        act = tiles.select("tile", level.cast("long").alias("lv"), layers).where("lv IS NOT NULL")
        out = out.union(act.select(F.col("tile") * 2 + F.col("b"), -1 - (F.col("lv") * 2 + F.col("b")), F.lit(0).cast("long"), F.lit("activate")))
        uses = globals_.withColumn("lv", F.explode(F.when(F.col("level") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        out = out.union(uses.select((-1 - (F.col("lv") * 2 + F.col("banked"))).cast("long"), F.col("destination") * 2 + F.col("banked"), "cost", F.lit("global")))
    return out
