"""Queries over a second derived world: all eight directions, walls, transports that start in walls, and the regions without globals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..sources import derived as D
from .queries import query, world

col = F.col

#: Left, bottom, width and height of the world: it reaches over the borders of the regions without some or all globals.
X0, Y0, WIDE, HIGH = 2936, 3668, 24, 104

SQL_W = f"""wall AS (SELECT DISTINCT {X0} + s_suppkey % {WIDE} AS x, {Y0} + (s_suppkey * 7) % {HIGH} AS y FROM supplier),
grid AS (SELECT CAST({X0} + i % {WIDE} AS BIGINT) AS x, CAST({Y0} + i // {WIDE} AS BIGINT) AS y FROM range({WIDE * HIGH}) r(i)),
f AS (SELECT g.x, g.y, g.x | (g.y << 15) AS tile, (g.x * 5 + g.y * 3) % 7 <> 0 AND g.y < {Y0 + HIGH - 1} AND a.x IS NULL AND b.x IS NULL AS n, (g.x * 3 + g.y) % 5 <> 0 AND g.x < {X0 + WIDE - 1} AND a.x IS NULL AND c.x IS NULL AS e
  FROM grid g LEFT JOIN wall a ON a.x = g.x AND a.y = g.y LEFT JOIN wall b ON b.x = g.x AND b.y = g.y + 1 LEFT JOIN wall c ON c.x = g.x + 1 AND c.y = g.y),
m AS (SELECT f.x, f.y, f.tile, f.n AS b0, f.n AND u.e AND f.e AND r.n AS b1, f.e AS b2, d.n AND d.e AND f.e AND dr.n AS b3, d.n AS b4, d.n AND dl.e AND l.e AND dl.n AS b5, l.e AS b6, f.n AND ul.e AND l.e AND l.n AS b7, coalesce(f.n OR f.e, false) OR coalesce(d.n, false) OR coalesce(l.e, false) AS free
  FROM f LEFT JOIN f u ON u.x = f.x AND u.y = f.y + 1 LEFT JOIN f r ON r.x = f.x + 1 AND r.y = f.y LEFT JOIN f d ON d.x = f.x AND d.y = f.y - 1 LEFT JOIN f l ON l.x = f.x - 1 AND l.y = f.y
  LEFT JOIN f dr ON dr.x = f.x + 1 AND dr.y = f.y - 1 LEFT JOIN f dl ON dl.x = f.x - 1 AND dl.y = f.y - 1 LEFT JOIN f ul ON ul.x = f.x - 1 AND ul.y = f.y + 1),
tr AS (SELECT ({X0} + p_partkey % {WIDE}) | (({Y0} + (p_partkey * 7) % {HIGH}) << 15) AS origin, ({X0} + (p_partkey * 5) % {WIDE}) | (({Y0} + (p_partkey * 11) % {HIGH}) << 15) AS destination, 1 + p_size % 9 AS duration, p_partkey % 3 = 0 AS carried FROM part),
steps AS (SELECT tile AS s, (x + dx) | ((y + dy) << 15) AS d, 'walk' AS kind FROM (SELECT tile, x, y, unnest([b0, b1, b2, b3, b4, b5, b6, b7]) AS ok, unnest([0, 1, 1, 1, 0, -1, -1, -1]) AS dx, unnest([1, 1, 0, -1, -1, -1, 0, 1]) AS dy FROM m WHERE free) WHERE ok
  UNION ALL SELECT a.tile, b.tile, 'enter' FROM m a JOIN m b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE a.free AND NOT b.free AND b.tile IN (SELECT origin FROM tr)
  UNION ALL SELECT a.tile, b.tile, 'exit' FROM m a JOIN m b ON greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1 LEFT JOIN m h ON h.x = b.x AND h.y = a.y LEFT JOIN m v ON v.x = a.x AND v.y = b.y WHERE NOT a.free AND b.free AND (a.x = b.x OR a.y = b.y OR (h.free AND v.free)))"""
SQL_CAP = "CASE WHEN x >= 2944 AND y >= 3760 THEN 2 WHEN x >= 2944 AND y >= 3680 THEN 1 ELSE 0 END"
SQL_E = f"""gl AS (SELECT ({X0} + (s_suppkey * 11) % {WIDE}) | (({Y0} + (s_suppkey * 3) % {HIGH}) << 15) AS destination, 20 + s_suppkey % 7 AS duration, (s_suppkey * 7) % 60 >= 30 AS wild, s_suppkey % 2 = 0 AS carried FROM supplier),
bk AS (SELECT DISTINCT ({X0} + (s_suppkey * 13) % {WIDE}) | (({Y0} + (s_suppkey * 17) % {HIGH}) << 15) AS tile FROM supplier WHERE s_suppkey % 10 = 3),
e AS (SELECT s * 2 + b AS s, d * 2 + b AS d, CAST(1 AS BIGINT) AS w FROM steps, (VALUES (0), (1)) l(b) WHERE kind <> 'enter' OR d IN (SELECT origin FROM tr WHERE carried OR b = 1)
  UNION ALL SELECT origin * 2 + b, destination * 2 + b, duration FROM tr, (VALUES (0), (1)) l(b) WHERE carried OR b = 1
  UNION ALL SELECT tile * 2, tile * 2 + 1, 0 FROM bk
  UNION ALL SELECT tile * 2 + b, -1 - ({SQL_CAP} * 2 + b), 0 FROM grid JOIN f USING (x, y), (VALUES (0), (1)) l(b) WHERE {SQL_CAP} < 2
  UNION ALL SELECT -1 - (lv * 2 + b), destination * 2 + b, duration FROM gl, (VALUES (0), (1)) l(b), (VALUES (0), (1)) c(lv) WHERE (carried OR b = 1) AND (lv = 0 OR wild)),
start AS (SELECT min(tile) AS tile FROM m WHERE free),
r(id, c) USING KEY (id) AS (SELECT tile * 2, CAST(0 AS BIGINT) FROM start
  UNION (SELECT e.d, min(r.c + e.w) FROM r JOIN e ON e.s = r.id LEFT JOIN recurring.r k ON k.id = e.d WHERE k.id IS NULL OR r.c + e.w < k.c GROUP BY 1))"""


def flags(spark, sf) -> DataFrame:
    """The whole grid with its open sides: a rule of the coordinates, but for walls, which shut all four sides."""
    k = col("s_suppkey")
    wall = D.table(spark, sf, "supplier").select((X0 + k % WIDE).alias("x"), (Y0 + k * 7 % HIGH).alias("y")).distinct()
    shut = wall.select(F.explode(F.array(*(F.struct((col("x") - dx).alias("x"), (col("y") - dy).alias("y"), F.lit(dx == 0).alias("n"), F.lit(dy == 0).alias("e")) for dx, dy in ((0, 0), (0, 1), (1, 0))))).alias("w"))
    shut = shut.select("w.*").groupBy("x", "y").agg(F.bool_or("n").alias("no_n"), F.bool_or("e").alias("no_e"))
    grid = spark.range(WIDE * HIGH).select((X0 + col("id") % WIDE).alias("x"), (Y0 + F.floor(col("id") / WIDE)).alias("y"), F.lit(0).cast("long").alias("p")).join(shut, ["x", "y"], "left")
    open_ = lambda c: ~F.coalesce(c, F.lit(False))
    north = ((col("x") * 5 + col("y") * 3) % 7 != 0) & (col("y") < Y0 + HIGH - 1) & open_(col("no_n"))
    east = ((col("x") * 3 + col("y")) % 5 != 0) & (col("x") < X0 + WIDE - 1) & open_(col("no_e"))
    return grid.select(S.pack_tile(col("x"), col("y"), col("p")).alias("tile"), "x", "y", "p", north.alias("north"), east.alias("east"))


def place(x, y):
    return S.pack_tile(X0 + x % WIDE, Y0 + y % HIGH, F.lit(0))


def transports(spark, sf) -> DataFrame:
    k = col("p_partkey")
    return D.table(spark, sf, "part").select(place(k, k * 7).alias("origin"), place(k * 5, k * 11).alias("destination"), (1 + col("p_size") % 9).cast("long").alias("duration"), (k % 3 == 0).alias("carried"))


def layers(carried):
    return F.explode(F.when(carried, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).cast("long")


def solved(spark, sf) -> tuple[DataFrame, DataFrame]:
    """State edges and costs from the smallest walkable tile: every rule of movement at once."""
    f = G.saved(flags(spark, sf))
    tr = transports(spark, sf)
    steps = G.saved(G.walking_steps(f, tr))
    both = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    local = tr.withColumn("banked", F.explode(F.when(col("carried"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))).groupBy("origin", "destination", "banked").agg(F.min("duration").alias("cost"))
    usable = local.select(col("origin").alias("d"), "banked").distinct()
    k = col("s_suppkey")
    supplier = D.table(spark, sf, "supplier")
    banks = supplier.where("s_suppkey % 10 = 3").select(place(k * 13, k * 17).alias("tile")).distinct()
    globals_ = supplier.select(place(k * 11, k * 3).alias("destination"), (20 + k % 7).cast("long").alias("cost"), F.when(k * 7 % 60 >= 30, 1).otherwise(0).alias("level"), F.explode(F.when(k % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("banked"))
    edges = G.state_edges(steps.where("kind <> 'enter'").select("s", "d"), local.select("origin", "destination", "cost", "banked"), banks, f, globals_.groupBy("destination", "level", "banked").agg(F.min("cost").alias("cost")))
    enter = steps.where("kind = 'enter'").select("s", "d", both.alias("banked")).join(usable, ["d", "banked"], "left_semi")
    edges = edges.union(enter.select(col("s") * 2 + col("banked"), col("d") * 2 + col("banked"), F.lit(1).cast("long"), F.lit("walk")))
    edges = G.saved(edges.withColumn("query_id", F.lit(0).cast("long")))
    start = steps.where("kind <> 'exit'").agg(F.min("s").alias("tile")).select(F.lit(0).cast("long").alias("query_id"), (col("tile") * 2).alias("node")).where("node IS NOT NULL")
    return edges, G.shortest_paths(edges, start)


@query(world(SQL_W) + "SELECT s, d, kind FROM steps")
def walking_steps(spark, sf):
    """Eight ways by masks, steps into origins in walls, steps out of walls."""
    return G.walking_steps(flags(spark, sf), transports(spark, sf))


@query(world(SQL_W, SQL_E, recursive=True) + "SELECT id // 2 AS tile, id % 2 AS banked, c AS cost FROM r WHERE id >= 0")
def sp_movement_cost(spark, sf):
    """Costs of all states under the whole movement rule: walls, banking, and globals that depend on where they are used."""
    return solved(spark, sf)[1].where("node >= 0").select(F.expr("node DIV 2").alias("tile"), (col("node") % 2).alias("banked"), "cost")


@query(world(SQL_W, SQL_E, recursive=True) + f"SELECT {SQL_CAP} AS capability, count(*) AS tiles, CAST(sum(free) AS BIGINT) AS walkable, count(c) AS reached, max(c) AS furthest FROM (SELECT x, y, CASE WHEN free THEN 1 ELSE 0 END AS free, min(r.c) AS c FROM m LEFT JOIN r ON r.id // 2 = m.tile AND r.id >= 0 GROUP BY x, y, free) GROUP BY 1")
def sp_capability_regions(spark, sf):
    """What is reached, by the globals that a tile may use (0 all, 1 some, 2 none)."""
    f = flags(spark, sf)
    free = G.walk_masks(f).where("mask & 85 <> 0").select("tile").withColumn("free", F.lit(1))
    best = solved(spark, sf)[1].where("node >= 0").groupBy(F.expr("node DIV 2").alias("tile")).agg(F.min("cost").alias("c"))
    name = S.capability(col("x"), col("y"))
    j = f.select("tile", F.when(name == "NoGlobals", 2).when(name == "WildernessGlobals", 1).otherwise(0).alias("capability")).join(free, "tile", "left").join(best, "tile", "left")
    return j.groupBy("capability").agg(F.count(F.lit(1)).alias("tiles"), F.count("free").alias("walkable"), F.count("c").alias("reached"), F.max("c").alias("furthest"))
