"""Reverse labels, lower bounds, component projections and reference checks; registers with the other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..sources import derived as D
from .queries import CC, CUT, START, TR, B, E, T, components, cut_edges, query, world

col = F.col

SQL_REVERSE = """e AS (SELECT d AS s, s AS d, CAST(1 AS BIGINT) AS w FROM walk UNION ALL SELECT destination, origin, duration FROM transports WHERE status = 'F' AND origin IN (SELECT tile FROM tiles) AND destination IN (SELECT tile FROM tiles)),
r(id, c) USING KEY (id) AS (SELECT tile, CAST(0 AS BIGINT) FROM start
  UNION (SELECT e.d, min(r.c + e.w) FROM r JOIN e ON e.s = r.id LEFT JOIN recurring.r k ON k.id = e.d WHERE k.id IS NULL OR r.c + e.w < k.c GROUP BY 1))"""
SQL_SEEDS = "sites AS (SELECT tile FROM start UNION SELECT tile FROM banks UNION SELECT origin FROM transports WHERE status = 'F' AND origin IS NOT NULL), seeds AS (SELECT r.id AS tile, comp.component_id, r.c AS cost FROM r JOIN sites ON sites.tile = r.id JOIN comp ON comp.tile = r.id)"
SQL_H = "h AS (SELECT t.tile, min(s.cost + greatest(abs(t.x - (s.tile & 32767)), abs(t.y - ((s.tile >> 15) & 32767)))) AS bound FROM tiles t JOIN comp c ON c.tile = t.tile JOIN seeds s ON s.component_id = c.component_id GROUP BY 1)"


def labelled(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tiles, components, least cost from every tile to the target (the smallest tile of the largest component), and the sites."""
    t = G.saved(D.tiles(spark, sf))
    walk = G.walk_edges(t)
    comp = G.saved(G.natural_components(t, walk))
    target = comp.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").limit(1).select(col("root").alias("tile"))
    tr = D.transports(spark, sf).where("status = 'F' AND origin IS NOT NULL")
    on = tr.join(t.select(col("tile").alias("origin")), "origin", "left_semi").join(t.select(col("tile").alias("destination")), "destination", "left_semi")
    back = walk.select(col("d").alias("s"), col("s").alias("d"), F.lit(1).cast("long").alias("w")).union(on.groupBy("destination", "origin").agg(F.min("duration")))
    starts = target.select(F.lit(0).cast("long").alias("query_id"), col("tile").alias("node"))
    labels = G.saved(G.shortest_paths(back.withColumn("query_id", F.lit(0).cast("long")), starts, per_tile=1).select(col("node").alias("tile"), "cost"))
    sites = target.union(D.banks(spark, sf).select("tile")).union(tr.select("origin")).distinct()
    return t, comp, labels, sites


def seed_rows(comp: DataFrame, labels: DataFrame, sites: DataFrame) -> DataFrame:
    return labels.join(sites, "tile", "left_semi").join(comp, "tile").select("tile", "component_id", "cost")


def bound_rows(t: DataFrame, comp: DataFrame, seeds: DataFrame) -> DataFrame:
    """Least seed cost plus Chebyshev distance within the component. The derived world has 64 by 64 tiles on two planes, which bounds a
    component's list of seeds."""
    held = seeds.groupBy("component_id").agg(F.collect_list(F.struct(S.tile_x(col("tile")).alias("x"), S.tile_y(col("tile")).alias("y"), "cost")).alias("seeds"))
    j = t.join(comp.select("tile", "component_id"), "tile").join(held, "component_id")
    return j.select("tile", F.array_min(F.transform("seeds", lambda s: s["cost"] + S.chebyshev_flat(col("x"), col("y"), s["x"], s["y"]))).alias("bound"))


@query(world(T, E, TR, CC, START, SQL_REVERSE, recursive=True) + "SELECT id AS tile, c AS cost FROM r")
def reverse_labels(spark, sf):
    return labelled(spark, sf)[2]


@query(world(T, E, TR, B, CC, START, SQL_REVERSE, SQL_SEEDS, recursive=True) + "SELECT tile, component_id, cost FROM seeds")
def heuristic_seeds(spark, sf):
    _, comp, labels, sites = labelled(spark, sf)
    return seed_rows(comp, labels, sites)


@query(world(T, E, TR, B, CC, START, SQL_REVERSE, SQL_SEEDS, SQL_H, recursive=True) + "SELECT tile, bound FROM h")
def heuristic_at(spark, sf):
    t, comp, labels, sites = labelled(spark, sf)
    return bound_rows(t, comp, seed_rows(comp, labels, sites))


@query(world(T, E, TR, B, CC, START, SQL_REVERSE, SQL_SEEDS, SQL_H, recursive=True) + "SELECT count(*) AS tiles, count(*) FILTER (WHERE bound > c) AS above, count(*) FILTER (WHERE bound = c) AS exact, count(*) FILTER (WHERE bound IS NULL) AS without FROM r LEFT JOIN h ON h.tile = r.id")
def heuristic_admissible(spark, sf):
    """No bound may exceed the true cost, and every tile with a cost has a bound: ``above`` and ``without`` count zero."""
    t, comp, labels, sites = labelled(spark, sf)
    j = labels.join(bound_rows(t, comp, seed_rows(comp, labels, sites)), "tile", "left")
    return j.agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.expr("bound > cost")).alias("above"), F.count_if(F.expr("bound = cost")).alias("exact"), F.count_if(F.expr("bound IS NULL")).alias("without"))


SQL_SITE = "local AS (SELECT origin AS s, destination AS d, min(duration) AS cost FROM transports WHERE origin IN (SELECT tile FROM tiles) AND destination IN (SELECT tile FROM tiles) GROUP BY 1, 2)"


@query(world(T, TR, B, SQL_SITE) + "SELECT s, d, b AS banked, 'local' AS kind, cost FROM local, (VALUES (0), (1)) l(b) UNION ALL SELECT tile, tile, 0, 'bank', 0 FROM banks")
def site_graph_edges(spark, sf):
    """Relaxed site graph: every transport in both layers, at its least duration, and one zero-cost bank edge a bank."""
    t = D.tiles(spark, sf)
    tr = D.transports(spark, sf).join(t.select(col("tile").alias("origin")), "origin", "left_semi").join(t.select(col("tile").alias("destination")), "destination", "left_semi")
    local = tr.groupBy("origin", "destination").agg(F.min("duration").alias("cost")).select(col("origin").alias("s"), col("destination").alias("d"), F.explode(F.array(F.lit(0), F.lit(1))).alias("banked"), F.lit("local").alias("kind"), "cost")
    return local.union(D.banks(spark, sf).select("tile", "tile", F.lit(0), F.lit("bank"), F.lit(0).cast("long")))


ROUTING = CC.replace("walk w", "cutwalk w").replace("cc(tile", f"cutwalk AS (SELECT * FROM walk WHERE {CUT}), cc(tile")


@query(world(T, E, ROUTING, "x AS (SELECT a.component_id AS a, b.component_id AS b FROM walk w JOIN comp a ON a.tile = w.s JOIN comp b ON b.tile = w.d WHERE (w.s & 32767) = 31 AND (w.d & 32767) = 32), ends AS (SELECT a AS id, b AS other FROM x UNION ALL SELECT b, a FROM x), n AS (SELECT component_id, count(*) AS tile_count FROM comp GROUP BY 1)", recursive=True) + "SELECT component_id, tile_count, count(other) AS separator_crossing_count, count(DISTINCT other) AS neighbouring_component_count FROM n LEFT JOIN ends ON ends.id = n.component_id GROUP BY 1, 2")
def routing_component_facts(spark, sf):
    t, e, cuts = cut_edges(spark, sf)
    c = G.saved(G.natural_components(t, e))
    x = cuts.join(c.select(col("tile").alias("s"), col("component_id").alias("a")), "s").join(c.select(col("tile").alias("d"), col("component_id").alias("b")), "d").select("a", "b")
    ends = x.union(x.select("b", "a")).toDF("component_id", "other").groupBy("component_id").agg(F.count("other").alias("k"), F.countDistinct("other").alias("m"))
    n = c.groupBy("component_id").agg(F.count(F.lit(1)).alias("tile_count"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return n.join(ends, "component_id", "left").select("component_id", "tile_count", zero(col("k")).alias("separator_crossing_count"), zero(col("m")).alias("neighbouring_component_count"))


@query("WITH o AS (SELECT user_id, event_type, min(value) AS best FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value = best) AS optimal, quantile_disc(value - best, 0.5) AS gap_p50, quantile_disc(value - best, 0.99) AS gap_p99 FROM events JOIN o USING (user_id, event_type) GROUP BY 1")
def bench_quality(spark, sf):
    e = D.table(spark, sf, "events")
    j = e.join(e.groupBy("user_id", "event_type").agg(F.min("value").alias("best")), ["user_id", "event_type"]).withColumn("gap", col("value") - col("best"))
    p = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY gap)").alias(a) for q, a in ((0.5, "gap_p50"), (0.99, "gap_p99"))]
    return j.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("value = best")).alias("optimal"), *p)


@query(world(T, E, TR, B) + "SELECT (SELECT count(*) FROM walk WHERE s = d) AS self_steps, (SELECT count(*) FROM walk WHERE s NOT IN (SELECT tile FROM tiles) OR d NOT IN (SELECT tile FROM tiles)) AS unknown_steps, (SELECT count(*) FROM banks WHERE tile NOT IN (SELECT tile FROM tiles)) AS unknown_banks, (SELECT count(*) FROM transports WHERE duration < 0) AS negative")
def dq_references(spark, sf):
    """Every step ends on known tiles, no step stays, banks stand on tiles, no transport has a negative duration."""
    t, e, tr = D.tiles(spark, sf), D.tiles(spark, sf).transform(G.walk_edges), D.transports(spark, sf)
    known = t.select("tile")
    lost = e.select(F.explode(F.array("s", "d")).alias("tile")).join(known, "tile", "left_anti").agg(F.count(F.lit(1)).alias("unknown_steps"))
    banks = D.banks(spark, sf).join(known, "tile", "left_anti").agg(F.count(F.lit(1)).alias("unknown_banks"))
    return e.agg(F.count_if(F.expr("s = d")).alias("self_steps")).join(lost).join(banks).join(tr.agg(F.count_if(F.expr("duration < 0")).alias("negative")))


@query(world(T, E, CC, recursive=True) + "SELECT tile, x, y, p, component_id FROM comp JOIN tiles USING (tile)")
def component_tiles(spark, sf):
    return components(spark, sf).select("tile", S.tile_x(col("tile")).alias("x"), S.tile_y(col("tile")).alias("y"), S.tile_plane(col("tile")).alias("p"), "component_id")
