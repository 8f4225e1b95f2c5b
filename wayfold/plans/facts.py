"""Queries of facts about points, places, sites and corpora, and checks of tables against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..sources import derived as D
from .bounds import SQL_H, SQL_REVERSE, SQL_SEEDS, bound_rows, labelled, seed_rows
from .queries import CC, SQL_ACCESS, SQL_CLOSE, START, TR, B, E, T, access_rows, components, query, reachable_ids, world

col = F.col
SQL_SITES = "sites AS (SELECT tile FROM banks UNION SELECT origin FROM transports WHERE status = 'F' AND origin IN (SELECT tile FROM tiles))"
SQL_ASKED = "asked AS (SELECT DISTINCT p_partkey % 70 AS x, (p_partkey * 5) % 70 AS y, p_partkey % 2 AS p FROM part)"


def asked_points(spark, sf) -> DataFrame:
    k = col("p_partkey")
    return D.table(spark, sf, "part").select((k % 70).alias("x"), (k * 5 % 70).alias("y"), (k % 2).alias("p")).distinct()


def located(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components, access rows with reachability, and reachable component ids."""
    comp = G.saved(components(spark, sf))
    ok = G.saved(reachable_ids(spark, sf, comp).select(col("node").alias("component_id"), F.lit(True).alias("good")))
    return comp, access_rows(spark, sf, comp)[1].join(ok, "component_id", "left").withColumn("good", F.coalesce("good", F.lit(False))), ok


@query(world(T, E, TR, B, CC, SQL_CLOSE, SQL_ACCESS, SQL_ASKED, """a AS (SELECT x, y, p, bool_or(component_id IN (SELECT id FROM reach)) AS reachable, array_to_string(list(DISTINCT component_id ORDER BY component_id), ',') AS component_ids, CASE WHEN count(DISTINCT component_id) > 1 THEN 'ambiguous/multiple_components' WHEN bool_or(component_id IN (SELECT id FROM reach)) THEN 'reachable' ELSE 'unreachable_component' END AS status FROM access WHERE (x + y) % 3 <> 0 GROUP BY x, y, p),
t AS (SELECT x, y, p, component_id IN (SELECT id FROM reach) AS reachable, CAST(component_id AS VARCHAR) AS component_ids, CASE WHEN component_id IN (SELECT id FROM reach) THEN 'reachable' ELSE 'unreachable_component' END AS status FROM tiles JOIN comp USING (tile))""", recursive=True)
 + "SELECT q.x, q.y, q.p, coalesce(a.reachable, t.reachable, false) AS reachable, coalesce(a.component_ids, t.component_ids, '') AS component_ids, coalesce(a.status, t.status, 'unresolved') AS status FROM asked q LEFT JOIN a USING (x, y, p) LEFT JOIN t USING (x, y, p)")
def classify_points(spark, sf):
    """Status and components of asked points: from the points' access rows first, else from the tile itself."""
    comp, access, ok = located(spark, sf)
    status = lambda many, good: F.when(many, "ambiguous/multiple_components").when(good, "reachable").otherwise("unreachable_component")
    ids = F.sort_array(F.collect_set("component_id"))
    a = access.where("(x + y) % 3 <> 0").groupBy("x", "y", "p").agg(F.bool_or("good").alias("ar"), F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ai"), F.size(ids).alias("n"))
    a = a.select("x", "y", "p", "ar", "ai", status(col("n") > 1, col("ar")).alias("as"))
    t = comp.join(ok, "component_id", "left").select(S.tile_x(col("tile")).alias("x"), S.tile_y(col("tile")).alias("y"), S.tile_plane(col("tile")).alias("p"), F.coalesce("good", F.lit(False)).alias("tr"), col("component_id").cast("string").alias("ti"))
    t = t.withColumn("ts", status(F.lit(False), col("tr")))
    j = asked_points(spark, sf).join(a, ["x", "y", "p"], "left").join(t, ["x", "y", "p"], "left")
    return j.select("x", "y", "p", F.coalesce("ar", "tr", F.lit(False)).alias("reachable"), F.coalesce("ai", "ti", F.lit("")).alias("component_ids"), F.coalesce("as", "ts", F.lit("unresolved")).alias("status"))


@query(world(T, E, TR, CC, SQL_ACCESS, recursive=True) + "SELECT x, y, p, a.component_id, coalesce(a.resolved, q.x | (q.y << 15) | (q.p << 30)) AS resolved, CASE WHEN a.component_id IS NULL THEN 'unresolved' WHEN a.access_kind = 'walkable' THEN 'walkable' WHEN q.x | (q.y << 15) | (q.p << 30) IN (SELECT origin FROM transports WHERE origin IS NOT NULL) THEN 'adjacent_transport_origin' ELSE 'snapped' END AS access_kind FROM points q LEFT JOIN access a USING (x, y, p)")
def point_access(spark, sf):
    """One row a point and attachment: on the tile, from a transport's origin in a wall, or snapped; points without any are kept."""
    points, found = access_rows(spark, sf, components(spark, sf))
    origins = D.transports(spark, sf).where("origin IS NOT NULL").select(col("origin").alias("own"), F.lit(True).alias("starts")).distinct()
    j = points.withColumn("own", S.pack_tile(col("x"), col("y"), col("p"))).join(found, ["x", "y", "p"], "left").join(origins, "own", "left")
    kind = F.when(col("component_id").isNull(), "unresolved").when(col("access_kind") == "walkable", "walkable").when(col("starts"), "adjacent_transport_origin").otherwise("snapped")
    return j.select("x", "y", "p", "component_id", F.coalesce("resolved", "own").alias("resolved"), kind.alias("access_kind"))


CUT_COMP = "rcc(tile, root) USING KEY (tile) AS (SELECT tile, tile FROM tiles UNION (SELECT w.d, min(c.root) FROM rcc c JOIN walk w ON w.s = c.tile AND NOT (((w.s & 32767) = 31 AND (w.d & 32767) = 32) OR ((w.s & 32767) = 32 AND (w.d & 32767) = 31)) JOIN recurring.rcc k ON k.tile = w.d WHERE c.root < k.root GROUP BY w.d)), rcomp AS (SELECT tile, dense_rank() OVER (ORDER BY root) AS routing_id FROM rcc)"


@query(world(T, E, TR, B, CC, SQL_CLOSE, SQL_ACCESS, CUT_COMP, recursive=True) + "SELECT DISTINCT x, y, p, routing_id FROM access a JOIN rcomp ON rcomp.tile = a.resolved WHERE a.component_id IN (SELECT id FROM reach)")
def routing_attachments(spark, sf):
    """Routing components of every point's reachable attachments."""
    from .queries import cut_edges

    _, access, _ = located(spark, sf)
    t, e, _ = cut_edges(spark, sf)
    routing = G.natural_components(t, e).select(col("tile").alias("resolved"), col("component_id").alias("routing_id"))
    return access.where("good").join(routing, "resolved").select("x", "y", "p", "routing_id").distinct()


RADIUS = 12
SQL_RESOLVE = f"""cand AS (SELECT x, y, p, resolved & 32767 AS tx, (resolved >> 15) & 32767 AS ty, component_id, 1 AS priority FROM asked JOIN access USING (x, y, p) WHERE component_id IN (SELECT id FROM reach)
  UNION ALL SELECT q.x, q.y, q.p, t.x, t.y, c.component_id, CASE WHEN t.x = q.x AND t.y = q.y THEN 0 ELSE 2 END FROM asked q JOIN tiles t ON t.p = q.p AND t.x BETWEEN q.x - {RADIUS} AND q.x + {RADIUS} AND t.y BETWEEN q.y - {RADIUS} AND q.y + {RADIUS} JOIN comp c ON c.tile = t.tile WHERE c.component_id IN (SELECT id FROM reach)),
d AS (SELECT *, greatest(abs(tx - x), abs(ty - y)) AS distance, abs(tx - x) + abs(ty - y) AS manhattan FROM cand),
n AS (SELECT *, row_number() OVER (PARTITION BY x, y, p ORDER BY priority, distance, manhattan, tx, ty, component_id) AS k, rank() OVER (PARTITION BY x, y, p ORDER BY priority, distance) AS g FROM d)"""


@query(world(T, E, TR, B, CC, SQL_CLOSE, SQL_ACCESS, SQL_ASKED, SQL_RESOLVE, recursive=True) + "SELECT q.x, q.y, q.p, max(CASE WHEN k = 1 THEN tx END) AS resolved_x, max(CASE WHEN k = 1 THEN ty END) AS resolved_y, max(CASE WHEN k = 1 THEN distance END) AS distance, CASE WHEN count(k) = 0 THEN 'unresolved' WHEN count(DISTINCT component_id) FILTER (WHERE g = 1) > 1 THEN 'ambiguous' WHEN min(priority) = 0 THEN 'exact' WHEN min(priority) = 1 THEN 'point_access' ELSE 'nearest_reachable' END AS method, coalesce(array_to_string(list(DISTINCT component_id ORDER BY component_id) FILTER (WHERE g = 1), ','), '') AS component_ids, count(*) FILTER (WHERE g = 1) AS ties FROM asked q LEFT JOIN n USING (x, y, p) GROUP BY q.x, q.y, q.p")
def resolve_points(spark, sf):
    """Each asked point's best reachable tile: itself, then its access row, then the nearest within 12; ties of several components are
    ambiguous. Grid buckets make the range join an equal one."""
    comp, access, ok = located(spark, sf)
    asked = asked_points(spark, sf)
    size = 2 * RADIUS + 1
    bucket = lambda c: F.floor(c / size)
    sees = asked.withColumn("bx", F.explode(F.sequence(bucket(col("x") - RADIUS), bucket(col("x") + RADIUS)))).withColumn("by", F.explode(F.sequence(bucket(col("y") - RADIUS), bucket(col("y") + RADIUS))))
    good = comp.join(ok, "component_id", "left_semi").select("component_id", S.tile_x(col("tile")).alias("tx"), S.tile_y(col("tile")).alias("ty"), S.tile_plane(col("tile")).alias("p"))
    near = sees.join(good.withColumn("bx", bucket(col("tx"))).withColumn("by", bucket(col("ty"))), ["p", "bx", "by"]).where(S.chebyshev_flat(col("tx"), col("ty"), col("x"), col("y")) <= RADIUS)
    near = near.select("x", "y", "p", "tx", "ty", "component_id", F.when((col("tx") == col("x")) & (col("ty") == col("y")), 0).otherwise(2).alias("priority"))
    own = access.where("good").join(asked, ["x", "y", "p"]).select("x", "y", "p", S.tile_x(col("resolved")).alias("tx"), S.tile_y(col("resolved")).alias("ty"), "component_id", F.lit(1).alias("priority"))
    c = near.union(own).withColumn("distance", S.chebyshev_flat(col("tx"), col("ty"), col("x"), col("y"))).withColumn("manhattan", F.abs(col("tx") - col("x")) + F.abs(col("ty") - col("y")))
    # partial minima instead of sorted windows: the best candidate, then what ties with it
    best = c.groupBy("x", "y", "p").agg(F.min(F.struct("priority", "distance", "manhattan", "tx", "ty")).alias("b"))
    tied = c.groupBy("x", "y", "p", "priority", "distance").agg(F.sort_array(F.collect_set("component_id")).alias("ids"), F.count(F.lit(1)).alias("ties"))
    j = asked.join(best, ["x", "y", "p"], "left").select("*", col("b.priority").alias("priority"), col("b.distance").alias("distance")).join(tied, ["x", "y", "p", "priority", "distance"], "left")
    method = F.when(col("b").isNull(), "unresolved").when(F.size("ids") > 1, "ambiguous").when(col("priority") == 0, "exact").when(col("priority") == 1, "point_access").otherwise("nearest_reachable")
    return j.select("x", "y", "p", col("b.tx").alias("resolved_x"), col("b.ty").alias("resolved_y"), "distance", method.alias("method"), F.coalesce(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), F.lit("")).alias("component_ids"), F.coalesce("ties", F.lit(0)).cast("long").alias("ties"))


SQL_PLACES = "rows AS (SELECT 'routes' AS source, lower(c_mktsegment) AS name, c_custkey % 40 AS x, (c_custkey * 3) % 40 AS y, c_custkey AS ord, c_nationkey AS kind FROM customer UNION ALL SELECT 'gps', lower(p_brand), p_partkey % 40, (p_partkey * 3) % 40, p_partkey, p_size FROM part), places AS (SELECT concat_ws('|', source, name, concat(x, '/', y, '/0')) AS id, source, name, x, y, max({'o': ord, 'k': kind}).k AS kind FROM rows GROUP BY ALL)"


def place_rows(spark, sf) -> DataFrame:
    c, p = col("c_custkey"), col("p_partkey")
    rows = D.table(spark, sf, "customer").select(F.lit("routes").alias("source"), F.lower("c_mktsegment").alias("name"), (c % 40).alias("x"), (c * 3 % 40).alias("y"), c.alias("ord"), col("c_nationkey").cast("long").alias("kind"))
    rows = rows.union(D.table(spark, sf, "part").select(F.lit("gps"), F.lower("p_brand"), p % 40, p * 3 % 40, p, col("p_size").cast("long")))
    return rows.groupBy(F.concat_ws("|", "source", "name", S.coordinate_text(col("x"), col("y"), F.lit(0))).alias("id"), "source", "name", "x", "y").agg(F.max_by("kind", "ord").alias("kind"))


@query(world(SQL_PLACES) + "SELECT id, source, name, x, y, CAST(kind AS BIGINT) AS kind FROM places")
def places(spark, sf):
    """Places of two sources under one id of source, name and coordinate; of several rows the last one counts."""
    return place_rows(spark, sf)


@query(world(T, E, TR, B, CC, SQL_CLOSE, SQL_PLACES, "s AS (SELECT q.id, q.name, coalesce(bool_or(c.component_id IN (SELECT id FROM reach)), false) AS ok, count(c.component_id) AS n FROM places q LEFT JOIN comp c ON c.tile = (q.x | (q.y << 15)) GROUP BY 1, 2)", recursive=True) + "SELECT count(*) AS places, count(*) FILTER (WHERE ok) AS reachable, count(*) FILTER (WHERE NOT ok AND n = 0) AS unresolved, count(*) FILTER (WHERE NOT ok AND n > 0) AS unreachable, count(*) FILTER (WHERE regexp_matches(name, 'sea|ocean|strait|bay|atoll|coast|passage|brand#1')) AS water_like FROM s")
def place_report(spark, sf):
    """The console report's rule: reachable if any attachment is, before anything else; and names that sound like water."""
    comp, _, ok = located(spark, sf)
    q = place_rows(spark, sf).withColumn("tile", S.pack_tile(col("x"), col("y"), F.lit(0)))
    s = q.join(comp.select("tile", "component_id").join(ok, "component_id", "left"), "tile", "left").groupBy("id", "name").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("ok"), F.count("component_id").alias("n"))
    water = col("name").rlike("sea|ocean|strait|bay|atoll|coast|passage|brand#1")
    return s.agg(F.count(F.lit(1)).alias("places"), F.count_if(col("ok")).alias("reachable"), F.count_if(F.expr("NOT ok AND n = 0")).alias("unresolved"), F.count_if(F.expr("NOT ok AND n > 0")).alias("unreachable"), F.count_if(water).alias("water_like"))


def site_rows(spark, sf, comp: DataFrame) -> DataFrame:
    tr = D.transports(spark, sf).where("status = 'F'").select(col("origin").alias("tile"))
    return D.banks(spark, sf).select("tile").union(tr).distinct().join(comp.select("tile", "component_id"), "tile")


@query(world(T, E, TR, B, CC, SQL_SITES, recursive=True) + "SELECT component_id, count(*) AS sites, min(tile) AS first_site, max(tile) AS last_site FROM sites JOIN comp USING (tile) GROUP BY 1")
def component_sites(spark, sf):
    """Static sites (banks and transport origins) of every component."""
    s = site_rows(spark, sf, components(spark, sf))
    return s.groupBy("component_id").agg(F.count(F.lit(1)).alias("sites"), F.min("tile").alias("first_site"), F.max("tile").alias("last_site"))


@query(world(T, E, B, CC, recursive=True) + "SELECT a.tile AS s, b.tile AS d, greatest(abs((a.tile & 32767) - (b.tile & 32767)), abs(((a.tile >> 15) & 32767) - ((b.tile >> 15) & 32767))) AS cost, 2 * greatest(abs((a.tile & 32767) - (b.tile & 32767)), abs(((a.tile >> 15) & 32767) - ((b.tile >> 15) & 32767))) AS doubled FROM banks x JOIN comp a USING (tile) JOIN comp b ON b.component_id = a.component_id AND b.tile <> a.tile WHERE b.tile IN (SELECT tile FROM banks)")
def bank_cliques(spark, sf):
    """Banks of one component with each other and their Chebyshev distance, plain and doubled."""
    c = G.saved(components(spark, sf).join(D.banks(spark, sf), "tile").select("tile", "component_id"))
    j = c.select(col("tile").alias("s"), "component_id").join(c.select(col("tile").alias("d"), "component_id"), "component_id").where("s <> d")
    cost = S.chebyshev_flat(S.tile_x(col("s")), S.tile_y(col("s")), S.tile_x(col("d")), S.tile_y(col("d")))
    return j.select("s", "d", cost.alias("cost"), (2 * cost).alias("doubled"))


@query(world(T, E, B, CC, SQL_ACCESS, recursive=True) + "SELECT x, y, p, c.tile AS site, min(a.component_id) AS component_id FROM access a JOIN comp c ON c.component_id = a.component_id JOIN banks ON banks.tile = c.tile GROUP BY 1, 2, 3, 4")
def target_attachments(spark, sf):
    """Sites that share a component with a target point, each once, by the first shared component."""
    comp = G.saved(components(spark, sf))
    found = access_rows(spark, sf, comp)[1].select("x", "y", "p", "component_id")
    sites = comp.join(D.banks(spark, sf), "tile").select(col("tile").alias("site"), "component_id")
    return found.join(sites, "component_id").groupBy("x", "y", "p", "site").agg(F.min("component_id").alias("component_id"))


SQL_KEPT = "kept AS (SELECT s.* FROM seeds s WHERE NOT EXISTS (SELECT 1 FROM seeds o WHERE o.component_id = s.component_id AND o.tile <> s.tile AND o.cost < s.cost AND o.cost + greatest(abs((o.tile & 32767) - (s.tile & 32767)), abs(((o.tile >> 15) & 32767) - ((s.tile >> 15) & 32767))) <= s.cost))"


def generator_rows(seeds: DataFrame) -> DataFrame:
    """Seeds that no cheaper seed of their component reaches at their own cost; bounds over them equal bounds over all."""
    o = seeds.select("component_id", col("tile").alias("o"), col("cost").alias("oc"))
    far = S.chebyshev_flat(S.tile_x(col("tile")), S.tile_y(col("tile")), S.tile_x(col("o")), S.tile_y(col("o")))
    lost = seeds.join(o, "component_id").where((col("oc") < col("cost")) & (col("oc") + far <= col("cost"))).select("tile").distinct()
    return seeds.join(lost, "tile", "left_anti")


@query(world(T, E, TR, B, CC, START, SQL_REVERSE, SQL_SEEDS, SQL_KEPT, recursive=True) + "SELECT tile, component_id, cost FROM kept")
def heuristic_generators(spark, sf):
    _, comp, labels, sites = labelled(spark, sf)
    return generator_rows(G.saved(seed_rows(comp, labels, sites)))


@query(world(T, E, TR, B, CC, START, SQL_REVERSE, SQL_SEEDS, SQL_KEPT, "n AS (SELECT component_id, count(*) AS seeds, count(k.tile) AS generators FROM seeds s LEFT JOIN kept k USING (component_id, tile) GROUP BY 1)", recursive=True) + "SELECT CAST(sum(seeds) AS BIGINT) AS seeds, CAST(sum(generators) AS BIGINT) AS generators, count(*) AS components, max(seeds) AS most_seeds, quantile_disc(seeds, 0.5) AS seeds_p50, quantile_disc(seeds, 0.99) AS seeds_p99, round(quantile_disc(generators / seeds, 0.5), 6) AS ratio_p50, round(max(generators / seeds), 6) AS ratio_max FROM n")
def seed_stats(spark, sf):
    """Sizes of the seed tables and of what is left of them."""
    _, comp, labels, sites = labelled(spark, sf)
    seeds = G.saved(seed_rows(comp, labels, sites))
    kept = generator_rows(seeds).select("tile", F.lit(1).alias("k"))
    n = seeds.join(kept, "tile", "left").groupBy("component_id").agg(F.count(F.lit(1)).alias("seeds"), F.count("k").alias("generators")).withColumn("ratio", col("generators") / col("seeds"))
    p = lambda c, q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})")
    return n.agg(F.sum("seeds").alias("seeds"), F.sum("generators").alias("generators"), F.count(F.lit(1)).alias("components"), F.max("seeds").alias("most_seeds"), p("seeds", 0.5).cast("long").alias("seeds_p50"), p("seeds", 0.99).cast("long").alias("seeds_p99"), F.round(p("ratio", 0.5), 6).alias("ratio_p50"), F.round(F.max("ratio"), 6).alias("ratio_max"))


@query(world(T, E, TR, B, CC, START, SQL_REVERSE, SQL_SEEDS, SQL_H, recursive=True) + "SELECT max_level >= 30 AS wild, min(duration + bound) AS bound, count(*) AS usable FROM transports JOIN h ON h.tile = destination WHERE origin IS NULL GROUP BY 1")
def global_bound(spark, sf):
    """Least cost to the target over the globals: their own cost and the bound of where they lead."""
    t, comp, labels, sites = labelled(spark, sf)
    h = bound_rows(t, comp, seed_rows(comp, labels, sites)).select(col("tile").alias("destination"), "bound")
    g = D.transports(spark, sf).where("origin IS NULL").join(h, "destination")
    return g.groupBy((col("max_level") >= 30).alias("wild")).agg(F.min(col("duration") + col("bound")).alias("bound"), F.count(F.lit(1)).alias("usable"))


@query(world(T, E, TR, B, CC, START, SQL_REVERSE, SQL_SEEDS, SQL_ASKED, recursive=True) + "SELECT CASE WHEN c.tile IS NULL THEN 'unknown_component' WHEN s.component_id IS NULL THEN 'no_reverse_seed' ELSE 'searchable' END AS reason, count(*) AS points FROM asked q LEFT JOIN comp c ON c.tile = q.x | (q.y << 15) | (q.p << 30) LEFT JOIN (SELECT DISTINCT component_id FROM seeds) s ON s.component_id = c.component_id GROUP BY 1")
def prune_split(spark, sf):
    """Why a search may stop at a point: no component there, or none of its component's sites leads to the target."""
    _, comp, labels, sites = labelled(spark, sf)
    seeded = seed_rows(comp, labels, sites).select("component_id").distinct().withColumn("s", F.lit(1))
    q = asked_points(spark, sf).select(S.pack_tile(col("x"), col("y"), col("p")).alias("tile"))
    j = q.join(comp.select("tile", "component_id"), "tile", "left").join(seeded, "component_id", "left")
    reason = F.when(col("component_id").isNull(), "unknown_component").when(col("s").isNull(), "no_reverse_seed").otherwise("searchable")
    return j.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("points"))


@query("SELECT s_suppkey AS route, p.profile, s_suppkey % 3 AS tier FROM supplier, (VALUES ('early', 0), ('mid', 1), ('end', 2), ('maxed', 3)) p(profile, k) WHERE s_suppkey % 3 IN (0, 2) AND s_suppkey % 5 <> p.k")
def corpus_profiles(spark, sf):
    """Every route of a tier with every profile, but for the profiles that a route names as negative."""
    names = F.array(*(F.struct(F.lit(n).alias("profile"), F.lit(i).alias("k")) for i, n in enumerate(("early", "mid", "end", "maxed"))))
    r = D.table(spark, sf, "supplier").where("s_suppkey % 3 IN (0, 2)").select(col("s_suppkey").alias("route"), (col("s_suppkey") % 3).alias("tier"), F.explode(names).alias("p"))
    return r.where("route % 5 <> p.k").select("route", "p.profile", "tier")


@query(world(TR, "r AS (SELECT type AS category, origin, destination FROM transports WHERE origin IS NOT NULL)", "u AS (SELECT DISTINCT origin, destination FROM r)") + "SELECT category, count(*) AS routes, round(count(*) FILTER (WHERE (r.origin & 32767) % 9 = 0) / count(*), 6) AS bank_share, round(count(*) FILTER (WHERE (r.origin & 32767) % 9 = 0) / count(*), 6) <= 0.15 AS banks_ok, count(u.origin) AS both_ways FROM r LEFT JOIN u ON u.origin = r.destination AND u.destination = r.origin GROUP BY 1")
def corpus_shares(spark, sf):
    """Shares of a corpus by category against their limit, and routes whose way back is a route too."""
    r = D.transports(spark, sf).where("origin IS NOT NULL").select(col("type").alias("category"), "origin", "destination")
    back = r.select(col("destination").alias("origin"), col("origin").alias("destination"), F.lit(1).alias("back")).distinct()
    share = F.round(F.count_if(S.tile_x(col("origin")) % 9 == 0) / F.count(F.lit(1)), 6)
    return r.join(back, ["origin", "destination"], "left").groupBy("category").agg(F.count(F.lit(1)).alias("routes"), share.alias("bank_share"), (share <= 0.15).alias("banks_ok"), F.count("back").alias("both_ways"))


@query("WITH c AS (SELECT p_brand AS lost, p_partkey AS candidate, p_size AS uses, CASE WHEN p_size % 4 = 0 AND p_partkey % 3 = 0 THEN 1 WHEN p_size % 4 = 0 THEN 2 WHEN p_partkey % 3 = 0 THEN 3 ELSE 4 END AS rule FROM part) SELECT lost, candidate, rule, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY lost ORDER BY uses, candidate) AS k FROM c WHERE rule = (SELECT min(rule) FROM c d WHERE d.lost = c.lost)) WHERE k <= 4")
def replacement_choice(spark, sf):
    """Up to four replacements for each lost place: by the strictest of four relaxing rules that finds any, the least used first."""
    a, b = col("p_size") % 4 == 0, col("p_partkey") % 3 == 0
    c = D.table(spark, sf, "part").select(col("p_brand").alias("lost"), col("p_partkey").alias("candidate"), col("p_size").alias("uses"), F.when(a & b, 1).when(a, 2).when(b, 3).otherwise(4).alias("rule"))
    first = c.groupBy("lost").agg(F.min("rule").alias("rule"))
    w = Window.partitionBy("lost").orderBy("uses", "candidate")
    return c.join(first, ["lost", "rule"]).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 4").select("lost", "candidate", "rule", "place")


@query("SELECT p_brand, p_partkey, i FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE i IN (0, n // 3, n // 2, n - 1)")
def sample_rows(spark, sf):
    """The first, the third's, the middle and the last row of every sorted list."""
    p = D.table(spark, sf, "part")
    w = Window.partitionBy("p_brand")
    r = p.select("p_brand", "p_partkey", (F.row_number().over(w.orderBy("p_partkey")) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return r.where("i IN (0, n DIV 3, n DIV 2, n - 1)").select("p_brand", "p_partkey", "i")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def limited_rows(spark, sf):
    """The first rows of an order (a limit that is asked for)."""
    return D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT o_custkey AS run, count(*) AS states, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) // nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS ns_per_state, round(count(*) / nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0), 6) AS bytes_per_state FROM orders GROUP BY 1")
def bench_rates(spark, sf):
    """Rates of a run; null where a run has no states to divide by."""
    n = lambda s: F.nullif(F.count_if(col("o_orderstatus") == s), F.lit(0).cast("long"))
    return D.table(spark, sf, "orders").groupBy(col("o_custkey").alias("run")).agg(F.count(F.lit(1)).alias("states"), F.floor(F.sum(F.floor("o_totalprice")) / n("F")).alias("ns_per_state"), F.round(F.count(F.lit(1)) / n("O"), 6).alias("bytes_per_state"))


SQL_CUTS = "cuts AS (SELECT p_partkey AS id, (p_partkey % 64) | (((p_partkey * 3) % 64) << 15) AS a, ((p_partkey + p_partkey % 3) % 64) | (((p_partkey * 3 + p_partkey % 2) % 64) << 15) AS b FROM part)"


@query(world(T, E, CC, SQL_CUTS, recursive=True) + """SELECT c.id, CASE WHEN count(*) OVER (PARTITION BY least(c.a, c.b), greatest(c.a, c.b)) > 1 THEN 'duplicate' WHEN c.a = c.b THEN 'self edge' WHEN w.s IS NULL THEN 'not a walking edge' WHEN x.component_id IS NULL THEN 'endpoint is not a walking tile' WHEN x.component_id <> y.component_id THEN 'crosses natural components' ELSE 'ok' END AS verdict
FROM cuts c LEFT JOIN walk w ON w.s = c.a AND w.d = c.b LEFT JOIN comp x ON x.tile = c.a LEFT JOIN comp y ON y.tile = c.b""")
def validate_cuts(spark, sf):
    """What is wrong with each separator cut, by the first rule that it breaks."""
    k = col("p_partkey")
    cuts = D.table(spark, sf, "part").select(k.alias("id"), S.pack_tile(k % 64, k * 3 % 64, F.lit(0)).alias("a"), S.pack_tile((k + k % 3) % 64, (k * 3 + k % 2) % 64, F.lit(0)).alias("b"))
    cuts = cuts.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b"))
    t = G.saved(D.tiles(spark, sf))
    walk = G.saved(G.walk_edges(t))
    c = G.saved(G.natural_components(t, walk))
    j = cuts.join(cuts.groupBy("low", "high").agg(F.count(F.lit(1)).alias("times")), ["low", "high"])
    j = j.join(walk.select(col("s").alias("a"), col("d").alias("b"), F.lit(1).alias("step")).distinct(), ["a", "b"], "left")
    j = j.join(c.select(col("tile").alias("a"), col("component_id").alias("ca")), "a", "left").join(c.select(col("tile").alias("b"), col("component_id").alias("cb")), "b", "left")
    verdict = F.when(col("times") > 1, "duplicate").when(col("a") == col("b"), "self edge").when(col("step").isNull(), "not a walking edge").when(col("ca").isNull(), "endpoint is not a walking tile").when(col("ca") != col("cb"), "crosses natural components").otherwise("ok")
    return j.select("id", verdict.alias("verdict"))


@query(world(T, E, CC, "n AS (SELECT component_id, count(*) AS n FROM comp GROUP BY 1)", recursive=True) + "SELECT component_id, CAST(sum(n) OVER (ORDER BY component_id) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY component_id) AS BIGINT) AS finish FROM n")
def component_offsets(spark, sf):
    """Where each component's tiles begin and end in the list of all tiles by component."""
    n = components(spark, sf).groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))
    return G.running_sum(n, "component_id", "n", "finish").select("component_id", (col("finish") - col("n")).alias("start"), "finish")


@query(world(T, E, TR, B, CC, "n AS (SELECT component_id, count(*) AS n FROM comp GROUP BY 1)", "o AS (SELECT component_id, sum(n) OVER (ORDER BY component_id) - n AS a, sum(n) OVER (ORDER BY component_id) AS e FROM n)", "l AS (SELECT *, lag(e) OVER (ORDER BY component_id) AS before, lag(component_id) OVER (ORDER BY component_id) AS earlier FROM o)", recursive=True) + "SELECT (SELECT count(*) FROM tiles) = (SELECT count(*) FROM comp) AS same_length, (SELECT count(*) FROM l WHERE component_id <= earlier) AS not_ascending, (SELECT count(*) FROM l WHERE a <> coalesce(before, 0)) AS broken_offsets, (SELECT max(e) FROM o) = (SELECT count(*) FROM tiles) AS ends_at_length, (SELECT count(*) FROM (SELECT tile FROM tiles EXCEPT SELECT tile FROM comp)) AS unowned, (SELECT count(*) FROM walk) % 2 = 0 AS even_adjacency")
def dq_alignment(spark, sf):
    """Lengths agree, keys ascend, offsets start at 0, join up and end at the length, every tile is owned, steps come in pairs."""
    t = G.saved(D.tiles(spark, sf))
    walk = G.saved(G.walk_edges(t))
    c = G.saved(G.natural_components(t, walk))
    o = G.saved(G.running_sum(c.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")), "component_id", "n", "finish"))
    after = o.select((col("component_id") + 1).alias("component_id"), col("finish").alias("before"))
    joined = o.join(after, "component_id", "left").agg(F.count_if(col("finish") - col("n") != F.coalesce("before", F.lit(0))).alias("broken_offsets"), F.max("finish").alias("last"), F.countDistinct("component_id").alias("k"), F.count(F.lit(1)).alias("m"))
    one = t.agg(F.count(F.lit(1)).alias("tiles")).join(c.agg(F.count(F.lit(1)).alias("owned"))).join(joined).join(t.join(c, "tile", "left_anti").agg(F.count(F.lit(1)).alias("unowned"))).join(walk.agg(F.count(F.lit(1)).alias("steps")))
    return one.select((col("tiles") == col("owned")).alias("same_length"), (col("m") - col("k")).alias("not_ascending"), "broken_offsets", (col("last") == col("tiles")).alias("ends_at_length"), "unowned", (col("steps") % 2 == 0).alias("even_adjacency"))
