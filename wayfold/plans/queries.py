"""Queries over the derived world and the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import requirements as R
from ..functions import scalars as S
from ..operators import graph as G
from ..sources import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def world(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " "


T, E, TR, B, CC = D.SQL_TILES, D.SQL_EDGES, D.SQL_TRANSPORTS, D.SQL_BANKS, D.SQL_COMPONENTS
col = F.col

# ---- scalars -----------------------------------------------------------------------------------------------------------


@query("SELECT tile, tile & 32767 AS x, (tile >> 15) & 32767 AS y, (tile >> 30) & 3 AS plane, concat_ws('/', tile & 32767, (tile >> 15) & 32767, (tile >> 30) & 3) AS label, true AS valid FROM (SELECT DISTINCT (l_partkey & 32767) | ((l_orderkey & 32767) << 15) | (CAST(l_linenumber & 3 AS BIGINT) << 30) AS tile FROM lineitem)")
def tile_pack_unpack(spark, sf):
    t = D.table(spark, sf, "lineitem").select(S.pack_tile(col("l_partkey"), col("l_orderkey"), col("l_linenumber")).alias("tile")).distinct()
    x, y, p = S.tile_x(col("tile")), S.tile_y(col("tile")), S.tile_plane(col("tile"))
    return t.select("tile", x.alias("x"), y.alias("y"), p.alias("plane"), S.coordinate_text(x, y, p).alias("label"), S.in_range(x, y, p).alias("valid"))


@query(world(TR) + "SELECT id, CASE WHEN (origin >> 30) = (destination >> 30) THEN greatest(abs((origin & 32767) - (destination & 32767)), abs(((origin >> 15) & 32767) - ((destination >> 15) & 32767))) END AS distance, greatest(abs((origin & 32767) - (destination & 32767)), abs(((origin >> 15) & 32767) - ((destination >> 15) & 32767))) AS flat FROM transports WHERE origin IS NOT NULL")
def chebyshev_pairs(spark, sf):
    o, d = col("origin"), col("destination")
    ax, ay, bx, by = S.tile_x(o), S.tile_y(o), S.tile_x(d), S.tile_y(d)
    return D.transports(spark, sf).where("origin IS NOT NULL").select("id", S.chebyshev(ax, ay, S.tile_plane(o), bx, by, S.tile_plane(d)).alias("distance"), S.chebyshev_flat(ax, ay, bx, by).alias("flat"))


REQ = """req AS (SELECT o_orderkey AS id, o_custkey AS account, concat((o_custkey % 99) + 1, ' Construction;', o_orderkey % 80, ' Deep Sea Fishing;bad piece') AS skills_text,
  concat('Quest ', o_orderkey % 5, '; Quest ', o_custkey % 7, ';') AS quests_text,
  concat(o_custkey % 50, '=', o_orderkey % 3, ';', o_orderkey % 40, '>1;x@y;', o_custkey % 30, '@', o_orderkey % 20, ';', o_custkey % 9, '&', o_orderkey % 8) AS vars_text,
  concat('COINS=', o_orderkey % 100, ' & law_rune=', o_custkey % 5, ' | Rope=1') AS items_text FROM orders)"""


def requirement_rows(spark, sf) -> DataFrame:
    c, k = col("o_custkey"), col("o_orderkey")
    s = lambda *xs: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in xs))
    t = lambda x: x.cast("string")
    return D.table(spark, sf, "orders").select(
        k.alias("id"), c.alias("account"), s(t(c % 99 + 1), " Construction;", t(k % 80), " Deep Sea Fishing;bad piece").alias("skills_text"),
        s("Quest ", t(k % 5), "; Quest ", t(c % 7), ";").alias("quests_text"),
        s(t(c % 50), "=", t(k % 3), ";", t(k % 40), ">1;x@y;", t(c % 30), "@", t(k % 20), ";", t(c % 9), "&", t(k % 8)).alias("vars_text"),
        s("COINS=", t(k % 100), " & law_rune=", t(c % 5), " | Rope=1").alias("items_text"),
    )


@query("SELECT o_orderkey AS id, (o_custkey % 64) | ((o_orderkey % 64) << 15) | ((o_custkey % 4) << 30) AS tile, CAST(NULL AS BIGINT) AS bad, greatest(1, o_custkey % 3) AS duration, o_orderstatus = 'F' AS consumable FROM orders")
def parse_coordinates(spark, sf):
    c, k = col("o_custkey"), col("o_orderkey")
    text = F.concat_ws(" ", (c % 64).cast("string"), (k % 64).cast("string"), (c % 4).cast("string"))
    flag = F.when(col("o_orderstatus") == "F", "yes").otherwise("no")
    return D.table(spark, sf, "orders").select(k.alias("id"), S.parse_tile(text).alias("tile"), S.parse_tile(F.concat(text, F.lit(" 1"))).alias("bad"), S.duration((c % 3).cast("string"), F.lit(True)).alias("duration"), S.consumable(flag).alias("consumable"))


@query(world(REQ, "p AS (SELECT id, unnest(string_split(skills_text, ';')) AS piece FROM req)") + r"SELECT id, CAST(regexp_extract(piece, '^(\d+) (.*)$', 1) AS INTEGER) AS level, regexp_extract(piece, '^(\d+) (.*)$', 2) AS skill FROM p WHERE regexp_matches(piece, '^\d+ .+$')")
def parse_skills(spark, sf):
    return requirement_rows(spark, sf).select("id", F.inline(S.parse_skills(col("skills_text"))))


@query(world(REQ, "p AS (SELECT id, trim(unnest(string_split(quests_text, ';'))) AS quest FROM req)") + "SELECT id, quest FROM p WHERE quest <> ''")
def parse_quests(spark, sf):
    return requirement_rows(spark, sf).select("id", F.explode(S.parse_quests(col("quests_text"))).alias("quest"))


SQL_VARS = r"vars AS (SELECT id AS t, account, CAST(regexp_extract(piece, '^(\d+)([=><&@])(\d+)$', 1) AS BIGINT) AS id, regexp_extract(piece, '^(\d+)([=><&@])(\d+)$', 2) AS op, CAST(regexp_extract(piece, '^(\d+)([=><&@])(\d+)$', 3) AS BIGINT) AS value FROM (SELECT id, account, unnest(string_split(vars_text, ';')) AS piece FROM req) WHERE regexp_matches(piece, '^\d+[=><&@]\d+$'))"


@query(world(REQ, SQL_VARS) + "SELECT t AS transport_id, id, op, value FROM vars")
def parse_vars(spark, sf):
    return requirement_rows(spark, sf).select(col("id").alias("transport_id"), F.inline(S.parse_vars(col("vars_text"))))


@query(world(REQ, "alt AS (SELECT id, i AS alternative, upper(replace(string_split(items_text, '|')[i], ' ', '')) AS a FROM req, range(1, 3) r(i))", "term AS (SELECT id, alternative, unnest(string_split(a, '&')) AS t FROM alt)") + "SELECT id, alternative, split_part(t, '=', 1) AS name, CAST(split_part(t, '=', 2) AS BIGINT) AS qty FROM term")
def parse_items_dnf(spark, sf):
    alts = requirement_rows(spark, sf).select("id", F.posexplode(S.parse_items(col("items_text"))).alias("i", "terms"))
    return alts.select("id", (col("i") + 1).cast("long").alias("alternative"), F.inline("terms"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN (x >= 2944 AND x < 3392 AND y >= 3760 AND y < 4208) OR (x >= 2944 AND x < 3462 AND y >= 10155 AND y < 10376) THEN 'NoGlobals' WHEN (x >= 2944 AND x < 3392 AND y >= 3680 AND y < 4128) OR (x >= 2944 AND x < 3462 AND y >= 10075 AND y < 10376) THEN 'WildernessGlobals' ELSE 'AllGlobals' END AS capability FROM (SELECT l_orderkey, l_linenumber, 2900 + l_partkey % 600 AS x, CASE WHEN l_linenumber % 2 = 0 THEN 3600 ELSE 10000 END + l_orderkey % 700 AS y FROM lineitem)")
def capability_regions(spark, sf):
    x, y = 2900 + col("l_partkey") % 600, F.when(col("l_linenumber") % 2 == 0, 3600).otherwise(10000) + col("l_orderkey") % 700
    return D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.capability(x, y).alias("capability"))


@query(world(TR) + "SELECT id, CASE WHEN id % 3 = 0 THEN type ELSE concat('Ride ', id % 11) END AS label, duration + CASE type WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 5 ELSE 0 END AS cost FROM transports")
def transport_cost(spark, sf):
    penalty = F.create_map(F.lit("1-URGENT"), F.lit(10).cast("long"), F.lit("2-HIGH"), F.lit(5).cast("long"))
    show = F.when(col("id") % 3 == 0, "").otherwise(F.concat(F.lit("Ride "), (col("id") % 11).cast("string")))
    return D.transports(spark, sf).select("id", S.label(show, col("type")).alias("label"), S.add_cost(col("duration"), F.coalesce(F.try_element_at(penalty, col("type")), F.lit(0).cast("long"))).alias("cost"))


# ---- requirements ------------------------------------------------------------------------------------------------------


def account_rows(spark, sf) -> DataFrame:
    c = col("c_custkey")
    amount = F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("long")
    bag = F.create_map(F.lit("COINS"), amount % 120, F.lit("LAW_RUNE"), c % 6)
    return D.table(spark, sf, "customer").select(
        c.alias("account"), F.create_map(F.lit("Construction"), (col("c_nationkey") * 4).cast("int"), F.lit("Deep Sea Fishing"), (c % 99).cast("int")).alias("levels"),
        F.transform(F.sequence(F.lit(0).cast("long"), c % 5), lambda i: F.concat(F.lit("Quest "), i.cast("string"))).alias("quests"), bag.alias("carried"), F.create_map(F.lit("ROPE"), c % 2, F.lit("COINS"), c % 7).alias("bank"),
    )


@query("SELECT c_custkey AS account, unnest(['COINS', 'LAW_RUNE', 'ROPE']) AS item, unnest([CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) % 120 + c_custkey % 7, c_custkey % 6, c_custkey % 2]) AS qty FROM customer")
def item_bags(spark, sf):
    return account_rows(spark, sf).select("account", F.explode(R.bag_sum(col("carried"), col("bank"))).alias("item", "qty"))


def checked_requirements(spark, sf) -> DataFrame:
    r = requirement_rows(spark, sf).join(account_rows(spark, sf), "account")
    bag = R.bag_sum(col("carried"), col("bank"))
    value = lambda v: F.when(v["id"] % 3 != col("account") % 3, (v["id"] + col("account")) % 4)
    results = F.transform(S.parse_vars(col("vars_text")), lambda v: R.var_result(v, value(v), F.lit(12)))
    r = r.select(
        "id", "account", R.items_met(S.parse_items(col("items_text")), bag).alias("items_ok"), R.skills_met(S.parse_skills(col("skills_text")), col("levels")).alias("skills_ok"),
        R.quests_met(S.parse_quests(col("quests_text")), col("quests")).alias("quests_ok"), results.alias("results"),
    )
    r = r.withColumn("vars_failed", F.size(F.filter("results", lambda x: x == "fail")).cast("long")).withColumn("vars_unknown", F.size(F.filter("results", lambda x: x == "unknown")).cast("long")).drop("results")
    return r.withColumn("available", col("items_ok") & col("skills_ok") & col("quests_ok") & (col("vars_failed") == 0) & (col("vars_unknown") == 0))


SQL_CHECK = SQL_VARS + r""", held AS (SELECT t, op, value, CASE WHEN id % 3 <> account % 3 THEN (id + account) % 4 END AS v FROM vars),
vr AS (SELECT t, count(*) FILTER (WHERE v IS NULL) AS vars_unknown, count(*) FILTER (WHERE v IS NOT NULL AND NOT CASE op WHEN '=' THEN v = value WHEN '>' THEN v > value WHEN '<' THEN v < value WHEN '&' THEN (v & value) = value ELSE v + value < 12 END) AS vars_failed FROM held GROUP BY t),
k AS (SELECT o_orderkey AS id, o_custkey AS account, CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) % 120 + c_custkey % 7 AS coins, c_custkey % 6 AS law, c_custkey % 2 AS rope, c_nationkey * 4 AS con, c_custkey % 99 AS fish FROM orders JOIN customer ON o_custkey = c_custkey),
checked AS (SELECT id, account, rope >= 1 OR (CASE WHEN id % 100 = 0 THEN coins = 0 ELSE coins >= id % 100 END AND CASE WHEN account % 5 = 0 THEN law = 0 ELSE law >= account % 5 END) AS items_ok,
  con >= account % 99 + 1 AND fish >= id % 80 AS skills_ok, id % 5 <= account % 5 AND account % 7 <= account % 5 AS quests_ok, vars_failed, vars_unknown FROM k JOIN vr ON vr.t = k.id)"""


@query(world(REQ, SQL_CHECK) + "SELECT *, items_ok AND skills_ok AND quests_ok AND vars_failed = 0 AND vars_unknown = 0 AS available FROM checked")
def requirement_failures(spark, sf):
    return checked_requirements(spark, sf)


@query(world(REQ, SQL_CHECK) + "SELECT account % 10 AS profile, count(*) AS n, count(*) FILTER (WHERE items_ok AND skills_ok AND quests_ok AND vars_failed = 0 AND vars_unknown = 0) AS available, count(*) FILTER (WHERE NOT items_ok) AS items, count(*) FILTER (WHERE NOT skills_ok) AS skills, count(*) FILTER (WHERE NOT quests_ok) AS quests, CAST(sum(vars_failed) AS BIGINT) AS failed, CAST(sum(vars_unknown) AS BIGINT) AS unknown FROM checked GROUP BY 1")
def availability_counts(spark, sf):
    c = checked_requirements(spark, sf)
    return c.groupBy((col("account") % 10).alias("profile")).agg(F.count(F.lit(1)).alias("n"), F.count_if("available").alias("available"), F.count_if(~col("items_ok")).alias("items"), F.count_if(~col("skills_ok")).alias("skills"), F.count_if(~col("quests_ok")).alias("quests"), F.sum("vars_failed").alias("failed"), F.sum("vars_unknown").alias("unknown"))


@query(world(REQ, SQL_VARS) + "SELECT id AS var, count(*) AS uses, count(DISTINCT account) AS accounts, string_agg(DISTINCT op, '' ORDER BY op) AS ops, count(DISTINCT account) FILTER (WHERE id % 3 = account % 3) AS unmodelled FROM vars GROUP BY id")
def variable_audit(spark, sf):
    v = requirement_rows(spark, sf).select("account", F.inline(S.parse_vars(col("vars_text"))))
    return v.groupBy(col("id").alias("var")).agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("account").alias("accounts"), F.array_join(F.sort_array(F.collect_set("op")), "").alias("ops"), F.countDistinct(F.when(col("id") % 3 == col("account") % 3, col("account"))).alias("unmodelled"))


@query(world(TR, "v AS (SELECT *, unnest([false, true]) AS banked FROM transports WHERE type <> '5-LOW')") + "SELECT id, banked, CASE WHEN origin IS NULL AND max_level >= 30 THEN 'wilderness' WHEN origin IS NULL THEN 'global' ELSE 'local' END AS class, duration AS cost FROM v WHERE banked OR status <> 'O'")
def availability_views(spark, sf):
    """Enabled types only; some transports ask for banked items."""
    t = D.transports(spark, sf).where("type <> '5-LOW'").withColumn("banked", F.explode(F.array(F.lit(False), F.lit(True)))).where("banked OR status <> 'O'")
    kind = F.when(col("origin").isNull() & (F.coalesce("max_level", F.lit(-1)) >= 30), "wilderness").when(col("origin").isNull(), "global").otherwise("local")
    return t.select("id", "banked", kind.alias("class"), col("duration").alias("cost"))


@query(world(TR) + "SELECT type, count(*) FILTER (WHERE origin IS NULL) AS globals, count(*) FILTER (WHERE status = 'F') AS free, count(*) FILTER (WHERE duration > 10) AS slow, count(DISTINCT destination) AS places FROM transports GROUP BY type")
def coverage_counts(spark, sf):
    return D.transports(spark, sf).groupBy("type").agg(F.count_if(col("origin").isNull()).alias("globals"), F.count_if(col("status") == "F").alias("free"), F.count_if(col("duration") > 10).alias("slow"), F.countDistinct("destination").alias("places"))


@query(world(REQ, SQL_CHECK) + "SELECT account % 10 AS profile, count(*) FILTER (WHERE items_ok AND skills_ok) - count(*) FILTER (WHERE items_ok AND skills_ok AND quests_ok) AS gained FROM checked GROUP BY 1")
def profile_compare(spark, sf):
    c = checked_requirements(spark, sf)
    base = col("items_ok") & col("skills_ok")
    return c.groupBy((col("account") % 10).alias("profile")).agg((F.count_if(base) - F.count_if(base & col("quests_ok"))).alias("gained"))


@query("SELECT c_custkey, t.tier, t.i <= c_custkey % 5 AS reached FROM customer, (VALUES ('Easy', 1), ('Medium', 2), ('Hard', 3), ('Elite', 4)) t(tier, i)")
def diary_expand(spark, sf):
    names = F.array(F.lit("None"), F.lit("Easy"), F.lit("Medium"), F.lit("Hard"), F.lit("Elite"))
    return D.table(spark, sf, "customer").select("c_custkey", F.inline(R.tier_flags(F.element_at(names, (col("c_custkey") % 5 + 1).cast("int")))))


@query("SELECT l_suppkey, CAST(bit_or(CAST(1 AS BIGINT) << (l_partkey % 20)) AS BIGINT) AS mask FROM lineitem GROUP BY 1")
def bitmask_or(spark, sf):
    return D.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.bit_or(F.expr("shiftleft(1L, CAST(l_partkey % 20 AS INT))")).alias("mask"))


@query("SELECT o_custkey AS account, o_orderkey % 4 AS var, count(DISTINCT o_custkey % 2 + o_orderkey % 3) AS n_values FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_custkey % 2 + o_orderkey % 3) > 1")
def vars_conflict(spark, sf):
    """Values set for one variable from several sources must agree; these don't."""
    o = D.table(spark, sf, "orders").select(col("o_custkey").alias("account"), (col("o_orderkey") % 4).alias("var"), (col("o_custkey") % 2 + col("o_orderkey") % 3).alias("value"))
    return o.groupBy("account", "var").agg(F.countDistinct("value").alias("n_values")).where("n_values > 1")


@query("WITH o AS (SELECT n_regionkey AS kind, s_suppkey AS id, s_suppkey % 64 AS x, (s_suppkey * 13) % 64 AS y, s_suppkey % 9 AS d FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT a.id AS origin_id, b.id AS destination_id, greatest(a.d, b.d) AS duration FROM o a JOIN o b ON a.kind = b.kind AND a.id % 2 = 0 AND b.id % 2 = 1 AND greatest(abs(a.x - b.x), abs(a.y - b.y)) > 20")
def permutation_join(spark, sf):
    """Origin-only rows with destination-only rows of one type, further apart than the type's radius."""
    o = D.table(spark, sf, "supplier").join(D.table(spark, sf, "nation"), col("s_nationkey") == col("n_nationkey")).select(col("n_regionkey").alias("kind"), col("s_suppkey").alias("id"), (col("s_suppkey") % 64).alias("x"), (col("s_suppkey") * 13 % 64).alias("y"), (col("s_suppkey") % 9).alias("d"))
    a, b = o.where("id % 2 = 0").alias("a"), o.where("id % 2 = 1").alias("b")
    far = S.chebyshev_flat(col("a.x"), col("a.y"), col("b.x"), col("b.y")) > 20
    return a.join(b, (col("a.kind") == col("b.kind")) & far).select(col("a.id").alias("origin_id"), col("b.id").alias("destination_id"), F.greatest("a.d", "b.d").alias("duration"))


# ---- topology ----------------------------------------------------------------------------------------------------------


@query(world(T, E) + "SELECT s, d FROM walk")
def walk_adjacency(spark, sf):
    return G.walk_edges(D.tiles(spark, sf))


@query(world(T, "f AS (SELECT tile, x, y, p, (x + y) % 3 <> 0 AS n, (x * y) % 4 <> 1 AS e FROM tiles)") + """SELECT f.tile, CAST(CASE WHEN f.n THEN 1 ELSE 0 END + CASE WHEN f.n AND coalesce(up.e, false) AND f.e AND coalesce(r.n, false) THEN 2 ELSE 0 END + CASE WHEN f.e THEN 4 ELSE 0 END
 + CASE WHEN coalesce(dn.n, false) AND coalesce(dn.e, false) AND f.e AND coalesce(dr.n, false) THEN 8 ELSE 0 END + CASE WHEN coalesce(dn.n, false) THEN 16 ELSE 0 END + CASE WHEN coalesce(dn.n, false) AND coalesce(dl.e, false) AND coalesce(l.e, false) AND coalesce(dl.n, false) THEN 32 ELSE 0 END
 + CASE WHEN coalesce(l.e, false) THEN 64 ELSE 0 END + CASE WHEN f.n AND coalesce(ul.e, false) AND coalesce(l.e, false) AND coalesce(l.n, false) THEN 128 ELSE 0 END AS INTEGER) AS mask
FROM f LEFT JOIN f up ON up.x = f.x AND up.y = f.y + 1 AND up.p = f.p LEFT JOIN f r ON r.x = f.x + 1 AND r.y = f.y AND r.p = f.p LEFT JOIN f dn ON dn.x = f.x AND dn.y = f.y - 1 AND dn.p = f.p LEFT JOIN f l ON l.x = f.x - 1 AND l.y = f.y AND l.p = f.p
LEFT JOIN f dr ON dr.x = f.x + 1 AND dr.y = f.y - 1 AND dr.p = f.p LEFT JOIN f dl ON dl.x = f.x - 1 AND dl.y = f.y - 1 AND dl.p = f.p LEFT JOIN f ul ON ul.x = f.x - 1 AND ul.y = f.y + 1 AND ul.p = f.p""")
def walk_mask(spark, sf):
    return G.walk_masks(D.tiles(spark, sf).withColumn("north", (col("x") + col("y")) % 3 != 0).withColumn("east", (col("x") * col("y")) % 4 != 1))


def components(spark, sf) -> DataFrame:
    t = D.tiles(spark, sf)
    return G.natural_components(t, G.walk_edges(t))


@query(world(T, E, CC, recursive=True) + "SELECT tile, component_id FROM comp")
def natural_components(spark, sf):
    return components(spark, sf).select("tile", "component_id")


CUT = "NOT (((s & 32767) = 31 AND (d & 32767) = 32) OR ((s & 32767) = 32 AND (d & 32767) = 31))"


def cut_edges(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = D.tiles(spark, sf)
    e = G.walk_edges(t)
    x, y = S.tile_x(col("s")), S.tile_x(col("d"))
    return t, e.where(~(((x == 31) & (y == 32)) | ((x == 32) & (y == 31)))), e.where((x == 31) & (y == 32))


@query(world(T, E, CC.replace("walk w", "cutwalk w").replace("cc(tile", f"cutwalk AS (SELECT * FROM walk WHERE {CUT}), cc(tile"), recursive=True) + "SELECT tile, component_id FROM comp")
def routing_components(spark, sf):
    t, e, _ = cut_edges(spark, sf)
    return G.natural_components(t, e).select("tile", "component_id")


@query(world(T, E, CC.replace("walk w", "cutwalk w").replace("cc(tile", f"cutwalk AS (SELECT * FROM walk WHERE {CUT}), cc(tile"), recursive=True) + "SELECT a.component_id AS from_component, b.component_id AS to_component, count(*) AS crossings, 1 AS cost FROM walk w JOIN comp a ON a.tile = w.s JOIN comp b ON b.tile = w.d WHERE (w.s & 32767) = 31 AND (w.d & 32767) = 32 GROUP BY 1, 2")
def crossings(spark, sf):
    t, e, cuts = cut_edges(spark, sf)
    c = G.saved(G.natural_components(t, e))
    j = cuts.join(c.select(col("tile").alias("s"), col("component_id").alias("from_component")), "s").join(c.select(col("tile").alias("d"), col("component_id").alias("to_component")), "d")
    return j.groupBy("from_component", "to_component").agg(F.count(F.lit(1)).alias("crossings")).withColumn("cost", F.lit(1))


@query(world(T, E, CC, recursive=True) + "SELECT component_id, count(*) AS tile_count, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(p) AS min_plane, max(p) AS max_plane FROM comp JOIN tiles USING (tile) GROUP BY 1")
def component_facts(spark, sf):
    j = components(spark, sf).join(D.tiles(spark, sf), "tile")
    return j.groupBy("component_id").agg(F.count(F.lit(1)).alias("tile_count"), *(f(c).alias(f"{n}_{m}") for c, m in (("x", "x"), ("y", "y"), ("p", "plane")) for f, n in ((F.min, "min"), (F.max, "max"))))


@query(world(T, E, CC, "s AS (SELECT component_id, count(*) AS n FROM comp GROUP BY 1)", recursive=True) + "SELECT count(*) AS components, CAST(sum(n) AS BIGINT) AS tiles, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99, max(n) AS p100 FROM s")
def topology_metadata(spark, sf):
    s = components(spark, sf).groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))
    p = [F.expr(f"coalesce(percentile_disc({q}) WITHIN GROUP (ORDER BY n), 0)").cast("long").alias(a) for q, a in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (1.0, "p100"))]
    return s.agg(F.count(F.lit(1)).alias("components"), F.sum("n").alias("tiles"), *p)




def reachable_ids(spark, sf, comp: DataFrame) -> DataFrame:
    t = D.transports(spark, sf)
    name = lambda c, a: comp.select(col("tile").alias(c), col("component_id").alias(a))
    edges = t.join(name("origin", "s"), "origin").join(name("destination", "d"), "destination").select("s", "d").distinct()
    seeds = comp.join(D.banks(spark, sf), "tile").select(col("component_id").alias("node"))
    seeds = seeds.union(t.where("origin IS NULL").join(name("destination", "node"), "destination").select("node"))
    return G.closure(seeds, G.saved(edges))


SQL_CLOSE = """ce AS (SELECT DISTINCT a.component_id AS s, b.component_id AS d FROM transports t JOIN comp a ON a.tile = t.origin JOIN comp b ON b.tile = t.destination),
seeds AS (SELECT component_id AS id FROM comp JOIN banks USING (tile) UNION SELECT component_id FROM transports t JOIN comp ON comp.tile = t.destination WHERE t.origin IS NULL),
reach(id) AS (SELECT id FROM seeds UNION SELECT ce.d FROM reach JOIN ce ON ce.s = reach.id)"""


@query(world(T, E, TR, B, CC, SQL_CLOSE, recursive=True) + "SELECT DISTINCT id AS component_id FROM reach")
def structural_reachability(spark, sf):
    return reachable_ids(spark, sf, G.saved(components(spark, sf))).select(col("node").alias("component_id"))


@query(world(T, E, TR, B, CC, SQL_CLOSE, recursive=True) + "SELECT tile, component_id FROM comp WHERE component_id IN (SELECT id FROM reach)")
def reachable_tiles(spark, sf):
    c = G.saved(components(spark, sf))
    return c.join(reachable_ids(spark, sf, c).select(col("node").alias("component_id")), "component_id", "left_semi").select("tile", "component_id")


SQL_ACCESS = """points AS (SELECT DISTINCT c_custkey % 70 AS x, (c_custkey * 3) % 70 AS y, c_custkey % 2 AS p FROM customer),
near AS (SELECT q.x, q.y, q.p, c.tile, c.component_id, CASE WHEN t.x = q.x AND t.y = q.y THEN 0 ELSE 1 END AS far FROM points q JOIN tiles t ON t.p = q.p AND abs(t.x - q.x) + abs(t.y - q.y) <= 1 JOIN comp c ON c.tile = t.tile),
access AS (SELECT x, y, p, component_id, max(tile) AS resolved, CASE WHEN min(far) = 0 THEN 'walkable' ELSE 'snapped' END AS access_kind FROM near n WHERE far = (SELECT min(far) FROM near m WHERE m.x = n.x AND m.y = n.y AND m.p = n.p) GROUP BY ALL)"""


def access_rows(spark, sf, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and their attachments: the own tile where it is walkable, else one tile per component beside it."""
    k = col("c_custkey")
    points = D.table(spark, sf, "customer").select((k % 70).alias("x"), (k * 3 % 70).alias("y"), (k % 2).alias("p")).distinct()
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in [(0, 0), *G.CARDINAL]))
    near = points.withColumn("o", F.explode(steps)).withColumn("far", F.when((col("o.dx") == 0) & (col("o.dy") == 0), 0).otherwise(1))
    near = near.where("x + o.dx >= 0 AND y + o.dy >= 0").withColumn("tile", S.pack_tile(col("x") + col("o.dx"), col("y") + col("o.dy"), col("p"))).join(comp, "tile")
    best = near.withColumn("best", F.min("far").over(Window.partitionBy("x", "y", "p"))).where("far = best")
    found = best.groupBy("x", "y", "p", "component_id").agg(F.max("tile").alias("resolved"), F.when(F.min("far") == 0, "walkable").otherwise("snapped").alias("access_kind"))
    return points, found


@query(world(T, E, CC, SQL_ACCESS, recursive=True) + "SELECT x, y, p, component_id, resolved, access_kind FROM access")
def point_attachments(spark, sf):
    return access_rows(spark, sf, components(spark, sf))[1]


SQL_STATUS = "st AS (SELECT q.x, q.y, q.p, count(a.component_id) AS attachments, count(DISTINCT a.component_id) AS components, coalesce(bool_or(a.component_id IN (SELECT id FROM reach)), false) AS ok FROM points q LEFT JOIN access a USING (x, y, p) GROUP BY ALL)"
STATUS = "CASE WHEN attachments = 0 THEN 'unresolved' WHEN components > 1 THEN 'ambiguous/multiple_components' WHEN ok THEN 'reachable' ELSE 'unreachable_component' END"


def status_rows(spark, sf) -> DataFrame:
    c = G.saved(components(spark, sf))
    points, found = access_rows(spark, sf, c)
    ok = reachable_ids(spark, sf, c).select(col("node").alias("component_id"), F.lit(True).alias("good"))
    j = points.join(found.join(ok, "component_id", "left"), ["x", "y", "p"], "left")
    s = j.groupBy("x", "y", "p").agg(F.count("component_id").alias("attachments"), F.countDistinct("component_id").alias("components"), F.coalesce(F.bool_or("good"), F.lit(False)).alias("ok"))
    return s.withColumn("status", F.expr(STATUS))


@query(world(T, E, TR, B, CC, SQL_CLOSE, SQL_ACCESS, SQL_STATUS, recursive=True) + f"SELECT x, y, p, attachments, components, {STATUS} AS status FROM st")
def place_facts(spark, sf):
    return status_rows(spark, sf).drop("ok")


@query(world(T, E, TR, B, CC, SQL_CLOSE, SQL_ACCESS, SQL_STATUS, recursive=True) + f"SELECT {STATUS} AS status, count(*) AS places FROM st GROUP BY 1")
def place_status_report(spark, sf):
    return status_rows(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("places"))


@query(world(T, E, TR, CC, recursive=True) + "SELECT t.id, o.component_id AS origin_component, d.component_id AS destination_component FROM transports t LEFT JOIN comp o ON o.tile = t.origin LEFT JOIN comp d ON d.tile = t.destination")
def transport_facts(spark, sf):
    c = G.saved(components(spark, sf))
    t = D.transports(spark, sf)
    return t.join(c.select(col("tile").alias("origin"), col("component_id").alias("origin_component")), "origin", "left").join(c.select(col("tile").alias("destination"), col("component_id").alias("destination_component")), "destination", "left").select("id", "origin_component", "destination_component")


RESOLVE = 3


@query(world(T, f"q AS (SELECT DISTINCT c_custkey % 70 AS x, (c_custkey * 3) % 70 AS y, c_custkey % 2 AS p FROM customer), c AS (SELECT q.x, q.y, q.p, t.x AS tx, t.y AS ty, greatest(abs(t.x - q.x), abs(t.y - q.y)) AS distance, abs(t.x - q.x) + abs(t.y - q.y) AS manhattan FROM q JOIN tiles t ON t.p = q.p AND t.x BETWEEN q.x - {RESOLVE} AND q.x + {RESOLVE} AND t.y BETWEEN q.y - {RESOLVE} AND q.y + {RESOLVE}), r AS (SELECT *, row_number() OVER w AS k, rank() OVER (PARTITION BY x, y, p ORDER BY distance) AS g FROM c WINDOW w AS (PARTITION BY x, y, p ORDER BY distance, manhattan, tx, ty))") + "SELECT q.x, q.y, q.p, max(CASE WHEN k = 1 THEN tx END) AS resolved_x, max(CASE WHEN k = 1 THEN ty END) AS resolved_y, count(*) FILTER (WHERE g = 1) AS ties, CASE WHEN min(distance) = 0 THEN 'exact' WHEN min(distance) IS NULL THEN 'unresolved' ELSE 'nearest_reachable' END AS method FROM q LEFT JOIN r USING (x, y, p) GROUP BY ALL")
def resolve_endpoints(spark, sf):
    """Nearest tile within a radius, by grid buckets instead of a range join: a tile enters its own bucket, a point the buckets it can see."""
    size = 2 * RESOLVE + 1
    k = col("c_custkey")
    q = D.table(spark, sf, "customer").select((k % 70).alias("x"), (k * 3 % 70).alias("y"), (k % 2).alias("p")).distinct()
    bucket = lambda c: F.floor(c / size)
    seen = q.withColumn("bx", F.explode(F.sequence(bucket(col("x") - RESOLVE), bucket(col("x") + RESOLVE)))).withColumn("by", F.explode(F.sequence(bucket(col("y") - RESOLVE), bucket(col("y") + RESOLVE))))
    t = D.tiles(spark, sf).select(col("x").alias("tx"), col("y").alias("ty"), "p", bucket(col("x")).alias("bx"), bucket(col("y")).alias("by"))
    c = seen.join(t, ["p", "bx", "by"]).withColumn("distance", S.chebyshev_flat(col("tx"), col("ty"), col("x"), col("y"))).where(col("distance") <= RESOLVE)
    c = c.withColumn("manhattan", F.abs(col("tx") - col("x")) + F.abs(col("ty") - col("y")))
    best = c.groupBy("x", "y", "p").agg(F.min(F.struct("distance", "manhattan", "tx", "ty")).alias("b"))
    ties = c.groupBy("x", "y", "p", "distance").agg(F.count(F.lit(1)).alias("ties"))
    j = q.join(best, ["x", "y", "p"], "left").withColumn("distance", col("b.distance")).join(ties, ["x", "y", "p", "distance"], "left")
    return j.select("x", "y", "p", col("b.tx").alias("resolved_x"), col("b.ty").alias("resolved_y"), F.coalesce("ties", F.lit(0)).cast("long").alias("ties"), F.when(col("distance") == 0, "exact").when(col("distance").isNull(), "unresolved").otherwise("nearest_reachable").alias("method"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 <> o_orderkey % 2 OR d >= 1000 THEN 'cross-world' WHEN d >= 400 THEN 'long' WHEN d >= 100 THEN 'regional' ELSE 'local' END AS tag, floor(o_custkey / 512) AS region FROM (SELECT *, greatest(abs(o_custkey - o_orderkey), 0) AS d FROM orders)".replace("floor(o_custkey / 512)", "o_custkey // 512"))
def endpoint_tags(spark, sf):
    d = F.abs(col("o_custkey") - col("o_orderkey"))
    return D.table(spark, sf, "orders").select("o_orderkey", S.distance_tag(d, col("o_custkey") % 2 == col("o_orderkey") % 2).alias("tag"), F.floor(col("o_custkey") / 512).alias("region"))


@query(world(TR, "inside AS (SELECT id, type, (origin & 32767) < 8 AS inner_origin, origin, CASE WHEN (destination & 32767) < 8 THEN 1000 ELSE destination END AS destination FROM transports WHERE origin IS NOT NULL)") + "SELECT type, origin, destination FROM inside UNION SELECT type, 1000, destination FROM inside WHERE inner_origin")
def poh_aliases(spark, sf):
    """Destinations inside a house collapse to its landing tile; origins inside are copied to it unless already there."""
    t = D.transports(spark, sf).where("origin IS NOT NULL")
    inside = lambda c: S.tile_x(col(c)) < 8
    t = t.withColumn("destination", F.when(inside("destination"), F.lit(1000).cast("long")).otherwise(col("destination")))
    return t.select("type", "origin", "destination").union(t.where(inside("origin")).select("type", F.lit(1000).cast("long"), "destination")).distinct()


# ---- shortest paths ----------------------------------------------------------------------------------------------------

START = "start AS (SELECT min(tile) AS tile FROM comp WHERE root = (SELECT root FROM comp GROUP BY root ORDER BY count(*) DESC, root LIMIT 1))"


def sp_sql(edges: str, finish: str) -> str:
    return world(T, E, TR, B, CC, START, f"e AS ({edges})", """r(id, c) USING KEY (id) AS (SELECT tile * 2, CAST(0 AS BIGINT) FROM start
  UNION (SELECT e.d, min(r.c + e.w) FROM r JOIN e ON e.s = r.id LEFT JOIN recurring.r k ON k.id = e.d WHERE k.id IS NULL OR r.c + e.w < k.c GROUP BY 1))""", recursive=True) + finish


SQL_WALK = "SELECT s * 2 + b AS s, d * 2 + b AS d, CAST(1 AS BIGINT) AS w FROM walk, (VALUES (0), (1)) l(b)"
SQL_LOCAL = "SELECT t.origin * 2 + b, t.destination * 2 + b, t.duration FROM transports t, (VALUES (0), (1)) l(b) WHERE t.origin IN (SELECT tile FROM tiles) AND t.destination IN (SELECT tile FROM tiles) AND (t.status = 'F' OR (b = 1 AND t.status = 'O'))"
SQL_BANK = "SELECT tile * 2, tile * 2 + 1, 0 FROM banks"
SQL_GLOBAL = "SELECT tile * 2 + b, -1 - b, 0 FROM tiles, (VALUES (0), (1)) l(b) UNION ALL SELECT -1 - b, t.destination * 2 + b, t.duration FROM transports t, (VALUES (0), (1)) l(b) WHERE t.origin IS NULL AND t.destination IN (SELECT tile FROM tiles) AND (b = 1 OR t.max_level >= 30)"
COSTS = "SELECT id // 2 AS tile, min(c) AS cost FROM r WHERE id >= 0 GROUP BY 1"


def solved(spark, sf, transports: bool, banks: bool, globals_: bool) -> tuple[DataFrame, DataFrame]:
    """The state edges of the hub query and the cost of every state that it reaches."""
    t = G.saved(D.tiles(spark, sf))
    walk = G.walk_edges(t)
    comp = G.saved(G.natural_components(t, walk))
    hub = comp.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").limit(1)
    start = hub.select(F.lit(0).cast("long").alias("query_id"), (col("root") * 2).alias("node"))
    tr = D.transports(spark, sf).join(t.select(col("tile").alias("destination")), "destination", "left_semi")
    local = tr.join(t.select(col("tile").alias("origin")), "origin", "left_semi").withColumn("banked", F.explode(F.expr("CASE WHEN status = 'F' THEN array(0L, 1L) WHEN status = 'O' THEN array(1L) ELSE array() END"))).select("origin", "destination", col("duration").alias("cost"), "banked")
    local = local.groupBy("origin", "destination", "banked").agg(F.min("cost").alias("cost")).select("origin", "destination", "cost", "banked")
    glob = tr.where("origin IS NULL").withColumn("banked", F.explode(F.expr("CASE WHEN max_level >= 30 THEN array(0L, 1L) ELSE array(1L) END")))
    glob = glob.groupBy("destination", "banked", F.when(col("max_level") >= 30, 1).otherwise(0).alias("level")).agg(F.min("duration").alias("cost"))
    edges = G.state_edges(walk, local if transports else local.limit(0), D.banks(spark, sf) if banks else None, t, glob if globals_ else None)
    edges = G.saved(edges.withColumn("query_id", F.lit(0).cast("long")))
    return edges, G.shortest_paths(edges, start)


def costs(rows: DataFrame) -> DataFrame:
    return rows.where("node >= 0").groupBy(F.expr("node DIV 2").alias("tile")).agg(F.min("cost").alias("cost"))


@query(sp_sql(SQL_WALK, COSTS))
def sp_walk_cost(spark, sf):
    return costs(solved(spark, sf, False, False, False)[1])


@query(sp_sql(f"{SQL_WALK} UNION ALL {SQL_LOCAL}", COSTS))
def sp_route_cost(spark, sf):
    return costs(solved(spark, sf, True, False, False)[1])


@query(sp_sql(f"{SQL_WALK} UNION ALL {SQL_LOCAL} UNION ALL {SQL_BANK}", "SELECT id // 2 AS tile, id % 2 AS banked, c AS cost FROM r"))
def sp_banked_cost(spark, sf):
    return solved(spark, sf, True, True, False)[1].select(F.expr("node DIV 2").alias("tile"), (col("node") % 2).alias("banked"), "cost")


@query(sp_sql(f"{SQL_WALK} UNION ALL {SQL_LOCAL} UNION ALL {SQL_BANK} UNION ALL {SQL_GLOBAL}", COSTS))
def sp_capability_cost(spark, sf):
    return costs(solved(spark, sf, True, True, True)[1])


SQL_STEPS = " UNION ALL ".join(f"SELECT *, '{k}' AS k FROM ({q}) x(s, d, w)" for k, q in (("walk", SQL_WALK), ("transport", SQL_LOCAL), ("bank", SQL_BANK), ("activate", SQL_GLOBAL.split(" UNION ALL ")[0]), ("global", SQL_GLOBAL.split(" UNION ALL ")[1])))
SQL_PREV = "prev AS (SELECT e.d AS node, min({'s': e.s, 'k': e.k}) AS e FROM e JOIN r a ON a.id = e.s JOIN r b ON b.id = e.d WHERE a.c + e.w = b.c GROUP BY 1)"
SQL_ROUTES = """best AS (SELECT id // 2 AS tile, min({'c': c, 'id': id}).id AS target FROM r JOIN banks ON banks.tile = r.id // 2 WHERE id >= 0 GROUP BY 1),
path(target, node, back) AS (SELECT target, target, 0 FROM best UNION ALL SELECT p.target, prev.e.s, p.back + 1 FROM path p JOIN prev ON prev.node = p.node)"""


@query(sp_sql(SQL_STEPS, "SELECT id AS node, c AS cost, true AS valid FROM r"))
def sp_route_replay(spark, sf):
    """Every reached state with the replay of its last step: ``valid`` where an edge of the state graph leads to it from its predecessor at
    just the cost that the predecessor lacks, or where it is the start."""
    edges, found = solved(spark, sf, True, True, True)
    found = G.saved(found)
    prev = G.predecessors(edges, found)
    at = found.select(col("node").alias("prev"), col("cost").alias("before"))
    real = edges.select(col("s").alias("prev"), col("d").alias("node"), "w").distinct()
    steps = prev.join(at, "prev").join(real, ["prev", "node"]).where("before + w = cost").select("node").distinct().withColumn("real", F.lit(True))
    j = found.join(steps, "node", "left")
    return j.select("node", "cost", F.coalesce("real", col("cost") == 0).alias("valid"))


@query(sp_sql(SQL_STEPS, "SELECT p.target // 2 AS target, row_number() OVER (PARTITION BY p.target ORDER BY p.back DESC) AS step_no, prev.e.k AS step, p.node // 2 AS tile, p.node % 2 AS banked, r.c AS cost FROM path p JOIN prev ON prev.node = p.node JOIN r ON r.id = p.node WHERE prev.e.k <> 'activate'").replace(") SELECT p.target", f"), {SQL_PREV}, {SQL_ROUTES} SELECT p.target"))
def sp_route_steps(spark, sf):
    """Ordered steps of the routes from the hub to every bank that it reaches: walking, transports, banking and globals."""
    edges, found = solved(spark, sf, True, True, True)
    found = G.saved(found)
    banks = D.banks(spark, sf)
    ends = found.where("node >= 0").withColumn("tile", F.expr("node DIV 2")).join(banks, "tile", "left_semi")
    ends = ends.groupBy("query_id", "tile").agg(F.min(F.struct("cost", "node")).alias("e")).select("query_id", col("e.node").alias("target"))
    steps = G.route_steps(G.predecessors(edges, found), ends)
    return steps.select(F.expr("target DIV 2").alias("target"), "step_no", "step", F.expr("node DIV 2").alias("tile"), (col("node") % 2).alias("banked"), "cost")


# ---- bounds and reports ------------------------------------------------------------------------------------------------


@query(world(T, "seeds AS (SELECT s_suppkey % 64 AS x, (s_suppkey * 13) % 64 AS y, min(s_suppkey % 10) AS w FROM supplier GROUP BY 1, 2)") + "SELECT t.tile, min(s.w + greatest(abs(t.x - s.x), abs(t.y - s.y))) AS distance FROM tiles t, seeds s GROUP BY 1")
def distance_transform(spark, sf):
    """Least seed weight plus Chebyshev distance: the seeds of a 64 by 64 box are bounded, so they go to every tile."""
    k = col("s_suppkey")
    seeds = D.table(spark, sf, "supplier").groupBy((k % 64).alias("sx"), (k * 13 % 64).alias("sy")).agg(F.min(k % 10).alias("w"))
    held = seeds.agg(F.collect_list(F.struct("sx", "sy", "w")).alias("seeds"))
    t = D.tiles(spark, sf).join(F.broadcast(held))
    return t.select("tile", F.array_min(F.transform("seeds", lambda s: s["w"] + S.chebyshev_flat(col("x"), col("y"), s["sx"], s["sy"]))).alias("distance"))


BBOX = "(max(x) - min(x) + 1) * (max(y) - min(y) + 1)"


@query(world(T, E, CC, recursive=True) + f"SELECT component_id, min(p) AS plane, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, {BBOX} AS bbox_cells, count(*) AS walkable_tiles, round(count(*) / ({BBOX}), 6) AS fill_ratio FROM comp JOIN tiles USING (tile) GROUP BY 1")
def bbox_report(spark, sf):
    """Box and fill ratio of every component."""
    j = components(spark, sf).join(D.tiles(spark, sf), "tile")
    b = j.groupBy("component_id").agg(F.min("p").alias("plane"), *(f(c).alias(f"{n}_{c}") for f, n in ((F.min, "min"), (F.max, "max")) for c in "xy"), F.count(F.lit(1)).alias("walkable_tiles"))
    b = b.withColumn("width", F.expr("max_x - min_x + 1")).withColumn("height", F.expr("max_y - min_y + 1")).withColumn("bbox_cells", F.expr("width * height"))
    return b.withColumn("fill_ratio", F.round(col("walkable_tiles") / col("bbox_cells"), 6))


@query(world(T, E, CC, "b AS (SELECT component_id, count(*) AS walkable, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS area FROM comp JOIN tiles USING (tile) GROUP BY 1)", recursive=True) + "SELECT component_id, walkable, area, round(walkable / area, 6) AS fill FROM b ORDER BY area DESC, component_id LIMIT 30")
def bbox_topk(spark, sf):
    j = components(spark, sf).join(D.tiles(spark, sf), "tile")
    b = j.groupBy("component_id").agg(F.count(F.lit(1)).alias("walkable"), ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("area"))
    return b.withColumn("fill", F.round(col("walkable") / col("area"), 6)).orderBy(F.desc("area"), "component_id").limit(30)


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, round(max(value), 6) AS p100 FROM events GROUP BY 1")
def bench_percentiles(spark, sf):
    p = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(a) for q, a in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    return D.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *p, F.round(F.max("value"), 6).alias("p100"))


@query("WITH o AS (SELECT user_id, event_type, min(value) AS best FROM events GROUP BY 1, 2) SELECT event_id, round(value - best, 6) AS gap, value = best AS optimal, round(CASE WHEN best = 0 THEN 1 ELSE value / best END, 6) AS ratio FROM events JOIN o USING (user_id, event_type)")
def oracle_compare(spark, sf):
    e = D.table(spark, sf, "events")
    o = e.groupBy("user_id", "event_type").agg(F.min("value").alias("best"))
    return e.join(o, ["user_id", "event_type"]).select("event_id", F.round(col("value") - col("best"), 6).alias("gap"), (col("value") == col("best")).alias("optimal"), F.round(F.when(col("best") == 0, 1.0).otherwise(col("value") / col("best")), 6).alias("ratio"))


@query(world(T, TR, B, "dest AS (SELECT destination, min(duration) AS cost FROM transports WHERE origin IS NULL GROUP BY 1)") + "SELECT tile AS s, -1 AS d, 0 AS cost FROM banks UNION ALL SELECT -1, destination, cost FROM dest")
def bank_hub_edges(spark, sf):
    """Banks and global destinations through one hub: a sum of edges, not a product."""
    t = D.transports(spark, sf).where("origin IS NULL").groupBy("destination").agg(F.min("duration").alias("cost"))
    return D.banks(spark, sf).select(col("tile").alias("s"), F.lit(-1).cast("long").alias("d"), F.lit(0).cast("long").alias("cost")).union(t.select(F.lit(-1).cast("long"), "destination", "cost"))


@query(world(T, TR, B) + "SELECT (SELECT count(*) FROM (SELECT tile FROM tiles UNION SELECT destination FROM transports)) AS united, (SELECT count(*) FROM tiles WHERE tile IN (SELECT tile FROM banks)) AS banks_on_tiles, (SELECT count(DISTINCT destination) FROM transports WHERE destination NOT IN (SELECT tile FROM tiles)) AS off_tiles")
def set_ops(spark, sf):
    t, tr, b = D.tiles(spark, sf), D.transports(spark, sf), D.banks(spark, sf)
    u = t.select("tile").union(tr.select("destination")).distinct().agg(F.count(F.lit(1)).alias("united"))
    on = t.join(b, "tile", "left_semi").agg(F.count(F.lit(1)).alias("banks_on_tiles"))
    off = tr.select(col("destination").alias("tile")).distinct().join(t, "tile", "left_anti").agg(F.count(F.lit(1)).alias("off_tiles"))
    return u.join(on).join(off)


@query(world(T, E, CC, recursive=True) + "SELECT (SELECT count(*) FROM walk w JOIN comp a ON a.tile = w.s JOIN comp b ON b.tile = w.d WHERE a.root <> b.root) AS across, (SELECT count(*) FROM walk w WHERE NOT EXISTS (SELECT 1 FROM walk v WHERE v.s = w.d AND v.d = w.s)) AS one_way, (SELECT count(*) - count(DISTINCT tile) FROM comp) AS twice, (SELECT count(*) FROM tiles WHERE tile NOT IN (SELECT tile FROM comp)) AS missing")
def dq_membership(spark, sf):
    """Invariants that count zero: no step leaves its component, every step has its way back, every tile has one component."""
    t = G.saved(D.tiles(spark, sf))
    e = G.saved(G.walk_edges(t))
    c = G.saved(G.natural_components(t, e))
    a = e.join(c.select(col("tile").alias("s"), col("root").alias("ra")), "s").join(c.select(col("tile").alias("d"), col("root").alias("rb")), "d").agg(F.count_if(col("ra") != col("rb")).alias("across"))
    o = e.exceptAll(e.select(col("d").alias("s"), col("s").alias("d"))).agg(F.count(F.lit(1)).alias("one_way"))
    w = c.agg((F.count(F.lit(1)) - F.countDistinct("tile")).alias("twice"))
    m = t.join(c, "tile", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return a.join(o).join(w).join(m)


@query("SELECT p_partkey, rn, uses FROM (SELECT p_partkey, p_size AS uses, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn FROM part) WHERE rn <= 3")
def regression_choice(spark, sf):
    """Least used first, then id: the three choices of every category (a top-k report)."""
    w = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return D.table(spark, sf, "part").withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 3").select("p_partkey", "rn", col("p_size").alias("uses"))


@query(world(TR) + "SELECT concat_ws('|', 'transport', type, coalesce(CAST(origin AS VARCHAR), ''), CAST(destination AS VARCHAR), CAST(duration AS VARCHAR)) || '|' AS record FROM transports")
def parity_records(spark, sf):
    s = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    return D.transports(spark, sf).select(F.concat(F.concat_ws("|", F.lit("transport"), "type", s("origin"), s("destination"), s("duration")), F.lit("|")).alias("record"))


@query()
def identity_hash(spark, sf):
    """FNV-1a of every part's name."""
    return D.table(spark, sf, "part").select("p_partkey", S.fnv1a32(col("p_name")).alias("hash"))


def thin_places(group: pd.DataFrame, *, radius: int = 12) -> pd.DataFrame:
    """Rows of one name without those near one kept before. A kept place is looked for in the nine squares around a row only, and a square
    of this size holds a single one, as two in it would be near."""
    side = radius + 1
    kept: dict[tuple[int, int], tuple[int, int]] = {}
    rows = []
    for r in group.sort_values(["x", "y", "id"]).itertuples(index=False):
        u, v = r.x // side, r.y // side
        around = (kept.get((u + i, v + j)) for i in (-1, 0, 1) for j in (-1, 0, 1))
        if not any(p is not None and max(abs(r.x - p[0]), abs(r.y - p[1])) <= radius for p in around):
            kept[u, v] = (r.x, r.y)
            rows.append(r)
    return pd.DataFrame(rows, columns=group.columns)


@query()
def cluster_places(spark, sf):
    """Greedy thinning per name, in order: a place within 12 tiles of one already kept goes."""
    k = col("c_custkey")
    places = D.table(spark, sf, "customer").select(S.normalize_name(F.concat_ws("-", "c_mktsegment", col("c_nationkey").cast("string"))).alias("name"), (k * 7 % 500).alias("x"), (k * 11 % 500).alias("y"), k.alias("id"))
    return places.groupBy("name").applyInPandas(thin_places, "name string, x long, y long, id long")
