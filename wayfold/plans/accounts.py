"""Queries of accounts: special failures, explanations, item variants, fingerprints and strict checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import accounts as A
from ..functions import scalars as S
from ..sources import derived as D
from .queries import REQ, SQL_CHECK, SQL_VARS, TR, checked_requirements, query, requirement_rows, world

col = F.col

SQL_ITEMS = "names AS (SELECT i, name, ids FROM (VALUES " + ", ".join(f"({i}, '{k}', {v})" for i, (k, v) in enumerate(A.ITEM_IDS.items())) + ") t(i, name, ids))"
SQL_SPECIAL = """s AS (SELECT o_orderkey AS id, (['SPIRIT_TREE', 'FAIRY_RING', 'TELEPORTATION_BOX', 'TELEPORTATION_PORTAL_POH', 'WILDERNESS_OBELISK'])[o_orderkey % 5 + 1] AS kind, o_custkey AS c,
  (['Amulet of Glory', 'Xeric''s Talisman', 'Digsite Pendant', 'Mythical cape', 'Basic Jewellery Box', 'Ornate Jewellery Box', 'Fancy Jewellery Box', 'Portal'])[o_orderkey % 8 + 1] AS info, o_orderkey % 4 AS portal,
  CASE o_orderkey % 3 WHEN 0 THEN 3055 + o_orderkey % 12 WHEN 1 THEN 1850 + o_orderkey % 20 ELSE 100 END AS ox, CASE o_orderkey % 3 WHEN 0 THEN 3253 + o_orderkey % 11 WHEN 1 THEN 5690 + o_orderkey % 19 ELSE 100 END AS oy, 1249 + o_custkey % 10 AS dx, 3746 + o_custkey % 9 AS dy FROM orders),
k AS (SELECT *, ox BETWEEN 3058 AND 3062 AND oy BETWEEN 3256 AND 3260 AS sarim, dx BETWEEN 1251 AND 1255 AND dy BETWEEN 3748 AND 3752 AS guild, ox BETWEEN 1856 AND 2047 AND oy BETWEEN 5696 AND 5767 AS house FROM s)"""


@query(world(SQL_SPECIAL) + """SELECT id, kind, concat_ws(';', CASE WHEN kind = 'SPIRIT_TREE' AND sarim AND c % 2 <> 0 THEN 'Player-planted spirit tree is not available: PortSarimTree' END, CASE WHEN kind = 'SPIRIT_TREE' AND guild AND c % 3 <> 1 THEN 'Player-planted spirit tree is not available: FarmingGuildTree' END,
  CASE WHEN house AND kind = 'FAIRY_RING' AND c % 4 >= 2 THEN 'POH fairy ring is not built' WHEN house AND kind = 'SPIRIT_TREE' AND c % 5 >= 3 THEN 'POH spirit tree is not built' WHEN house AND kind = 'WILDERNESS_OBELISK' AND c % 2 = 0 THEN 'POH obelisk is not built' END,
  CASE kind WHEN 'FAIRY_RING' THEN CASE WHEN c % 3 = 0 THEN 'Fairy rings are not unlocked' WHEN c % 5 <> 0 AND c % 4 <> 0 THEN 'Fairy rings require a Dramen or Lunar staff' END
  WHEN 'TELEPORTATION_BOX' THEN CASE WHEN info = 'Amulet of Glory' AND c % 2 <> 0 THEN 'Mounted amulet of glory is not built' WHEN info = 'Xeric''s Talisman' AND c % 3 <> 0 THEN 'Mounted Xeric''s talisman is not built' WHEN info = 'Digsite Pendant' AND c % 2 <> 1 THEN 'Mounted Digsite pendant is not built' WHEN info = 'Mythical cape' AND c % 7 <> 0 THEN 'Mounted mythical cape is not built'
    WHEN info LIKE 'Basic%' AND c % 3 = 0 THEN 'Basic jewellery box is not built' WHEN info LIKE 'Ornate%' AND c % 3 < 2 THEN 'Ornate jewellery box is not built' WHEN info LIKE 'Fancy%' AND c % 3 < 1 THEN 'Fancy jewellery box is not built' END
  WHEN 'TELEPORTATION_PORTAL_POH' THEN CASE WHEN c % 6 <> 0 AND c % 4 <> portal THEN 'POH portal is not built' END END) AS failures FROM k""")
def special_failures(spark, sf):
    """Planted trees, house rooms, fairy rings, boxes and portals that an account lacks, in order."""
    k, c = col("o_orderkey"), col("o_custkey")
    kinds, infos = ("SPIRIT_TREE", "FAIRY_RING", "TELEPORTATION_BOX", "TELEPORTATION_PORTAL_POH", "WILDERNESS_OBELISK"), ("Amulet of Glory", "Xeric's Talisman", "Digsite Pendant", "Mythical cape", "Basic Jewellery Box", "Ornate Jewellery Box", "Fancy Jewellery Box", "Portal")
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    ox = F.when(k % 3 == 0, 3055 + k % 12).when(k % 3 == 1, 1850 + k % 20).otherwise(100)
    oy = F.when(k % 3 == 0, 3253 + k % 11).when(k % 3 == 1, 5690 + k % 19).otherwise(100)
    trees = F.concat(F.when(c % 2 == 0, F.array(F.lit("PortSarimTree"))).otherwise(F.array().cast("array<string>")), F.when(c % 3 == 1, F.array(F.lit("FarmingGuildTree"))).otherwise(F.array().cast("array<string>")))
    account = F.struct(
        trees.alias("trees"), (c % 3 != 0).alias("fairy_rings"), (c % 4 == 0).alias("staff"), (c % 5 == 0).alias("lumbridge_elite"), (c % 4 < 2).alias("house_fairy_ring"), (c % 5 < 3).alias("house_spirit_tree"), (c % 2 == 1).alias("house_obelisk"),
        (c % 2 == 0).alias("glory"), (c % 3 == 0).alias("xerics"), (c % 2 == 1).alias("digsite"), (c % 7 == 0).alias("mythical"), (c % 3).alias("box"), (c % 6 == 0).alias("all_portals"), F.array(F.concat(F.lit("Portal "), (c % 4).cast("string"))).alias("portals"),
    )
    o = D.table(spark, sf, "orders").select(k.alias("id"), pick(kinds, k % 5).alias("kind"), pick(infos, k % 8).alias("info"), F.concat(F.lit("Portal "), (k % 4).cast("string")).alias("display"), S.pack_tile(ox, oy, F.lit(0)).alias("origin"), S.pack_tile(1249 + c % 10, 3746 + c % 9, F.lit(0)).alias("destination"), account.alias("account"))
    return o.select("id", "kind", F.array_join(A.special_failures(col("kind"), col("info"), col("display"), col("origin"), col("destination"), col("account")), ";").alias("failures"))


ENABLED = "CASE account % 3 WHEN 0 THEN true WHEN 1 THEN o_orderpriority IN ('1-URGENT', '2-HIGH') ELSE o_orderpriority <> '5-LOW' END"


@query(world(REQ, SQL_CHECK) + f"SELECT checked.id, CASE WHEN NOT ({ENABLED}) THEN 'TypeDisabled ' || o_orderpriority WHEN items_ok AND skills_ok AND quests_ok AND vars_failed = 0 AND vars_unknown = 0 THEN 'Available' ELSE concat_ws(',', CASE WHEN NOT items_ok THEN 'MissingItems' END, CASE WHEN NOT skills_ok THEN 'MissingSkills' END, CASE WHEN NOT quests_ok THEN 'MissingQuests' END, CASE WHEN vars_failed > 0 THEN 'FailedVarRequirements ' || vars_failed END, CASE WHEN vars_unknown > 0 THEN 'UnknownVarRequirements ' || vars_unknown END) END AS explanation FROM checked JOIN orders ON o_orderkey = checked.id")
def transport_explanations(spark, sf):
    """Why an account can't use a transport: its type first, then all failures in order. No enabled types means that all are."""
    o = D.table(spark, sf, "orders").select(col("o_orderkey").alias("id"), col("o_orderpriority").alias("type"))
    some = lambda *xs: F.array(*map(F.lit, xs))
    enabled = F.when(col("account") % 3 == 0, F.array().cast("array<string>")).when(col("account") % 3 == 1, some("1-URGENT", "2-HIGH")).otherwise(some("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"))
    j = checked_requirements(spark, sf).join(o, "id").withColumn("enabled", enabled)
    on = (F.size("enabled") == 0) | F.array_contains("enabled", col("type"))
    number = lambda name, c: F.when(col(c) > 0, F.concat(F.lit(name), col(c).cast("string")))
    failures = F.concat_ws(",", F.when(~col("items_ok"), "MissingItems"), F.when(~col("skills_ok"), "MissingSkills"), F.when(~col("quests_ok"), "MissingQuests"), number("FailedVarRequirements ", "vars_failed"), number("UnknownVarRequirements ", "vars_unknown"))
    return j.select("id", F.when(~on, F.concat(F.lit("TypeDisabled "), "type")).when(col("available"), "Available").otherwise(failures).alias("explanation"))


@query(world(SQL_ITEMS) + "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE name END AS name, CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE ids[1] END AS first_id, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE len(ids) END AS variants FROM part JOIN names ON i = p_partkey % 31")
def item_variants(spark, sf):
    """Item names to the ids that they stand for; digits stand for themselves."""
    k = col("p_partkey")
    name = F.when(k % 4 == 0, k.cast("string")).otherwise(F.get(F.array(*map(F.lit, A.ITEM_IDS)), (k % 31).cast("int")))
    return D.table(spark, sf, "part").select("p_partkey", name.alias("name")).withColumn("ids", A.item_ids(col("name"))).select("p_partkey", "name", col("ids")[0].cast("long").alias("first_id"), F.size("ids").cast("long").alias("variants"))


@query(world(SQL_ITEMS) + "SELECT o_custkey AS account, ids[1] AS item, CAST(sum(o_orderkey % 7 + 1) AS BIGINT) AS qty FROM orders JOIN names ON i = o_orderkey % 31 GROUP BY 1, 2")
def account_items(spark, sf):
    """Loadouts compiled to item ids: a name's first variant, quantities of one item added."""
    k = col("o_orderkey")
    rows = D.table(spark, sf, "orders").select(col("o_custkey").alias("account"), F.get(F.array(*map(F.lit, A.ITEM_IDS)), (k % 31).cast("int")).alias("name"), (k % 7 + 1).alias("qty"))
    return rows.groupBy("account", A.item_ids(col("name"))[0].alias("item")).agg(F.sum("qty").alias("qty"))


@query(world(REQ, SQL_CHECK, "ok AS (SELECT * FROM checked WHERE items_ok AND skills_ok AND quests_ok)", "p AS (SELECT account, count(*) AS n, bit_xor(xor(id * 2654435761 & 1099511627775, id)) AS print FROM ok GROUP BY 1)") + "SELECT account, n, print, count(*) OVER (PARTITION BY n, print) AS alike FROM p")
def routing_fingerprints(spark, sf):
    """An order-free fingerprint of what each account can use: accounts of one fingerprint can share their search."""
    ok = checked_requirements(spark, sf).where("items_ok AND skills_ok AND quests_ok")
    mixed = (col("id") * F.lit(2654435761).cast("long")).bitwiseAND(F.lit(1099511627775).cast("long")).bitwiseXOR(col("id"))
    p = ok.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mixed).alias("print"))
    return p.join(p.groupBy("n", "print").agg(F.count(F.lit(1)).alias("alike")), ["n", "print"]).select("account", "n", "print", "alike")


@query(world(REQ, SQL_VARS) + "SELECT account % 4 AS profile, count(*) AS requirements, count(DISTINCT id) FILTER (WHERE id % 3 = account % 3) AS unknown_vars, count(*) FILTER (WHERE id % 3 = account % 3) = 0 AS strict_ok FROM vars GROUP BY 1")
def strict_gaps(spark, sf):
    """Profiles that a strict run refuses: variables that a transport asks for and the profile lacks."""
    v = requirement_rows(spark, sf).select("account", F.inline(S.parse_vars(col("vars_text"))))
    gap = col("id") % 3 == col("account") % 3
    return v.groupBy((col("account") % 4).alias("profile")).agg(F.count(F.lit(1)).alias("requirements"), F.countDistinct(F.when(gap, col("id"))).alias("unknown_vars"), (F.count_if(gap) == 0).alias("strict_ok"))


@query(world(TR) + "SELECT id % 7 AS account, type, duration + CASE WHEN id % 7 < 4 THEN (id % 7) * 5 ELSE 0 END AS cost, count(*) AS n FROM transports GROUP BY 1, 2, 3")
def penalised_costs(spark, sf):
    """Costs with an account's penalties: kept for types that it can use and where they aren't 0."""
    t = D.transports(spark, sf).withColumn("account", col("id") % 7)
    types = t.select("type").distinct().crossJoin(spark.range(7).withColumnRenamed("id", "account"))
    kept = types.select("account", "type", F.when(col("account") < 4, col("account") * 5).otherwise(0).alias("penalty")).where("penalty <> 0")
    j = t.join(kept, ["account", "type"], "left").withColumn("cost", S.add_cost(col("duration"), F.coalesce("penalty", F.lit(0).cast("long"))))
    return j.groupBy("account", "type", "cost").agg(F.count(F.lit(1)).alias("n"))


@query(world(TR, REQ, r"k AS (SELECT id, list({'level': TRY_CAST(regexp_extract(piece, '^(\d+) ', 1) AS INTEGER), 'skill': regexp_extract(piece, '^\d+ (.*)$', 1)} ORDER BY i) FILTER (WHERE regexp_matches(piece, '^\d+ .+$')) AS skills FROM (SELECT id, unnest(string_split(skills_text, ';')) AS piece, unnest(range(len(string_split(skills_text, ';')))) AS i FROM req) GROUP BY id)")
 + "SELECT t.id, concat_ws('|', type, CASE WHEN origin IS NULL THEN '' ELSE concat(origin & 32767, '/', (origin >> 15) & 32767, '/', origin >> 30) END, concat(destination & 32767, '/', (destination >> 15) & 32767, '/', destination >> 30), duration, concat('Ride ', t.id % 11), '', CASE WHEN status = 'F' THEN 'True' ELSE 'False' END, max_level, concat('orders:', t.id + 1), CAST(to_json({'skills': skills}) AS VARCHAR)) AS transport_id FROM transports t JOIN k ON k.id = t.id")
def transport_ids(spark, sf):
    """The natural key of a transport: ten fields, requirements as JSON."""
    r = requirement_rows(spark, sf).select("id", F.to_json(F.struct(S.parse_skills(col("skills_text")).alias("skills"))).alias("json"))
    text = lambda c: F.when(col(c).isNull(), "").otherwise(S.coordinate_text(S.tile_x(col(c)), S.tile_y(col(c)), S.tile_plane(col(c))))
    s = lambda c: c.cast("string")
    fields = [col("type"), text("origin"), text("destination"), s(col("duration")), F.concat(F.lit("Ride "), s(col("id") % 11)), F.lit(""), F.when(col("status") == "F", "True").otherwise("False"), F.coalesce(s(col("max_level")), F.lit("")), F.concat(F.lit("orders:"), s(col("id") + 1)), col("json")]
    return D.transports(spark, sf).join(r, "id").select("id", F.concat_ws("|", *fields).alias("transport_id"))
