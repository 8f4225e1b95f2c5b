import itertools
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import requirements as R
from wayfold.functions import scalars as S
from wayfold.operators import graph as G
from wayfold.plans import accounts, bounds, facts, wild  # noqa: F401
from wayfold.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(Q.QUERIES[name], Q.ORACLE_SQL[name])


def test_replay_holds(spark):
    rows = Q.sp_route_replay(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and rows.where("NOT valid").count() == 0


def test_paths_over_many_regions_equal_dijkstra(spark):
    """Random costs over regions of 4 by 4 tiles, two layers and a hub, against a heap; replayed step by step."""
    import heapq

    r = random.Random(8)
    node = lambda: (r.randrange(24) | r.randrange(24) << 15) * 2 + r.randrange(2)
    some = [node() for _ in range(150)]
    edges = {(r.choice(some), r.choice(some)): r.randint(1, 9) for _ in range(420)} | {(s, -1): 0 for s in some[:5]} | {(-1, d): 7 for d in some[50:60]}
    starts = {0: some[0], 1: some[7]}
    rows = spark.createDataFrame([(q, s, d, w, "walk") for q in starts for (s, d), w in edges.items()], "query_id long, s long, d long, w long, step string")
    found = G.shortest_paths(rows, spark.createDataFrame(list(starts.items()), "query_id long, node long"), region=4)
    got = {(x["query_id"], x["node"]): x["cost"] for x in found.collect()}
    want = {}
    for q, s in starts.items():
        heap = [(0, s)]
        while heap:
            c, n = heapq.heappop(heap)
            if (q, n) not in want:
                want[q, n] = c
                for (a, b), w in edges.items():
                    if a == n:
                        heapq.heappush(heap, (c + w, b))
    assert got == want
    targets = [(q, n) for q, n in want if n >= 0 and want[q, n]][:40]
    steps = G.route_steps(G.predecessors(rows, found), spark.createDataFrame(targets, "query_id long, target long"))
    routes = {}
    for x in steps.orderBy("query_id", "target", "step_no").collect():
        routes.setdefault((x["query_id"], x["target"]), []).append((x["step_no"], x["node"], x["cost"]))
    assert set(routes) == set(targets)
    for (q, n), route in routes.items():
        at, cost = starts[q], 0
        for i, (no, node_, c) in enumerate(route):
            assert no == i + 1 and edges[at, node_] == c - cost
            at, cost = node_, c
        assert at == n and cost == want[q, n]


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_scalars(spark):
    assert one(spark, S.parse_tile(F.lit("3 4 2"))) == 3 | 4 << 15 | 2 << 30
    assert one(spark, S.parse_tile(F.lit("3 4"))) is None
    assert one(spark, S.add_cost(F.lit(2**63 - 1), F.lit(1))) is None
    assert one(spark, S.add_cost(F.lit(1), F.lit(-1))) is None
    assert one(spark, S.weighted_priority(F.lit(1), F.lit(0.5), F.lit(5.0))) == 3  # half to even
    assert [tuple(r) for r in one(spark, S.parse_skills(F.lit("75 Construction;x; 8 Deep Sea Fishing")))] == [(75, "Construction"), (8, "Deep Sea Fishing")]
    assert one(spark, S.parse_items(F.lit(" "))) is None
    with pytest.raises(Exception, match="malformed item term"):
        one(spark, S.parse_items(F.lit("COINS")))
    value = 2166136261
    for c in b"route":
        value = (value ^ c) * 16777619 % 2**32
    assert one(spark, S.fnv1a32(F.lit("route"))) == value
    value = 2166136261
    for c in "né日\U0001f600":
        value = (value ^ int.from_bytes(c.encode("utf-16-be")[:2])) * 16777619 % 2**32
    assert one(spark, S.fnv1a32(F.lit("né日\U0001f600"))) == value and one(spark, S.fnv1a32(F.lit(""))) == 2166136261
    assert one(spark, S.parse_coordinate(F.lit("1, 2 3"))) == [1, 2, 3]
    assert one(spark, S.capability(F.lit(3000), F.lit(3762))) == "NoGlobals"
    assert one(spark, S.capability(F.lit(3000), F.lit(3700))) == "WildernessGlobals"


def test_requirements(spark):
    bag = F.create_map(F.lit("A"), F.lit(2).cast("long"))
    assert one(spark, R.items_met(S.parse_items(F.lit("A=3|A=2&B=0")), bag))
    assert not one(spark, R.items_met(S.parse_items(F.lit("A=3")), bag))
    cooldown = lambda now: R.var_result(F.struct(F.lit("@").alias("op"), F.lit(20).alias("value")), F.lit(109), F.lit(now))
    assert one(spark, cooldown(130)) == "pass"
    assert one(spark, cooldown(129)) == "fail"
    assert one(spark, R.var_result(F.struct(F.lit("=").alias("op"), F.lit(1).alias("value")), F.lit(None).cast("long"), F.lit(0))) == "unknown"


def test_thinning_equals_comparing_all():
    import pandas as pd

    r = random.Random(6)
    rows = pd.DataFrame([("n", r.randrange(-60, 200), r.randrange(-60, 200), i) for i in range(900)], columns=["name", "x", "y", "id"])
    kept = []
    for x in sorted(rows.itertuples(index=False), key=lambda p: (p.x, p.y, p.id)):
        if all(max(abs(x.x - k.x), abs(x.y - k.y)) > 12 for k in kept):
            kept.append(x)
    got = Q.thin_places(rows)
    assert list(got["id"]) == [k.id for k in kept] and len(kept) < 300


def test_queries_without_sql_run(spark):
    for name in sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)):
        assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name


def test_wilderness_corridor(spark):
    """Globals need a tile that may activate them: costs 1, 81 and 83 of the corridor case."""
    y0, y1 = 3678, 3762
    tiles = spark.createDataFrame([(3000, y, 0) for y in range(y0, y1 + 1)] + [(500, 500, 0), (600, 600, 0)], "x long, y long, p long").withColumn("tile", S.pack_tile(F.col("x"), F.col("y"), F.col("p")))
    pack = lambda x, y: x | y << 15
    local = spark.createDataFrame([], "origin long, destination long, cost long, banked long")
    globals_ = spark.createDataFrame([(pack(500, 500), 1, 0, 0), (pack(600, 600), 1, 1, 0)], "destination long, cost long, level int, banked long")
    edges = G.state_edges(G.walk_edges(tiles), local, None, tiles, globals_)
    cost = {}
    for q, start in enumerate([pack(3000, 3678), pack(3000, 3760), pack(3000, 3762)]):
        starts = spark.createDataFrame([(q, start * 2)], "query_id long, node long")
        for r in G.shortest_paths(edges.withColumn("query_id", F.lit(q).cast("long")), starts).collect():
            cost[q, r["node"]] = r["cost"]
    assert cost[0, pack(500, 500) * 2] == 1
    assert cost[1, pack(500, 500) * 2] == 3  # a step, the wilderness global, then the other one
    assert cost[2, pack(600, 600) * 2] == 4


def test_star_components_random(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    got = {x["node"]: x["root"] for x in G.star_components(spark.createDataFrame(edges, "s long, d long")).collect()}
    parent = list(range(60))
    for _ in range(60):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    for n in set(itertools.chain(*edges)):
        if n in got:
            assert got[n] == parent[n]


def test_components_over_region_borders(spark):
    tiles = spark.createDataFrame([(x, 5, 0) for x in range(50, 200)] + [(10, 5, 0)], "x long, y long, p long").withColumn("tile", S.pack_tile(F.col("x"), F.col("y"), F.col("p")))
    got = G.natural_components(tiles, G.walk_edges(tiles)).groupBy("component_id").count().collect()
    assert sorted(r["count"] for r in got) == [1, 150]


def test_entry_without_training_data_operators():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and set(Q.ORACLE_SQL) <= set(e.oracle_sql())
