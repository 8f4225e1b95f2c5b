import hashlib
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import identity
from wayfold.sources import facts, files

HEADER = "# Origin\tDestination\tDuration\tDisplay info\tConsumable\tWilderness level\tSkills\tItems\tQuests\tVarbits\tVarPlayers"


def tile(x, y, p=0):
    return x | y << 15 | p << 30


def test_tsv_rows(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("# a\tb\tc\n\n# remark\n\t\t\n1\t2\n3\t4\t5\t6\n")
    rows = files.read_tsv(spark, str(path))
    assert rows.columns == ["a", "b", "c"]
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "2", ""), ("3", "4", "5")]
    path.write_text("")
    assert files.read_tsv(spark, str(path)).count() == 0


def test_transports_and_permutations(spark, tmp_path):
    (tmp_path / "ring.tsv").write_text("\n".join([
        HEADER,
        "1 1 0\t\t3\tring\t\t20\t10 Magic\tA=1\tQ1\t1=2\t",
        "\t50 50 0\t4\tgate\tyes\t30\t10 Magic\tB=1|C=2\tQ2\t\t",
        "\t3 3 0\t1\tnear\t\t\t\t\t\t\t",
        "5 5 0\t6 6 0\tbad\tdirect\t\t\t\t\t\t\t",
    ]) + "\n")
    (tmp_path / "spell.tsv").write_text(HEADER + "\n\t9 9 1\t0\t\t\t\t\t\t\t\t\n")
    got = {(r["origin"], r["destination"]): r for r in files.read_transports(spark, str(tmp_path), {"RING": ("ring.tsv", False, 5), "SPELL": ("spell.tsv", True, 0)}).collect()}
    assert set(got) == {(tile(5, 5), tile(6, 6)), (tile(1, 1), tile(50, 50)), (None, tile(9, 9, 1))}
    r = got[tile(1, 1), tile(50, 50)]
    assert (r["duration"], r["label"], r["consumable"], r["max_wilderness_level"]) == (4, "gate", True, 30)
    assert [tuple(x) for x in r["skills"]] == [(10, "Magic")] and r["quests"] == ["Q1", "Q2"]
    assert [[t["name"] for t in a] for a in r["items"]] == [["A", "B"], ["A", "C"]]
    assert got[None, tile(9, 9, 1)]["duration"] == 1 and got[None, tile(9, 9, 1)]["label"] == "SPELL"


def collision(path, east=(), north=()):
    bits = np.zeros(4 * 64 * 64 * 2, dtype=bool)
    for tiles, flag in ((north, 0), (east, 1)):
        for x, y in tiles:
            bits[((y & 63) * 64 + (x & 63)) * 2 + flag] = True
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("0_0", np.packbits(bits, bitorder="little").tobytes())
        z.writestr("notes.txt", b"none")


def test_collision_and_separator(spark, tmp_path):
    collision(tmp_path / "c.zip", east=[(x, 10) for x in range(10, 14)] + [(20, 20)], north=[(30, 30)])
    (tmp_path / "s.json").write_text(json.dumps({"format": "v", "topologyIdentity": "i", "cutEdges": [{"from": [13, 10, 0], "to": [12, 10, 0]}]}))
    flags = files.read_collision(spark, str(tmp_path / "c.zip"))
    walkable = {r["tile"] for r in files.walkable_tiles(flags).collect()}
    assert walkable == {tile(x, 10) for x in range(10, 15)} | {tile(20, 20), tile(21, 20), tile(30, 30), tile(30, 31)}
    cuts = files.read_separator(spark, str(tmp_path / "s.json"))
    assert [tuple(r) for r in cuts.collect()] == [(tile(12, 10), tile(13, 10))]
    topology = files.topology_tables(spark, flags, cuts)
    counts = topology.agg(F.countDistinct("component_id"), F.countDistinct("routing_component_id"), F.count(F.lit(1))).first()
    assert tuple(counts) == (3, 4, 9)


def test_banks_routes_oracle(spark, tmp_path):
    (tmp_path / "banks.tsv").write_text("# Destination\tname\n1 2 0\tx\nbad\ty\n")
    assert [r["tile"] for r in files.read_banks(spark, str(tmp_path / "banks.tsv")).collect()] == [tile(1, 2)]
    (tmp_path / "routes.json").write_text(json.dumps([{"name": "r", "start": [1, 2, 0], "target": [3, 4, 0], "allowTransports": True}]))
    r = files.read_routes(spark, str(tmp_path / "routes.json")).first()
    assert (r["id"], r["category"], r["tiers"], r["start"]) == (None, "unknown", [], [1, 2, 0])
    (tmp_path / "oracle.json").write_text(json.dumps({"a/b/early": {"reachable": True, "cost": 7}, "c/max": {"reachable": False}}))
    assert sorted(tuple(r) for r in files.read_oracle(spark, str(tmp_path / "oracle.json")).collect()) == [("a/b", "early", True, 7), ("c", "max", False, None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "x"'), (2, None)], "id long, t string").coalesce(1)
    files.write_csv(rows, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[:2] == ['"id","t"', '"1","say ""x"""']
    files.append_results(rows, str(tmp_path / "log"))
    files.append_results(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_tsv_keeps_rows_like_the_header_and_counts_lines(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_bytes(b"# a\tb\r\n# remark\r\na\tb\r\n\r\n1\t2\r\n")
    assert sorted(tuple(r) for r in files.read_tsv(spark, str(path), line="at").collect()) == [(3, "a", "b"), (5, "1", "2")]


def test_house_rows(spark):
    rows = [("BOX", tile(1860, 5700), tile(5, 5)), ("BOX", tile(1923, 5709), tile(5, 5)), ("BOX", tile(1861, 5700), tile(6, 6)), ("BOAT", tile(1, 1), tile(2, 2))]
    got = {tuple(r) for r in files.with_house_aliases(spark.createDataFrame(rows, "type string, origin long, destination long")).collect()}
    assert got == {*rows, ("BOX", tile(1923, 5709), tile(6, 6))}


def test_profiles(spark, tmp_path):
    profile = {"levels": {"Magic": 50}, "quests": ["Q", "Q"], "varbits": {"7": 1}, "varplayers": {}, "inventory": {"COINS": 5, "995": 2, "AIR_RUNE": 1}, "equipment": {}, "runePouch": {}, "bank": {"4151": 1}, "diaries": {"Varrock": "Hard"}, "plantedSpiritTrees": ["PORT_SARIM", "HosidiusTree"], "fairyRingsUnlocked": True}
    write = lambda **change: (tmp_path / "p.json").write_text(json.dumps({"formatVersion": 1, "nowMinutes": 9, "profiles": {"mid": profile}} | change))
    write()
    r = files.read_profiles(spark, str(tmp_path / "p.json")).first()
    assert (r["account"], r["now_minutes"], r["quests"], r["varbits"], r["inventory"], r["bank"]) == ("mid", 9, ["Q"], {7: 1}, {995: 7, 556: 1}, {4151: 1})
    assert r["diaries"] == {"Varrock": 3} and r["trees"] == ["PortSarimTree", "HosidiusTree"] and r["fairy_rings"]
    for change in ({"formatVersion": 2}, {"profiles": {"x": profile | {"diaries": {"Varrock": "Best"}}}}, {"profiles": {"x": profile | {"varbits": {"a": 1}}}}, {"profiles": {"x": profile | {"bank": {"NOTHING": 1}}}}, {"profiles": {"x": profile | {"plantedSpiritTrees": ["OAK"]}}}):
        write(**change)
        with pytest.raises(Exception, match="unsupported|unknown|invalid"):
            files.read_profiles(spark, str(tmp_path / "p.json")).collect()


def test_writers_round_trip(spark, tmp_path):
    rows = [("a/b", "early", True, 7), ("c", "max", False, None)]
    files.write_oracle(spark.createDataFrame(rows, "route string, profile string, reachable boolean, cost long"), str(tmp_path / "oracle"))
    assert sorted(tuple(r) for r in files.read_oracle(spark, str(tmp_path / "oracle")).collect()) == rows
    cuts = spark.createDataFrame([(tile(13, 10), tile(12, 10)), (tile(12, 10), tile(13, 10)), (tile(1, 2, 3), tile(2, 2, 3))], "a long, b long")
    files.write_separator(cuts, str(tmp_path / "cuts"), "fnv1a64:0", {"randomSeed": 42}, "v1")
    assert sorted(tuple(r) for r in files.read_separator(spark, str(tmp_path / "cuts")).collect()) == sorted([(tile(12, 10), tile(13, 10)), (tile(1, 2, 3), tile(2, 2, 3))])
    files.append_results(spark.createDataFrame([("r", "p", False), ("r", "p", False), ("r", "q", True)], "route string, profile string, correct boolean"), str(tmp_path / "log"))
    assert [tuple(r) for r in files.read_failures(spark, str(tmp_path / "log")).collect()] == [("r", "p")]
    (tmp_path / "x").write_bytes(b"abc")
    assert files.file_digests(spark, str(tmp_path / "x"), str(tmp_path / "none")) == hashlib.sha256(b"abc").hexdigest() + ":missing"


def test_walking_identity(spark, tmp_path):
    collision(tmp_path / "c.zip", east=[(10, 10), (11, 10)])
    flags = files.read_collision(spark, str(tmp_path / "c.zip"))
    want, near = 14695981039346656037, {10: [11], 11: [10, 12], 12: [11]}
    for x, others in near.items():
        for value in (tile(x, 10), -1, *(tile(o, 10) for o in others), -2):
            for byte in struct.pack("<q", value):
                want = (want ^ byte) * 1099511628211 % 2**64
    assert identity.walking_identity(files.walkable_tiles(flags), files.passable_edges(flags)) == f"fnv1a64:{want:016x}"


def test_fact_base(spark, tmp_path):
    collision(tmp_path / "c.zip", east=[(x, 10) for x in range(10, 14)] + [(20, 20), (40, 40)], north=[(30, 30)])
    flags = files.read_collision(spark, str(tmp_path / "c.zip"))
    moves = spark.createDataFrame([("t1", "BOAT", tile(10, 10), tile(20, 20), 3), ("t2", "SPELL", None, tile(30, 31), 1), ("t3", "BOAT", tile(13, 12), tile(50, 50), 1)], "transport_id string, type string, origin long, destination long, duration long")
    banks = spark.createDataFrame([(tile(12, 10),)], "tile long")
    places = spark.createDataFrame([("p1", "bank", tile(12, 10), "gps", "bank"), ("p2", "field", tile(40, 41), "gps", "x"), ("p3", "sea", tile(60, 60), "gps", "x"), ("p4", "far", tile(30, 30), "gps", "x")], "place_id string, name string, tile long, source string, source_kind string")
    cuts = spark.createDataFrame([(tile(12, 10), tile(13, 10))], "a long, b long")
    facts.write_facts(facts.fact_tables(spark, flags, moves, banks, places, cuts), str(tmp_path / "facts"))
    facts.register_facts(spark, str(tmp_path / "facts"))
    rows = lambda q: sorted(tuple(r) for r in spark.sql(q).collect())
    assert rows("SELECT place_id, status, access_kind FROM place_facts") == [("p1", "reachable", "walkable"), ("p2", "unreachable_component", "snapped"), ("p3", "unresolved", "unresolved"), ("p4", "reachable", "walkable")]
    assert rows("SELECT count(*) FROM reachable_tiles") == [(9,)] and rows("SELECT count(*) FROM components") == [(4,)]
    assert rows("SELECT from_x, to_x, cost FROM separator_crossings") == [(12, 13, 1)]
    assert rows("SELECT tile_count, separator_crossing_count, neighbouring_component_count FROM routing_components") == [(2, 0, 0), (2, 0, 0), (2, 0, 0), (2, 1, 1), (3, 1, 1)]
    assert rows("SELECT transport_id, origin_access_kind, destination_access_kind, origin_structurally_reachable FROM transport_facts") == [("t1", "walkable", "walkable", True), ("t2", None, "walkable", None), ("t3", "unresolved", "unresolved", None)]
    assert rows("SELECT value FROM metadata WHERE key = 'walkable_tiles'") == [("11",)]


def test_variable_registry(spark, tmp_path):
    (tmp_path / "defs").mkdir()
    (tmp_path / "defs" / "a.tsv").write_text("# Origin\tVarbits\n1 1 0\t12=3;x;7@5\n# note\n\n2 2 0\t12>0012;12=3\n")
    (tmp_path / "defs" / "b.tsv").write_text("# Varbits\tVarPlayers\r\n7@5\t4&1\r\n")
    (tmp_path / "defs" / "c.tsv").write_text("# Origin\n1 1 0\n")
    (tmp_path / "Bits.java").write_text("public static final int OLD = 12;\n public static final int DOOR_2 = 12;\npublic static final int SEVEN = 7;")
    (tmp_path / "Players.java").write_text("public static final int FOUR = 4;")
    kinds = {"varbit": ("Varbits", str(tmp_path / "Bits.java")), "varplayer": ("VarPlayers", str(tmp_path / "Players.java"))}
    got = files.variable_registry(spark, str(tmp_path / "defs"), kinds)
    want = [
        ("varbit", 7, "SEVEN", "@5", 2, "a.tsv:2 7@5 | b.tsv:2 7@5"), ("varbit", 12, "DOOR_2", "=3;>12", 3, "a.tsv:2 12=3 | a.tsv:5 12>0012 | a.tsv:5 12=3"),
        ("varplayer", 4, "FOUR", "&1", 1, "b.tsv:2 4&1"),
    ]
    assert [tuple(r) for r in got.orderBy("kind", "id").collect()] == want
    files.write_registry(got, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0].split("\t")[:2] == ["kind", "id"] and [x.split("\t")[1] for x in lines[1:]] == ["7", "12", "4"]
    (tmp_path / "Bits.java").write_text("")
    with pytest.raises(Exception, match="no name for varbit"):
        files.variable_registry(spark, str(tmp_path / "defs"), kinds).collect()
