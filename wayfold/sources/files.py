"""Readers of the external files: tab-separated rows, transports, banks, collision bitmaps, separators and route corpora."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import accounts as A
from ..functions import scalars as S
from ..operators import graph as G

REGION = 64
ROUTE_DDL = (
    "id string, name string, category string, distanceTag string, planeTag string, start array<long>, target array<long>, "
    "allowTransports boolean, tiers array<string>, negativeProfiles array<string>"
)
SEPARATOR_DDL = "format string, topologyIdentity string, cutEdges array<struct<from: array<long>, to: array<long>>>"


def read_tsv(spark: SparkSession, path: str, line: str | None = None) -> DataFrame:
    """Rows of a tab-separated definition file as string columns, and the line numbers (from 1) as ``line`` if that is given. The first line names
    the columns, after an optional ``#``; blank lines, comments and lines of tabs alone are dropped, short rows are padded with ""
    and surplus fields ignored. A file without lines gives no columns. Files are read whole, one task each."""
    first = spark.read.text(path).first()
    if first is None:
        return spark.createDataFrame([], "")
    names = re.sub("^# ?", "", first["value"]).split("\t")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    data = lines.where((F.col("at") > 0) & F.col("value").rlike(r"[^\t]") & ~F.col("value").startswith("#"))
    cells = F.split("value", "\t", -1)
    number = [(F.col("at") + 1).cast("long").alias(line)] if line else []
    return data.select(*number, *(F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def _cell(df: DataFrame, name: str):
    return F.col(f"`{name}`") if name in df.columns else F.lit("")


def transport_rows(rows: DataFrame, type_name: str, teleport: bool = False) -> DataFrame:
    """Parsed transports of one type's rows; a coordinate that doesn't parse is null."""
    cell = lambda n: _cell(rows, n)
    return rows.select(
        F.lit(type_name).alias("type"), S.parse_tile(cell("Origin")).alias("origin"), S.parse_tile(cell("Destination")).alias("destination"),
        S.duration(cell("Duration"), F.lit(teleport)).alias("duration"), S.label(cell("Display info"), F.lit(type_name)).alias("label"),
        S.consumable(cell("Consumable")).alias("consumable"), cell("Wilderness level").try_cast("int").alias("max_wilderness_level"),
        S.parse_skills(cell("Skills")).alias("skills"), S.parse_items(cell("Items")).alias("items"), S.parse_quests(cell("Quests")).alias("quests"),
        S.parse_vars(cell("Varbits")).alias("varbits"), S.parse_vars(cell("VarPlayers")).alias("varplayers"),
    )


def with_permutations(raw: DataFrame, radius: int, global_type: bool, salts: int = 16) -> DataFrame:
    """Rows with both ends, globals where the type has them, and every origin-only row with every destination-only row further off than
    ``radius``. A permuted row takes its destination's label, the larger duration and level, and the requirements of both.

    The product of one type is dealt to ``salts`` keys: origins by hash, destinations (a definition file's lines) to all of them.
    """
    both = F.col("origin").isNotNull() & F.col("destination").isNotNull() & (F.col("origin") != F.col("destination"))
    direct = raw.where(both | (F.col("origin").isNull() & F.col("destination").isNotNull() & F.lit(global_type)))
    lists = ("skills", "quests", "varbits", "varplayers")
    ends = raw.where("origin IS NULL AND destination IS NOT NULL").select("type", F.col("destination").alias("to"), F.col("duration").alias("more"), F.col("items").alias("items_to"), F.col("label").alias("label_to"), F.col("consumable").alias("used"), F.col("max_wilderness_level").alias("level_to"), *(F.col(c).alias(f"{c}_to") for c in lists))
    far = S.chebyshev_flat(S.tile_x(F.col("origin")), S.tile_y(F.col("origin")), S.tile_x(F.col("to")), S.tile_y(F.col("to"))) > radius
    ends = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    starts = raw.where("origin IS NOT NULL AND destination IS NULL").withColumn("salt", F.pmod(F.xxhash64("origin"), F.lit(salts)).cast("int"))
    pairs = starts.join(ends, ["type", "salt"]).where(far)
    alternatives = F.flatten(F.transform("items", lambda a: F.transform(F.col("items_to"), lambda b: F.concat(a, b))))
    pairs = pairs.withColumn("items", F.when(F.col("items").isNull(), F.col("items_to")).when(F.col("items_to").isNull(), F.col("items")).otherwise(alternatives))
    for c in lists:
        pairs = pairs.withColumn(c, F.array_distinct(F.concat(c, f"{c}_to")))
    pairs = pairs.withColumn("label", F.col("label_to")).withColumn("consumable", F.col("consumable") | F.col("used"))
    pairs = pairs.withColumn("max_wilderness_level", F.greatest("max_wilderness_level", "level_to"))
    pairs = pairs.withColumn("destination", F.col("to")).withColumn("duration", F.greatest("duration", "more"))
    return direct.unionByName(pairs.select(*raw.columns))


def read_transports(spark: SparkSession, folder: str, types: Mapping[str, tuple[str, bool, int]]) -> DataFrame:
    """Transports of all ``types``: name -> (file, teleport, permutation radius)."""
    out = None
    for name, (file, teleport, radius) in types.items():
        part = with_permutations(transport_rows(read_tsv(spark, f"{folder}/{file}"), name, teleport), radius, teleport or name == "SEASONAL_TRANSPORTS")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no transport types")
    return out.withColumn("destination", F.when(A.inside_house(F.col("destination")), A.landing()).otherwise(F.col("destination")))


def with_house_aliases(transports: DataFrame) -> DataFrame:
    """``transports`` and, for every origin inside the house, a copy that starts where one arrives, unless such a row is there already."""
    inside = transports.where(A.inside_house(F.col("origin")) & (F.col("origin") != A.landing())).withColumn("origin", A.landing())
    return transports.unionByName(inside.exceptAll(inside.intersectAll(transports)).dropDuplicates()) if transports.columns else transports


def read_banks(spark: SparkSession, path: str) -> DataFrame:
    rows = read_tsv(spark, path)
    return rows.select(S.parse_tile(_cell(rows, "Destination")).alias("tile")).where("tile IS NOT NULL")


def read_collision(spark: SparkSession, path: str) -> DataFrame:
    """``tile, x, y, p, north, east`` of every tile of every region in a zip archive whose entries are named ``rx_ry``.

    Bits run least significant first: ((p * 4096) + (y % 64) * 64 + x % 64) * 2 + flag, flag 0 for north and 1 for east; bits
    beyond an entry's end are not set. Other entries are ignored. An archive's regions leave as they are read, one at a time.
    """

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        at = np.arange(4 * REGION * REGION)
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not re.fullmatch(r"\d+_\d+", name):
                            continue
                        rx, ry = map(int, name.split("_"))
                        bits = np.unpackbits(np.frombuffer(z.read(name), dtype=np.uint8), bitorder="little")[: 2 * len(at)].astype(bool)
                        bits = np.pad(bits, (0, 2 * len(at) - len(bits))).reshape(-1, 2)
                        yield pd.DataFrame({"x": rx * REGION + at % REGION, "y": ry * REGION + at // REGION % REGION, "p": at // REGION**2, "north": bits[:, 0], "east": bits[:, 1]})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(expand, "x long, y long, p long, north boolean, east boolean")
    return rows.select(S.pack_tile(F.col("x"), F.col("y"), F.col("p")).alias("tile"), "*")


def walkable_tiles(flags: DataFrame) -> DataFrame:
    """``tile, x, y, p`` of the tiles with a passable side: own north or east, north of the tile below or east of the one to the left."""
    sides = F.array(
        F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), (F.col("north") | F.col("east")).alias("open")),
        F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy"), F.col("north").alias("open")),
        F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy"), F.col("east").alias("open")),
    )
    opened = flags.select("x", "y", "p", F.explode(sides).alias("o")).where("o.open").select((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "p").distinct()
    return flags.select("tile", "x", "y", "p").join(opened, ["x", "y", "p"], "left_semi").select("tile", "x", "y", "p")


def passable_edges(flags: DataFrame) -> DataFrame:
    """Directed steps ``s, d`` in the eight directions that each tile's mask allows."""
    ways = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # the mask's bits, clockwise from north
    offsets = F.array(*(F.struct(F.lit(1 << i).alias("bit"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(ways)))
    steps = G.walk_masks(flags).where("mask <> 0").select(F.col("tile").alias("s"), "mask", F.explode(offsets).alias("o")).where("mask & o.bit <> 0")
    x, y = S.tile_x(F.col("s")) + F.col("o.dx"), S.tile_y(F.col("s")) + F.col("o.dy")
    return steps.select("s", S.pack_tile(x, y, S.tile_plane(F.col("s"))).alias("d"))


def read_separator(spark: SparkSession, path: str) -> DataFrame:
    """Cut edges ``a, b`` of a separator file as packed tiles, smaller first, once each."""
    cuts = spark.read.schema(SEPARATOR_DDL).json(path, multiLine=True).select(F.explode("cutEdges").alias("e"))
    end = lambda n: S.pack_tile(*(F.get(F.col("e")[n], F.lit(i)) for i in range(3)))
    return cuts.select(F.least(end("from"), end("to")).alias("a"), F.greatest(end("from"), end("to")).alias("b")).distinct()


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """Routes of a corpus file; absent tags are "unknown", absent lists empty."""
    rows = spark.read.schema(ROUTE_DDL).json(path, multiLine=True)
    for c in ("category", "distanceTag", "planeTag"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit("unknown")))
    for c in ("tiers", "negativeProfiles"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return rows


def read_oracle(spark: SparkSession, path: str) -> DataFrame:
    """``route, profile, reachable, cost`` of a JSON map from ``route/profile``; the profile follows the last slash."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string, struct<reachable: boolean, cost: long>>")).alias("key", "v"))
    return entries.select(F.regexp_extract("key", "^(.*)/[^/]*$", 1).alias("route"), F.regexp_extract("key", "([^/]*)$", 1).alias("profile"), "v.reachable", "v.cost")


def write_oracle(rows: DataFrame, path: str) -> None:
    """``route, profile, reachable, cost`` as the one JSON map that ``read_oracle`` reads; a single file by its format."""
    value = F.when(F.col("cost").isNull(), F.struct("reachable", F.lit(None).cast("long").alias("cost"))).otherwise(F.struct("reachable", "cost"))
    entry = F.struct(F.concat_ws("/", "route", "profile").alias("key"), value.alias("value"))
    rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``route, profile`` of the result records that were not correct."""
    rows = spark.read.schema("route string, profile string, correct boolean").json(path)
    return rows.where("NOT correct").select("route", "profile").distinct()


def write_separator(cuts: DataFrame, path: str, identity: str, configuration: dict[str, int | str], version: str) -> None:
    """Cut edges ``a, b`` as a separator file, smaller ends first, once each, in order; a single file by its format."""
    end = lambda c: F.array(S.tile_x(c), S.tile_y(c), S.tile_plane(c))
    edge = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = F.transform(F.sort_array(F.collect_set(edge)), lambda e: F.struct(end(e["a"]).alias("from"), end(e["b"]).alias("to")))
    settings = F.struct(*(F.lit(v).alias(k) for k, v in configuration.items()))
    whole = F.to_json(F.struct(F.lit(version).alias("format"), F.lit(identity).alias("topologyIdentity"), settings.alias("configuration"), edges.alias("cutEdges")))
    cuts.agg(whole.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def file_digests(spark: SparkSession, *paths: str) -> str:
    """SHA-256 of every file in the order of the paths, joined by colons; a missing file is "missing"."""
    out = []
    for path in paths:  # a few definition files; only digests come to the driver
        try:
            out += [r["h"] for r in spark.read.format("binaryFile").load(path).orderBy("path").select(F.sha2("content", 256).alias("h")).collect()]
        except AnalysisException:
            out.append("missing")
    return ":".join(out)


PROFILE = (
    "levels map<string,int>, quests array<string>, varbits map<string,int>, varplayers map<string,int>, inventory map<string,bigint>, equipment map<string,bigint>, runePouch map<string,bigint>, bank map<string,bigint>, "
    "diaries map<string,string>, plantedSpiritTrees array<string>, fairyRingsUnlocked boolean"
)
#: Names of the diaries, and other names of the planted trees.
DIARIES = ("Ardougne", "Desert", "Falador", "Fremennik", "Kandarin", "Karamja", "KourendKebos", "LumbridgeDraynor", "Morytania", "Varrock", "WesternProvinces", "Wilderness")
TREE_NAMES = {"FARMING_GUILD": "FarmingGuildTree", "PORT_SARIM": "PortSarimTree", "ETCETERIA": "EtceteriaTree", "BRIMHAVEN": "BrimhavenTree", "HOSIDIUS": "HosidiusTree"}


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One row a profile of an account file: levels, quests, variables by number, item bags by id, diary tiers by rank, planted trees. Another
    format version, an unknown name or an id that is no number is an error; quantities of one item are added."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"formatVersion int, nowMinutes int, profiles map<string, struct<{PROFILE.replace(' ', ':').replace(',:', ', ')}>>").alias("f"))
    fail = lambda text, x: F.raise_error(F.concat(F.lit(text), x))
    checked = F.when(F.col("f.formatVersion") == 1, F.col("f.profiles")).otherwise(fail("unsupported account profile formatVersion", F.lit("")))
    rows = rows.select(F.col("f.nowMinutes").alias("now_minutes"), F.explode(checked).alias("account", "p"))
    number = lambda c: F.transform_keys(c, lambda k, _: F.coalesce(k.try_cast("int"), fail("invalid id: ", k).cast("int")))

    def bag(c):
        ids = F.transform(F.map_entries(c), lambda e: F.struct(A.item_ids(e["key"])[0].alias("id"), e["value"].alias("n")))
        keys = F.array_distinct(F.transform(ids, lambda e: e["id"]))
        total = lambda k: F.aggregate(F.filter(ids, lambda e: e["id"] == k), F.lit(0).cast("long"), lambda t, e: t + e["n"])
        return F.map_from_arrays(keys, F.transform(keys, total))

    tiers = F.array(*map(F.lit, ("NoDiary", *S.TIERS)))
    tier = lambda k, v: F.when(k.isin(*DIARIES) & F.array_contains(tiers, v), (F.array_position(tiers, v) - 1).cast("int")).otherwise(fail("unknown diary: ", F.concat_ws(" ", k, v)).cast("int"))
    names = F.create_map(*(F.lit(x) for k, v in TREE_NAMES.items() for x in (k, v, v, v)))
    trees = F.transform("p.plantedSpiritTrees", lambda t: F.coalesce(F.try_element_at(names, t), fail("unknown planted spirit tree: ", t).cast("string")))
    return rows.select(
        "account", "now_minutes", F.col("p.levels").alias("levels"), F.array_distinct("p.quests").alias("quests"), number("p.varbits").alias("varbits"), number("p.varplayers").alias("varplayers"),
        *(bag(F.col(f"p.{c}")).alias(n) for c, n in (("inventory", "inventory"), ("equipment", "equipment"), ("runePouch", "rune_pouch"), ("bank", "bank"))),
        F.transform_values("p.diaries", tier).alias("diaries"), F.array_distinct(trees).alias("trees"), F.col("p.fairyRingsUnlocked").alias("fairy_rings"),
    )


def variable_registry(spark: SparkSession, folder: str, constants: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``kind, id, name, requirements, uses, sources`` of every variable that the definition files of a folder require. ``constants``: kind ->
    (column of the files, source file with the kind's integer constants). Pieces of a cell that are no number, sign and number are left out;
    a variable without a constant is an error, of several constants with its number the last one names it."""
    files = spark.read.text(f"{folder}/*.tsv", wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\r?\n").alias("lines"))
    heads = F.get(F.filter("lines", lambda v: v.startswith("# ")), F.lit(0))
    rows = files.select("file", F.split(F.substr(heads, F.lit(3)), "\t").alias("names"), F.posexplode("lines").alias("at", "value"))
    rows = rows.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    out = None
    for order, (kind, (column, source)) in enumerate(constants.items()):
        place = F.array_position("names", column)
        cell = rows.where(place > 0).select("file", (F.col("at") + 1).alias("line"), F.get(F.split("value", "\t", -1), (place - 1).cast("int")).alias("cell"))
        asked = cell.select("file", "line", F.posexplode(F.split("cell", ";")).alias("nth", "text")).where(F.col("text").rlike("^[0-9]+[=><&@][0-9]+$"))
        part = lambda i: F.regexp_extract("text", "^([0-9]+)([=><&@])([0-9]+)$", i)
        use = F.struct("file", "line", F.lit(order).alias("order"), "nth", F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("text")).alias("text"))
        asked = asked.select(part(1).cast("long").alias("id"), F.concat(part(2), part(3).cast("long").cast("string")).alias("requirement"), use.alias("use"))
        found = asked.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("requirement")), ";").alias("requirements"), F.count(F.lit(1)).alias("uses"), F.array_join(F.transform(F.sort_array(F.collect_list("use")), lambda u: u["text"]), " | ").alias("sources"))
        pattern = F.lit("public static final int ([A-Z0-9_]+) = ([0-9]+);")
        lines = spark.read.text(source, wholetext=True).select(F.posexplode(F.arrays_zip(F.regexp_extract_all("value", pattern, F.lit(1)).alias("name"), F.regexp_extract_all("value", pattern, F.lit(2)).alias("id"))).alias("at", "c"))
        named = lines.select(F.col("c.id").cast("long").alias("id"), F.struct("at", F.col("c.name").alias("name")).alias("n")).groupBy("id").agg(F.max("n")["name"].alias("name"))
        missing = F.raise_error(F.concat(F.lit(f"no name for {kind} "), F.col("id").cast("string"))).cast("string")
        found = found.join(named, "id", "left").select(F.lit(kind).alias("kind"), "id", F.coalesce("name", missing).alias("name"), "requirements", "uses", "sources")
        out = found if out is None else out.union(found)
    if out is None:
        raise ValueError("no kinds of variables")
    return out


def write_registry(rows: DataFrame, path: str) -> None:
    """A variable registry as one tab-separated file with a header, by kind and id; a single file by its format."""
    names = ["kind", "id", "name", "requirements", "uses", "sources"]
    line = F.struct("kind", "id", F.concat_ws("\t", *(F.col(n).cast("string") for n in names)).alias("line"))
    body = F.transform(F.sort_array(F.collect_list(line)), lambda r: r["line"])
    rows.agg(F.array_join(F.concat(F.array(F.lit("\t".join(names))), body), "\n").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_results(rows: DataFrame, folder: str) -> None:
    """Append result records as JSON lines."""
    rows.write.mode("append").json(folder)


def write_csv(rows: DataFrame, folder: str) -> None:
    """CSV with a header, every field quoted and quotes doubled; nulls are empty."""
    rows.write.mode("overwrite").options(header=True, quoteAll=True, quote='"', escape='"', nullValue="", emptyValue="").csv(folder)


def topology_tables(spark: SparkSession, flags: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """``tile, component_id, routing_component_id`` of a collision table; cuts part the routing components only."""
    tiles = G.saved(walkable_tiles(flags))
    walk = G.saved(passable_edges(flags))
    natural = G.natural_components(tiles, walk).select("tile", "component_id")
    if cuts is None:
        return natural.withColumn("routing_component_id", F.col("component_id"))
    kept = walk.join(cuts, (F.least("s", "d") == F.col("a")) & (F.greatest("s", "d") == F.col("b")), "left_anti")
    return natural.join(G.natural_components(tiles, kept).select("tile", F.col("component_id").alias("routing_component_id")), "tile")

