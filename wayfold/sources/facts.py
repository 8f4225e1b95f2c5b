"""The fact base of a world: seven tables with metadata, and the views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..storage import saved
from .files import file_digests, passable_edges, walkable_tiles

VIEWS = {
    "reachable_tiles": "SELECT t.* FROM tiles t JOIN components c USING (component_id) WHERE c.structurally_reachable",
    "reachable_point_access": "SELECT * FROM point_access WHERE structurally_reachable",
    "place_facts": """WITH counts AS (SELECT place_id, count(pa.component_id) AS attachments, count(DISTINCT pa.component_id) AS components FROM places p LEFT JOIN point_access pa USING (x, y, plane) GROUP BY place_id)
SELECT p.place_id, p.name, p.source, p.x, p.y, p.plane, pa.resolved_x, pa.resolved_y, pa.resolved_plane, pa.component_id, pa.access_kind, pa.structurally_reachable,
  CASE WHEN c.attachments = 0 THEN 'unresolved' WHEN c.components > 1 THEN 'ambiguous/multiple_components' WHEN pa.structurally_reachable THEN 'reachable' ELSE 'unreachable_component' END AS status
FROM places p LEFT JOIN point_access pa USING (x, y, plane) JOIN counts c USING (place_id)""",
    "transport_facts": "SELECT t.*, " + ", ".join(f"{a}.{c} AS {n}_{c}" for a, n in (("oa", "origin"), ("da", "destination")) for c in ("resolved_x", "resolved_y", "resolved_plane", "component_id", "access_kind", "structurally_reachable"))
    + " FROM transports t LEFT JOIN point_access oa ON t.origin_x = oa.x AND t.origin_y = oa.y AND t.origin_plane = oa.plane LEFT JOIN point_access da ON t.destination_x = da.x AND t.destination_y = da.y AND t.destination_plane = da.plane",
}


def _split(df: DataFrame, column: str, prefix: str) -> DataFrame:
    t = F.col(column)
    return df.withColumns({f"{prefix}x": S.tile_x(t), f"{prefix}y": S.tile_y(t), f"{prefix}plane": S.tile_plane(t)}).drop(column)


def fact_tables(spark: SparkSession, flags: DataFrame, transports: DataFrame, banks: DataFrame, places: DataFrame, cuts: DataFrame | None = None, files: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """``components, tiles, routing_components, separator_crossings, point_access, places, transports, metadata`` of a world.

    ``flags`` is a collision table, ``transports(transport_id, type, origin, destination, duration, ...)``, ``banks(tile)``, ``places(place_id, name, tile, source,
    source_kind)``, ``cuts(a, b)``. Points are the places and the ends of all transports; reachable is what banks and globals lead to.
    """
    tiles = saved(walkable_tiles(flags))
    walk = saved(passable_edges(flags))
    natural = G.natural_components(tiles, walk).select("tile", "component_id")
    crossing = walk.where("FALSE")
    if cuts is None:
        both = natural.withColumn("routing_component_id", F.col("component_id"))
    else:
        on_cut = (F.least("s", "d") == F.col("a")) & (F.greatest("s", "d") == F.col("b"))
        crossing = walk.join(cuts, on_cut, "left_semi")
        routing = G.natural_components(tiles, walk.join(cuts, on_cut, "left_anti")).select("tile", F.col("component_id").alias("routing_component_id"))
        both = natural.join(routing, "tile")
    both = saved(both)

    # points: on their tile, or one tile of every component around them
    ends = transports.select("origin").union(transports.select("destination")).where("origin IS NOT NULL").toDF("point")
    points = saved(ends.union(places.select("tile")).distinct())
    around = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(i).alias("i")) for i, (dx, dy) in enumerate([(0, 0), *G.CARDINAL, *G.DIAGONAL])))
    near = points.withColumn("o", F.explode(around)).withColumn("tile", S.pack_tile(S.tile_x(F.col("point")) + F.col("o.dx"), S.tile_y(F.col("point")) + F.col("o.dy"), S.tile_plane(F.col("point"))))
    near = near.join(both.select("tile", "component_id"), "tile")
    own = near.where("o.i = 0").select("point", F.lit(True).alias("on_tile"))
    found = near.join(own, "point", "left").where("on_tile IS NULL OR o.i = 0")
    found = found.groupBy("point", "component_id", "on_tile").agg(F.max_by("tile", "o.i").alias("resolved"))

    seeds = both.join(banks.select("tile").distinct(), "tile").select(F.col("component_id").alias("node"))
    at = found.select(F.col("point"), F.col("component_id"))
    to = at.toDF("destination", "d")
    seeds = seeds.union(transports.where("origin IS NULL").join(to, "destination").select(F.col("d").alias("node")))
    edges = transports.join(at.toDF("origin", "s"), "origin").join(to, "destination").select("s", "d").distinct()
    reached = G.closure(seeds, saved(edges)).select(F.col("node").alias("component_id"), F.lit(True).alias("structurally_reachable"))
    reached = saved(reached)
    flagged = lambda df: df.join(reached, "component_id", "left").withColumn("structurally_reachable", F.coalesce("structurally_reachable", F.lit(False)))

    spots = _split(both, "tile", "")
    components = spots.groupBy("component_id").agg(F.count(F.lit(1)).alias("tile_count"), *(f(c).alias(f"{n}_{c}") for c in ("x", "y", "plane") for f, n in ((F.min, "min"), (F.max, "max"))))
    name = lambda c, n: both.select(F.col("tile").alias(c), F.col("routing_component_id").alias(n))
    crossings = crossing.join(name("s", "from_routing_component"), "s").join(name("d", "to_routing_component"), "d").withColumn("cost", F.lit(1))
    crossings = crossings.where("s < d")
    sides = crossings.select(F.col("from_routing_component").alias("routing_component_id"), F.col("to_routing_component").alias("other"))
    sides = sides.union(sides.select("other", "routing_component_id")).groupBy("routing_component_id").agg(F.count(F.lit(1)).alias("separator_crossing_count"), F.countDistinct("other").alias("neighbouring_component_count"))
    routing = both.groupBy("routing_component_id").agg(F.min("component_id").alias("natural_component_id"), F.count(F.lit(1)).alias("tile_count")).join(sides, "routing_component_id", "left").na.fill(0, ["separator_crossing_count", "neighbouring_component_count"])

    starts = transports.where("origin IS NOT NULL").select(F.col("origin").alias("point"), F.lit(True).alias("starts")).distinct()
    access = points.join(found, "point", "left").join(reached, "component_id", "left").join(starts, "point", "left")
    kind = F.when(F.col("component_id").isNull(), "unresolved").when(F.col("on_tile"), "walkable").when(F.col("starts"), "adjacent_transport_origin").otherwise("snapped")
    good = F.when(F.col("component_id").isNotNull(), F.coalesce("structurally_reachable", F.lit(False)))
    access = access.select("point", F.coalesce("resolved", "point").alias("resolved"), "component_id", kind.alias("access_kind"), good.alias("structurally_reachable"))

    metadata = [("component_model_version", "1"), ("walkable_tiles", str(tiles.count())), ("source_hash", file_digests(spark, *files))]
    return {
        "components": flagged(components), "tiles": spots, "routing_components": routing, "separator_crossings": _split(_split(crossings, "s", "from_"), "d", "to_"),
        "point_access": _split(_split(access, "point", ""), "resolved", "resolved_"), "places": _split(places, "tile", "").withColumn("metadata", F.lit("{}")),
        "transports": _split(_split(transports, "origin", "origin_"), "destination", "destination_"), "metadata": spark.createDataFrame(metadata, "key string, value string"),
    }


def write_facts(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet below ``folder``."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def register_facts(spark: SparkSession, folder: str) -> None:
    """Temporary views of a written fact base: its tables and the four views over them."""
    for name in ("components", "tiles", "routing_components", "separator_crossings", "point_access", "places", "transports", "metadata"):
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)
