"""A deterministic tile world computed from the driver's tables: integers only, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The same tables as common table expressions of the check SQL.
SQL_TILES = "tiles AS (SELECT DISTINCT x, y, p, x | (y << 15) | (p << 30) AS tile FROM (SELECT CAST(l_partkey % 64 AS BIGINT) AS x, CAST((l_suppkey * 37 + l_orderkey) % 64 AS BIGINT) AS y, CAST(l_linenumber % 2 AS BIGINT) AS p FROM lineitem WHERE l_quantity < 10))"
SQL_EDGES = "walk AS (SELECT a.tile AS s, b.tile AS d FROM (SELECT *, unnest([-1, 1, 0, 0]) AS dx, unnest([0, 0, -1, 1]) AS dy FROM tiles) a JOIN tiles b ON a.p = b.p AND b.x = a.x + a.dx AND b.y = a.y + a.dy)"
SQL_TRANSPORTS = """transports AS (SELECT o_orderkey AS id, o_orderpriority AS type, 1 + CAST(floor(o_totalprice) AS BIGINT) % 20 AS duration, o_orderstatus AS status,
  CASE WHEN o_orderstatus <> 'P' THEN (o_custkey % 64) | (((o_custkey * 7) % 64) << 15) | ((o_custkey % 2) << 30) END AS origin,
  (o_orderkey % 64) | (((o_orderkey * 11) % 64) << 15) | ((o_orderkey % 2) << 30) AS destination, CAST((o_orderkey * 7) % 60 AS INTEGER) AS max_level FROM orders)"""
SQL_BANKS = "banks AS (SELECT DISTINCT t.tile FROM supplier JOIN tiles t ON t.x = s_suppkey % 64 AND t.y = (s_suppkey * 13) % 64)"
SQL_COMPONENTS = """cc(tile, root) USING KEY (tile) AS (SELECT tile, tile FROM tiles
  UNION (SELECT w.d, min(c.root) FROM cc c JOIN walk w ON w.s = c.tile JOIN recurring.cc k ON k.tile = w.d WHERE c.root < k.root GROUP BY w.d)),
comp AS (SELECT tile, root, dense_rank() OVER (ORDER BY root) AS component_id FROM cc)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_quantity < 10")
    rows = rows.select((F.col("l_partkey") % 64).cast("long").alias("x"), ((F.col("l_suppkey") * 37 + F.col("l_orderkey")) % 64).cast("long").alias("y"), (F.col("l_linenumber") % 2).cast("long").alias("p")).distinct()
    return rows.withColumn("tile", S.pack_tile(F.col("x"), F.col("y"), F.col("p")))


def transports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.col("o_orderpriority").alias("type"), (1 + F.floor("o_totalprice") % 20).cast("long").alias("duration"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") != "P", S.pack_tile(c % 64, (c * 7) % 64, c % 2)).alias("origin"),
        S.pack_tile(k % 64, (k * 11) % 64, k % 2).alias("destination"), ((k * 7) % 60).cast("int").alias("max_level"),
    )


def banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 64).alias("x"), ((F.col("s_suppkey") * 13) % 64).alias("y")).distinct()
    return tiles(spark, sf_dir).join(s, ["x", "y"]).select("tile").distinct()
