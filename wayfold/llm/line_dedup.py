"""Removal of lines that spread over many sites, by mergeable HyperLogLog sketches per line hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, heavy_light_join, saved


def line_key(line: Column) -> Column:
    """What two lines must share to be one: the text without outer white space."""
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(site_col), F.lit("")).alias("site"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    key = line_key(F.col("line"))
    return base.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "site", "pos", F.xxhash64(key).alias("h"))


def boilerplate_lines(lines: DataFrame, *, min_sites: int = 5, lg_k: int = 10, band: float = 0.5) -> DataFrame:
    """Line hashes of ``lines(doc_id, site, pos, h)`` found on at least ``min_sites`` sites: ``h, n, keep`` with the number of
    occurrences and the first place.

    Every line hash that can pass gets a sketch of its sites, merged by partial aggregation. Estimates within ``band`` of the
    threshold are replaced by exact distinct counts.
    """
    # a line seen in fewer rows than min_sites, or on one site, can't pass: exact necessary conditions, no sketch needed
    seen = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("s0"), F.max("site").alias("s1"), F.min(F.struct("doc_id", "pos")).alias("keep"))
    seen = saved(seen.where((F.col("n") >= min_sites) & (F.col("s0") != F.col("s1"))).select("h", "n", "keep"))
    spread = saved(heavy_light_join(lines, seen, ["h"], "n").groupBy("h").agg(F.first("n").alias("n"), F.first("keep").alias("keep"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites")))
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    near = spread.where(F.col("sites").between(low, high))
    exact = heavy_light_join(lines.select("h", "site"), near.select("h", "n", "keep"), ["h"], "n").groupBy("h", "site").agg(F.first("n").alias("n"), F.first("keep").alias("keep"))
    exact = exact.groupBy("h").agg(F.first("n").alias("n"), F.first("keep").alias("keep"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_sites)
    return saved(spread.where(F.col("sites") > high).select("h", "n", "keep").union(exact.select("h", "n", "keep")))


def remove_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 5, lg_k: int = 10) -> DataFrame:
    """``docs`` with lines of ``min_sites`` or more distinct sites removed from every place but the first (smallest id, then
    position), and ``n_removed``. Where the input has ``n_chars`` it is left as it was.

    Lines are cut at line feeds and compared without outer white space; blank lines stay, all others count, however short.
    Nulls: a null text stays null, null sites are one site of their own, rows of null id stay whole. Empty texts, empty
    tables and extra columns pass through; where the input has a column ``n_removed`` it stays and the new one is called
    ``n_removed_``. Repeated rows of one id are cleaned alike. No row is dropped.
    """
    lines = saved(_lines(docs.where(F.col(id_col).isNotNull()), id_col, text_col, site_col))
    bad = boilerplate_lines(lines, min_sites=min_sites, lg_k=lg_k)
    found = heavy_light_join(lines.drop("site"), bad, ["h"], "n").where((F.col("keep.doc_id") != F.col("doc_id")) | (F.col("keep.pos") != F.col("pos")))
    cut_id, cuts, count = (free_name(docs, n) for n in ("__cut_id", "__cuts", "n_removed"))
    found = found.groupBy(F.col("doc_id").alias(cut_id)).agg(F.collect_set("pos").alias(cuts))
    joined = docs.join(found, docs[id_col] == found[cut_id], "left").drop(cut_id)
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (l, i) -> NOT array_contains(`{cuts}`, i)), '\\n')")
    return joined.withColumn(text_col, F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(kept)).withColumn(count, F.coalesce(F.size(cuts), F.lit(0))).drop(cuts)
