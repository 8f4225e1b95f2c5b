"""Corpus pipeline: documents go through quality, line dedup, near-duplicate removal, source mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import line_dedup, mixing, ngram_join, packing, quality
from wayfold.llm.common import collect_executors, saved
from wayfold.llm.queries import tokenizer_path

#: Every stage but the last returns these; other columns are left out, empty tables give empty ones.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among ``docs``, predicts 1. Null and empty texts are scored
    as no bytes; repeated rows stay or go alike; without labelled rows every score is one half, so all stay."""
    collect_executors(spark)
    net = quality.learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, net).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-source boilerplate lines; ``n_chars`` follows the text. No document goes;
    null texts stay null, rows of null id stay whole, repeated rows are cleaned alike."""
    return line_dedup.remove_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of every group linked by shingle similarity. Texts without words
    and rows of null id are linked with nothing and stay; repeated rows of an id that stays all stay."""
    collect_executors(spark)
    return ngram_join.keep_one_per_component(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: repeats are repeated rows, documents not taken go.
    Texts without words (null and empty ones too) have no size and are never taken."""
    taken = mixing.mix_sources(docs, keep=("text", "lang", "n_chars")).where("taken > 0")
    times = F.expr("explode(sequence(1, CAST(taken DIV size AS INT)))")
    return taken.select(*COLUMNS, times.alias("copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens; a null or empty text is its closing id alone."""
    collect_executors(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", filter_quality), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: The classifier and the tokenizer can't be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
