"""One query per operator over its whole table, with production parameters, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, langid, line_dedup, mixing, ngram_join, packing, pii, quality, token_counts, topk
from .common import saved, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    return token_counts.vocabulary_path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that at least five sources share, but for their first place."""
    out = line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE_1 = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, pos, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
), bad AS (
  SELECT k, min({'d': doc_id, 'p': pos}) AS keep FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY k HAVING count(DISTINCT site) >= 5
), f AS (
  SELECT l.doc_id, l.pos, l.line, bad.k IS NOT NULL AND (bad.keep.d <> l.doc_id OR bad.keep.p <> l.pos) AS cut FROM l LEFT JOIN bad USING (k)
)
SELECT doc_id, count(*) FILTER (WHERE cut) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '')) AS text_sha256 FROM f GROUP BY doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load under two tokenizer versions, a revision (repeated lines dropped from documents of quality 0), the
    deletion of toxic documents, and the load committed a second time. Vocabularies can't be written in SQL."""
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    keep = {c: F.col(c) for c in ("doc_id", "source", "lang")}
    docs = saved(token_counts.with_counts(_table(spark, sf_dir, "documents"), keep, {"": F.col("text"), "once": once}))  # counts, not texts, meet the labels
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = docs.join(labels.where("quality = 0 OR toxic = 1"), "doc_id")
    low, toxic = marked.where("quality = 0"), marked.where("toxic = 1")

    def every(make) -> DataFrame:
        first, *rest = [make(name) for name in token_counts.TOKENIZERS]
        for r in rest:
            first = first.union(r)
        return first

    ledger = token_counts.TokenLedger(spark, scratch(spark))
    ledger.commit("load", every(lambda t: token_counts.inserted(docs, t, t)))
    ledger.commit("revise", every(lambda t: token_counts.revised(low, t, old=t, new=f"{t}/once")))
    now = lambda t: F.when(F.col("quality") == 0, F.col(f"`{t}/once`")).otherwise(F.col(f"`{t}`"))
    ledger.commit("delete", every(lambda t: token_counts.inserted(toxic, t, now(t), sign=-1)))
    ledger.commit("load", every(lambda t: token_counts.inserted(docs, t, t)))
    return ledger.totals()


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.spans_text("base").cast("binary"), 256).alias("base_sha256"), pii.spans_text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.learn_quality(docs, _table(spark, sf_dir, "labels")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), r(node, root) USING KEY (node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION (SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.node JOIN recurring.r k ON k.node = e.b WHERE r.root < k.root GROUP BY e.b)
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(_table(spark, sf_dir, "embeddings"))


ORACLE_8 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT DISTINCT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.learn_languages(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_pii": op3_pii,
    "op4_fingerprints": op4_fingerprints,
    "op5_quality": op5_quality,
    "op6_ngram_join": op6_ngram_join,
    "op7_mixing": op7_mixing,
    "op8_topk": op8_topk,
    "op9_packing": op9_packing,
    "op10_language": op10_language,
}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": ORACLE_1, "op6_ngram_join": ORACLE_6, "op8_topk": ORACLE_8}
