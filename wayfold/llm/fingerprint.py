"""Homomorphic multiset fingerprints of documents, in DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 32-bit lanes summed modulo 2^32 over whole paragraphs (equality), and bit lanes counted over word pairs (likeness).
HASH_LANES, BIT_LANES = 16, 64
MASK32 = 0xFFFFFFFF
#: Eight bit counts share a long, one in each byte, over chunks of so few hashes that neither a byte nor the signed long overflows.
BYTES, CHUNK = 0x0101010101010101, 127


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: its lines that are not blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))


def hash_lanes(pars: Column) -> Column:
    """Sum of every paragraph's wide vector modulo 2^32; the sum over a union is the sum of the sums."""

    def lane(j: int) -> Column:
        return F.aggregate(pars, F.lit(0).cast("long"), lambda a, p: (a + F.xxhash64(F.lit(j), p).bitwiseAND(F.lit(MASK32))).bitwiseAND(F.lit(MASK32)))

    return F.array(*(lane(j) for j in range(HASH_LANES)))


def pair_hashes(pars: Column) -> Column:
    """Hashes of adjacent word pairs within each paragraph; a paragraph of one word gives that word."""

    def one(p: Column) -> Column:
        words = F.filter(F.split(p, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        return F.when(F.size(words) < 2, F.transform(words, lambda w: F.xxhash64(w))).otherwise(
            F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b))
        )

    return F.flatten(F.transform(pars, one))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of two multisets together (sign 1), or of ``a`` without the paragraphs of ``b`` (sign -1)."""
    lanes = F.zip_with(a["lanes"], b["lanes"], lambda x, y: (x + y * F.lit(sign)).bitwiseAND(F.lit(MASK32)))
    bits = F.zip_with(a["bits"], b["bits"], lambda x, y: x + y * F.lit(sign))
    return F.struct(lanes.alias("lanes"), bits.alias("bits"), (a["pairs"] + b["pairs"] * F.lit(sign)).alias("pairs"))


def bit_sums(hashes: Column) -> Column:
    """For every chunk of hashes, how many have each bit set: eight longs of eight counts."""

    def lane(chunk: Column, j: int) -> Column:
        spread = lambda h: F.shiftrightunsigned(h, j) if j else h
        return F.aggregate(chunk, F.lit(0).cast("long"), lambda a, h: a + spread(h).bitwiseAND(F.lit(BYTES)))

    starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(1), F.size(hashes), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.transform(F.array(F.slice(hashes, i, CHUNK)), lambda c: F.array(*(lane(c, j) for j in range(8))))[0])


def unpack(chunks: Column) -> Column:
    """The counts of all bit lanes, bit 0, 32, 1, 33 and so on, from those of the chunks."""

    def count(bit: int) -> Column:
        byte = lambda v: (F.shiftrightunsigned(v[bit % 8], bit - bit % 8) if bit >= 8 else v[bit % 8]).bitwiseAND(F.lit(0xFF))
        return F.aggregate(chunks, F.lit(0).cast("long"), lambda a, v: a + byte(v))

    return F.array(*(count(bit) for j in range(BIT_LANES // 2) for bit in (j, j + 32)))


def fingerprint_text(fp: Column) -> Column:
    """Hex of the lanes and counts; equal for equal paragraphs in any order."""
    hexed = lambda xs: F.array_join(F.transform(xs, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")
    return F.concat(hexed(fp["lanes"]), F.lit(":"), hexed(fp["bits"]), F.lit(":"), F.hex(fp["pairs"]))


def likeness(a: Column, b: Column) -> Column:
    """Estimate in 0 to 1 of the cosine of two multisets of word pairs: every lane is a random-sign sum over the pairs.
    1 for equal fingerprints, 0 where just one is empty."""
    signed = lambda fp: F.transform(fp["bits"], lambda c: (2 * c - fp["pairs"]).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = signed(a), signed(b)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(0.999999), dot(x, y) / norm))).otherwise(F.lit(0.0))
    return F.when((a["lanes"] == b["lanes"]) & (a["pairs"] == b["pairs"]) & (a["bits"] == b["bits"]), F.lit(1.0)).otherwise(cosine)


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of a text column: a struct of lanes, bit counts and the number of pairs. Null counts as empty."""
    pars, hashes = f"__pars_{name}", f"__hashes_{name}"
    df = df.withColumn(pars, paragraphs(F.col(text_col)))
    df = df.withColumn(hashes, pair_hashes(F.col(pars))).withColumn(f"__lanes_{name}", hash_lanes(F.col(pars))).drop(pars)
    df = df.withColumn(f"__sums_{name}", bit_sums(F.col(hashes))).withColumn(f"__pairs_{name}", F.size(hashes).cast("long")).drop(hashes)
    value = F.struct(F.col(f"__lanes_{name}").alias("lanes"), unpack(F.col(f"__sums_{name}")).alias("bits"), F.col(f"__pairs_{name}").alias("pairs"))
    return df.withColumn(name, value).drop(f"__lanes_{name}", f"__sums_{name}", f"__pairs_{name}")


def _ranges(docs: DataFrame, id_col: str, target: int) -> tuple[Column, DataFrame]:
    """A monotone range number for every id, about ``target`` rows each, and per range its largest id with the range above.

    Up to 512 quantiles come to the driver; each is parted evenly by value, so ranges number at most 512 * 1024 and their table has a
    bounded size. Null ids are the lowest range.
    """
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    n, lo, hi = stats["n"], stats["lo"], stats["hi"]
    key = F.col(id_col)
    if not n or lo is None:
        return F.lit(0).cast("long"), docs.select(F.lit(0).cast("long").alias("range"), F.lit(None).cast("long").alias("top"), F.lit(0).cast("long").alias("above")).limit(1)
    want = max(1, math.ceil(n / target))
    coarse = min(512, want)
    cuts = sorted(set(docs.agg(F.percentile_approx(id_col, [i / coarse for i in range(1, coarse)], 20_000)).first()[0])) if coarse > 1 else []
    edges = [lo, *(c for c in cuts if c > lo)]
    tops = [*(e - 1 for e in edges[1:]), hi]
    fine = min(1024, math.ceil(want / coarse))
    bound = F.array(*(F.lit(int(e)) for e in edges))
    which = F.size(F.filter(bound, lambda e: e <= key)) if len(edges) > 1 else F.lit(1)
    if fine == 1:
        number = which.cast("long")
    else:
        first = F.element_at(bound, which)
        width = F.element_at(F.array(*(F.lit(max(1, -(-(t - e + 1) // fine))) for e, t in zip(edges, tops, strict=True))), which)
        number = which.cast("long") * fine + F.floor((key - first) / width)
    number = F.when(key.isNull(), F.lit(-1).cast("long")).otherwise(number)
    tables = docs.select(number.alias("range"), key.alias("top")).groupBy("range").agg(F.max("top").alias("top"))
    w = Window.orderBy("range")
    tables = tables.withColumn("above", F.coalesce(F.lead("range").over(w), F.min("range").over(w)))
    return number, tables


def compare_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 1500) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third (floor) of code points is replaced by the first as many of
    the next document by descending id; after the last comes the first.

    One shuffle: documents meet their neighbours in id ranges, the top document of each range is also sent to the range above, and
    fingerprints are summed and compared where the rows are. Null texts count as empty. Rows of one id are in the order of
    their texts; rows of null id come after all others. A single row is its own next. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    number, tables = _ranges(rows, "doc_id", range_rows)
    rows = rows.withColumn("range", number).join(F.broadcast(tables.select(F.col("range").alias("r"), "top", "above")), F.col("range") == F.col("r"), "left")
    is_top = F.coalesce(F.col("doc_id") == F.col("top"), F.lit(False))
    # rows of null id are a range without a largest id; the one that comes first is sent to the range above
    unnamed = rows.where("doc_id IS NULL").groupBy("above").agg(F.min("text").alias("text"))
    unnamed = unnamed.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("above").alias("range"), F.lit(1).alias("copy"))
    some = rows.where("doc_id IS NULL").limit(1).count() > 0
    places = F.when(is_top, F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("copy")), F.struct(F.col("above").alias("range"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("copy"))))
    rows = rows.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", F.col("place.range").alias("range"), F.col("place.copy").alias("copy"))
    if some:
        rows = rows.union(unnamed)
    order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    n = F.length("text")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    edited = F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 3) AS INT))"), F.expr("substring(next, 1, CAST(floor(length(text) / 3) AS INT))"))
    rows = rows.select("range", "copy", "at", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(F.col("copy") == 0, edited).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = with_fingerprint(with_fingerprint(rows, "text", "fp").drop("text"), "edited", "efp").drop("edited")
    done = rows.withColumn("nfp", F.lead("fp").over(Window.partitionBy("range").orderBy("at"))).where("copy = 0")
    return done.select("doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("fp")).alias("fingerprint"), fingerprint_text(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"))
