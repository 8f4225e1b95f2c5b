"""Mixing sources to target weights by subset-sum budget fitting over exact document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import numbered
from .common import heavy_light_join, saved, word_count

#: A group of equal source and length is dealt over so many seeded slots; a slot is ranked by itself.
SLOTS = 256


def with_targets(sources: DataFrame, weights: tuple[float, ...], budget_share: float, ceiling: float) -> DataFrame:
    """``sources(skey, source_size)`` with their ``target``: one level times the weight, or ``ceiling`` times the size where that is
    less. The level rises in rounds, each of which shares again what the full ones can't take; a round brings two sums to
    the driver, whatever the number of sources."""
    place = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    rows = saved(numbered(sources, "skey", "place").withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), place)))
    budget = budget_share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    most = F.col("source_size") * float(ceiling)
    level, full = 0.0, -1
    while True:
        over = most < F.col("weight") * level
        sums = rows.where("source_size > 0").agg(F.count_if(over), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight")))).first()
        if sums[0] == full or not sums[2]:
            break
        full, level = sums[0], (budget - (sums[1] or 0.0)) / sums[2]
    return rows.withColumn("target", F.when(F.col("source_size") == 0, 0.0).when(most < F.col("weight") * level, most).otherwise(F.least(F.col("weight") * level, most)))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 14) -> np.ndarray:
    """How many documents of each exact length to take so that their lengths sum as near ``budget`` as can be reached.

    An even share of every length is taken first, then whole documents from long to short; what is left of the budget (a few
    of the longest lengths at most) is fitted by a bounded-knapsack dynamic programme over the remaining counts.
    ``lengths`` ascend and are positive.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((lengths * take).sum())
    for i in range(len(lengths) - 1, -1, -1):
        if left - lengths[i] >= window // 2:
            more = min(int(counts[i] - take[i]), int((left - window // 2) // lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    # bounded knapsack over sums up to limit: bit s of reach tells that sum s can be reached
    limit = max(2 * left, min(int(lengths[0]), 1 << 22))
    mask = (1 << (limit + 1)) - 1
    reach, steps = 1, []
    for i in range(len(lengths)):
        if lengths[i] > limit:
            break
        room = min(int(counts[i] - take[i]), limit // int(lengths[i]))
        part = 1
        while room > 0:
            k = min(part, room)
            steps.append((i, k, reach))
            reach = (reach | (reach << (k * int(lengths[i])))) & mask
            room -= k
            part *= 2
        if (reach >> left) & 1 and i >= 32:
            break
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> left
    up = left + ((above & -above).bit_length() - 1) if above else None
    goal = below if up is None or left - below <= up - left else up
    for i, k, before in reversed(steps):
        if not (before >> goal) & 1:
            take[i] += k
            goal -= k * int(lengths[i])
    return take


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), budget_share: float = 1.5, ceiling: float = 2.0, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """How often each document enters a mix whose sources meet target weights.

    A document's size is its number of words; sources in code-point order (null last) carry ``weights`` in turn and share
    ``budget_share`` of all sizes, none above ``ceiling`` times its size. Whole passes over a source come first; the rest
    of its target is fitted over the counts of exact lengths, and of each length that many documents are selected in seeded
    order. Returns ``doc_id, size, source, source_size, target, taken`` and the columns in ``keep``, one row per input row;
    ``taken`` counts repeats. Sources may be any number (hosts, say): their table is joined, not collected; a source's histogram of
    lengths is one task's group. Null and empty texts have size 0 and are never taken; repeated rows count each; ties of
    the seeded order fall to the smaller id; an empty table gives no rows. A column in ``keep`` named as one of the six
    is returned with an underscore behind its name; other columns are ignored.
    """
    own = ("doc_id", "size", "source", "source_size", "target", "taken")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([F.struct(*keep).alias("kept")] if keep else []))
    rows = rows.withColumn("skey", F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(SLOTS)))
    if not keep:
        rows = saved(rows)  # a few numbers a row: words are counted once
    spots = saved(rows.groupBy("skey", "size", "slot").agg(F.count(F.lit(1)).alias("n")))
    sources = spots.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_rows"))
    plan = with_targets(sources, weights, budget_share, ceiling)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = saved(plan.select("skey", "source_size", "target", "n_rows", passes.alias("passes")).withColumn("rest", F.bround(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        take = fit_counts(group["size"].to_numpy(), group["n"].to_numpy(), int(group["rest"].iloc[0]))
        return pd.DataFrame({"skey": group["skey"], "size": group["size"], "chosen": take})

    by_length = spots.where("size > 0").groupBy("skey", "size").agg(F.sum("n").alias("n")).join(plan.select("skey", "rest"), "skey")
    chosen = by_length.groupBy("skey").applyInPandas(fit, "skey string, size long, chosen long").where("chosen > 0")
    w = Window.partitionBy("skey", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    quota = spots.join(chosen, ["skey", "size"])
    quota = quota.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("quota", F.least("n", F.col("chosen") - F.col("before"))).where("quota > 0")
    quota = saved(quota.select("skey", "size", "slot", "quota"))
    # a slot holds 1/256 of even the most frequent length, so the join and the ranking stay even
    order = Window.partitionBy("skey", "size", "slot").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    joined = rows.join(quota, ["skey", "size", "slot"], "left").withColumn("extra", F.when(F.row_number().over(order) <= F.col("quota"), 1).otherwise(0))
    out = heavy_light_join(joined, plan, ["skey"], "n_rows")
    taken = F.when(F.col("size") > 0, F.col("size") * (F.col("passes") + F.col("extra"))).otherwise(0)
    return out.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), *(F.col("kept")[c].alias(f"{c}_" if c.lower() in own else c) for c in keep))
