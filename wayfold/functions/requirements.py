"""Requirement predicates over account columns, as higher-order column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skills_met(skills: Column, levels: Column) -> Column:
    """Every skill at its level; an absent skill counts 0."""
    return F.forall(skills, lambda s: F.coalesce(F.try_element_at(levels, s["skill"]), F.lit(0)) >= s["level"])


def quests_met(quests: Column, completed: Column) -> Column:
    return F.size(F.array_except(quests, completed)) == 0


def items_met(items: Column, bag: Column) -> Column:
    """Some alternative holds in full. A quantity of at most 0 asks that the item is absent; otherwise one item id alone has enough."""
    have = lambda t: F.coalesce(F.try_element_at(bag, t["name"]), F.lit(0).cast("long"))
    term = lambda t: F.when(t["qty"] <= 0, have(t) == 0).otherwise(have(t) >= t["qty"])
    return F.when(items.isNull(), F.lit(True)).otherwise(F.exists(items, lambda alt: F.forall(alt, term)))


def var_result(var: Column, value: Column, now: Column) -> Column:
    """"unknown" when the account has no value, else "pass" or "fail": = > < compare, & asks for all mask bits, @ for a cooldown that is over."""
    held = (
        F.when(var["op"] == "=", value == var["value"]).when(var["op"] == ">", value > var["value"]).when(var["op"] == "<", value < var["value"])
        .when(var["op"] == "&", value.bitwiseAND(var["value"]) == var["value"]).otherwise(value + var["value"] < now)
    )
    return F.when(value.isNull(), "unknown").when(held, "pass").otherwise("fail")


def bag_sum(*bags: Column) -> Column:
    """Multiset sum of item maps."""
    total = bags[0]
    for b in bags[1:]:
        total = F.map_zip_with(total, b, lambda _, x, y: F.coalesce(x, F.lit(0).cast("long")) + F.coalesce(y, F.lit(0).cast("long")))
    return total


def tier_flags(tier: Column) -> Column:
    """One flag per diary tier reached, as (tier, flag)."""
    order = F.array(F.lit("Easy"), F.lit("Medium"), F.lit("Hard"), F.lit("Elite"))
    return F.transform(order, lambda t: F.struct(t.alias("tier"), (F.array_position(order, tier) >= F.array_position(order, t)).alias("reached")))
