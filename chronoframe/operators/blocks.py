"""Work in resumable blocks: what is still to do, how much of it a call may do, and whether old results still count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe import parameters as P


def blocks(spans: DataFrame, keys: list[str], length: float = P.SWEEP_BLOCK) -> DataFrame:
    """Blocks of `length` of each span (keys, a, b): keys, block, lo, hi."""
    count = F.greatest(F.lit(1), F.ceil((F.col("b") - F.col("a")) / F.lit(length))).cast("long")
    rows = spans.select(*keys, "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
    lo = F.col("a") + F.col("block") * F.lit(length)
    return rows.select(*keys, "block", lo.alias("lo"), F.least(F.col("b"), lo + F.lit(length)).alias("hi"))


def pending(planned: DataFrame, done: DataFrame, same: list[str]) -> DataFrame:
    """Planned blocks without a finished one that agrees in the columns `same`; a damaged block has none and is done again."""
    return planned.join(done.select(*same).distinct(), same, "left_anti")


def within_budget(rows: DataFrame, keys: list[str], order: list[str], cost: str, budget: int = P.SWEEP_BUDGET) -> DataFrame:
    """rows with `now`: whether the costs up to and with this row fit the budget. Once a row does not fit, no later one is taken."""
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("now", F.sum(cost).over(along) <= budget)


def same_settings(old: Column, new: Column) -> Column:
    """Whether results of old settings may be gone on with: null counts as a value."""
    return old.eqNullSafe(new)
