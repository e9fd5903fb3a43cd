"""Joins and aggregates that Spark has no single operator for, as compositions of those it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, width: float) -> DataFrame:
    """Rows of ``left`` with the ranges [lo, hi) that hold their value: an equi-join on bins of ``width``, then the exact test."""
    bins = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    binned = left.withColumn("_bin", F.floor(F.col(value) / width))
    return binned.join(bins, "_bin").where((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """Each row of ``left`` with ``value`` of the latest row of ``right`` at or before it: one union and one window.

    Among rows of ``right`` at one moment the largest value counts.
    """
    r = right.groupBy(by, on).agg(F.max(value).alias(value)).withColumn("_side", F.lit(0))
    both = r.unionByName(left.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def interval_join(left: DataFrame, right: DataFrame, left_by: str, right_by: str, left_on: str, right_on: str, seconds: int) -> DataFrame:
    """Pairs with right_on in [left_on, left_on + seconds]: an equi-join on key and bin of time, so that no key meets all its rows."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = seconds * 1_000_000
    a = left.withColumn("_at", at(left_on)).withColumn("_bin", F.explode(F.array(F.floor(F.col("_at") / span), F.floor(F.col("_at") / span) + 1)))
    b = right.withColumn("_other", at(right_on)).withColumn("_bin2", F.floor(F.col("_other") / span))
    on = (F.col(left_by) == F.col(right_by)) & (F.col("_bin") == F.col("_bin2"))
    return a.join(b, on).where(F.col("_other").between(F.col("_at"), F.col("_at") + span)).drop("_at", "_other", "_bin", "_bin2")


def trailing_count(df: DataFrame, key: str, by: str, on: str, seconds: int, alias: str) -> DataFrame:
    """For each row the number of rows of its group in the ``seconds`` up to and including its moment.

    The frame is cut into bins of ``seconds``: each row goes to its own bin and, as a row that only counts, to the next one.  Partitions are then as
    small as a bin of a group, however large the group.
    """
    span = seconds * 1_000_000
    base = df.select(F.col(key), F.col(by), F.unix_micros(F.col(on).cast("timestamp")).alias("_at"))
    base = base.withColumn("_bin", F.floor(F.col("_at") / span))
    twice = base.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_bin", F.when(F.col("_own"), F.col("_bin")).otherwise(F.col("_bin") + 1))
    w = Window.partitionBy(by, "_bin").orderBy("_at").rangeBetween(-span, 0)
    return twice.withColumn(alias, F.count("*").over(w)).where("_own").select(key, alias)


def salted_distinct(df: DataFrame, by: str, value: str, sums: dict[str, str]) -> DataFrame:
    """Distinct values and sums of very few groups, in two steps so that each step has many keys."""
    first = df.groupBy(by, value).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    return first.groupBy(by).agg(F.count(value).alias("n_distinct"), *(F.sum(n).alias(n) for n in sums))
