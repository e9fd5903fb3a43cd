"""A draw for people to grade: a fixed number of items dealt to strata by their size, the same for the same seed however rows lie, and what the grades say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Normal quantile of the interval (fixed value).
Z = 1.96


def ticket(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def allocation(population: DataFrame, size: int, by: str = "stratum") -> DataFrame:
    """(by, n, take): ``size`` dealt in proportion to n, whole parts first and the rest to the largest remainders, ties by name; no stratum gives more than it has.  population: by, n."""
    total = population.agg(F.sum("n").alias("total"))
    p = population.join(F.broadcast(total)).where("n > 0").withColumn("size", F.least(F.lit(size).cast("long"), F.col("total")))
    whole = F.floor(F.col("size") * F.col("n") / F.col("total"))
    rest = F.col("size") * F.col("n") - whole * F.col("total")
    # strata are few: one row each
    p = p.withColumns({"whole": whole, "rest": rest}).withColumn("left", F.col("size") - F.sum("whole").over(Window.partitionBy()))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), by))
    return p.select(by, "n", (F.col("whole") + (place <= F.col("left")).cast("long")).alias("take"))


def draw(items: DataFrame, key: str, by: str, size: int, seed: str, ts: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """(by, key, position, n, take): the items drawn from each stratum in [since, until), in the order of their tickets.

    Only the first ``take`` of each stratum are shuffled; nothing depends on how rows are partitioned.
    """
    rows = items
    if since is not None:
        rows = rows.where(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.where(F.col(ts) < F.lit(until).cast("timestamp_ntz"))
    dealt = allocation(rows.groupBy(by).agg(F.count("*").alias("n")), size, by)
    first = F.row_number().over(Window.partitionBy(by).orderBy("ticket", key))
    few = rows.select(by, key, ticket(F.col(key), seed).alias("ticket")).withColumn("position", first.cast("long")).where(F.col("position") <= size)
    return few.join(dealt, by).where("position <= take").select(by, key, "position", "n", "take")


def report(drawn: DataFrame, grades: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n, drawn, graded, right, share, low, high): how many of each stratum's graded items are right, with the Wilson interval.  grades: key, right (null: can't tell)."""
    g = drawn.join(grades.where(F.col("right").isNotNull()).groupBy(key).agg(F.bool_and("right").alias("right")), key, "left")
    s = g.groupBy(by).agg(F.first("n").alias("n"), F.count("*").alias("drawn"), F.count("right").alias("graded"), F.count_if("right").alias("right"))
    k, p = F.col("graded"), F.col("right") / F.nullif("graded", F.lit(0))
    mid, width, below = p + Z * Z / (2 * k), Z * F.sqrt(p * (1 - p) / k + Z * Z / (4 * k * k)), 1 + Z * Z / k
    bound = lambda c: F.when(k > 0, F.round(c / below, 6))
    return s.select(by, "n", "drawn", "graded", "right", F.round(p, 6).alias("share"), bound(F.greatest(mid - width, F.lit(0.0))).alias("low"), bound(mid + width).alias("high"))
