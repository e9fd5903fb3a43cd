"""Corpus reports: coverage, growth, health, gaps, audits, steering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import STRONG_TIERS


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A share, or null where there is nothing to share."""
    return F.when(whole > 0, F.round(part / whole, digits))


def daily(df: DataFrame, ts: str, start: str, days: int, zone_hours: int = 0) -> DataFrame:
    """(day, n) for each of ``days`` local days from ``start``, days without rows included."""
    day = F.to_date(F.col(ts) + F.make_dt_interval(hours=F.lit(zone_hours)))
    calendar = df.sparkSession.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))
    return calendar.join(df.groupBy(day.alias("day")).agg(F.count("*").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def hour_buckets(df: DataFrame, ts: str, now: str, kind: str, hours: int = 24) -> DataFrame:
    """(ago, kind, n): rows by rolling hours that end at ``now``; an hour without rows has n = 0 under each kind."""
    ago = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 3_600_000_000)
    counted = df.withColumn("ago", ago).where((F.col("ago") >= 0) & (F.col("ago") < hours)).groupBy("ago", kind).agg(F.count("*").alias("n"))
    grid = df.select(kind).distinct().withColumn("ago", F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))).select(F.col("ago").cast("long").alias("ago"), kind)
    return grid.join(counted, ["ago", kind], "left").select("ago", kind, F.coalesce("n", F.lit(0)).alias("n"))


def coverage_gaps(sources: DataFrame, today: str, thin: int = 10, strong: int = 3, stale_days: int = 3 * 365) -> DataFrame:
    """(topic, gap, severity): thin topics, else weak ones, and stale ones."""
    t = sources.select(F.explode("topics").alias("topic"), "tier", "published")
    s = t.groupBy("topic").agg(F.count("*").alias("n"), F.count_if(F.col("tier").isin(*STRONG_TIERS)).alias("s"), F.max("published").alias("newest"))
    thin_gap = F.when(F.col("n") < thin, F.struct(F.lit("thin").alias("gap"), (0.6 + 0.4 * (1 - F.col("n") / thin)).alias("severity"))).when(
        F.col("s") < strong, F.struct(F.lit("weak").alias("gap"), (0.35 + 0.2 * (1 - F.col("s") / strong)).alias("severity"))
    )
    stale = F.when(F.datediff(F.lit(today).cast("date"), F.col("newest")) > stale_days, F.struct(F.lit("stale").alias("gap"), F.lit(0.3).alias("severity")))
    rows = s.select("topic", F.explode(F.array_compact(F.array(thin_gap, stale))).alias("g"))
    return rows.select("topic", "g.gap", F.round("g.severity", 6).alias("severity"))


def wilson(correct: Column, wrong: Column, z: float = 1.959963984540054) -> tuple[Column, Column, Column]:
    """(precision, low, high): the share of right answers with its 95 % Wilson interval; null without answers."""
    n = correct + wrong
    p = correct / n
    mid, half, den = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    guard = lambda c: F.when(n > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 6))
    return guard(p), guard((mid - half) / den), guard((mid + half) / den)


def entropy(df: DataFrame, by: str, value: str, least: int = 4) -> DataFrame:
    """(by, n, k, discrimination): Shannon entropy over ln k, times 2(n - k)/n where more than half the values are distinct."""
    c = df.groupBy(by, value).agg(F.count("*").alias("c"))
    total = c.groupBy(by).agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.log("c")).alias("cl"))
    h = (F.log("n") - F.col("cl") / F.col("n")) / F.log(F.greatest("k", F.lit(2)))
    out = F.when(F.col("n") < least, F.lit(None)).when(F.col("k") == 1, 0.0).when(2 * F.col("k") > F.col("n"), h * 2 * (F.col("n") - F.col("k")) / F.col("n")).otherwise(h)
    return total.select(by, "n", "k", F.round(out, 6).alias("discrimination"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def all_refused(attempts: DataFrame, key: str, refused: Column, least: int = 20) -> DataFrame:
    """Keys with at least ``least`` attempts, every one refused."""
    return attempts.groupBy(key).agg(F.count("*").alias("n"), F.every(refused).alias("every")).where((F.col("n") >= least) & F.col("every")).select(key, "n")


def failure_runs(attempts: DataFrame, key: str, ts: str, id_col: str, failed: Column) -> DataFrame:
    """(key, longest, current): runs of failures between successes, by gaps and islands."""
    order = Window.partitionBy(key).orderBy(ts, id_col)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    a = attempts.select(key, failed.alias("failed"), island.alias("island"))
    runs = a.groupBy(key, "island").agg(F.count_if("failed").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.max_by("n", "island").alias("current"))


def cooled_down(events: DataFrame, key: str, ts: str, id_col: str, hours: int) -> DataFrame:
    """Events that follow the previous one of their key by at least ``hours``, the first included."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, id_col))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (gap >= hours * 3_600_000_000)).drop("_before")


def clamp_shares(weights: DataFrame, rounds: int = 12) -> DataFrame:
    """(topic, share): weights scaled to 1, kept within floor and ceiling; what clamping takes or gives is dealt to the rest.

    A configuration of a few rows: each round is a projection over windows on one partition.
    """
    whole = Window.partitionBy(F.lit(1))
    s = weights.withColumn("fixed", F.lit(None).cast("double"))
    for _ in range(rounds):
        free = F.when(F.col("fixed").isNull(), F.col("weight")).otherwise(0.0)
        room = 1 - F.sum(F.coalesce("fixed", F.lit(0.0))).over(whole)
        s = s.withColumn("share", F.coalesce("fixed", free / F.sum(free).over(whole) * room))
        over, under = F.greatest(F.col("share") - F.col("ceiling"), F.lit(0.0)), F.greatest(F.col("floor") - F.col("share"), F.lit(0.0))
        s = s.withColumn("over", F.when(F.col("fixed").isNull(), over).otherwise(0.0)).withColumn("under", F.when(F.col("fixed").isNull(), under).otherwise(0.0))
        excess = F.sum(F.col("over") - F.col("under")).over(whole)
        pin = F.when((excess >= 0) & (F.col("over") > 0), F.col("ceiling")).when((excess <= 0) & (F.col("under") > 0), F.col("floor"))
        s = s.withColumn("fixed", F.coalesce("fixed", pin)).select(*weights.columns, "fixed", "share")
    return s.select("topic", F.round("share", 6).alias("share"))
