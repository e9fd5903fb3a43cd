"""Claims and entities as merges leave them, undone exactly.

Claims are kept as they were written; merges are a log (merge_id, source, target, at, reversed_at).  What is shown is computed from both: ends follow the merges that stand, and claims that
are then equal are one.  A merge taken back is a row less in the log, so every claim is again what it was, whatever was folded or written since; nothing has to be patched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standing(log: DataFrame, until: str | None = None) -> DataFrame:
    """(source, target) of the merges made before ``until`` and not taken back by then; a source that was merged twice follows the later one."""
    made = log if until is None else log.where(F.col("at") < F.lit(until).cast("timestamp_ntz"))
    live = F.col("reversed_at").isNull() if until is None else F.col("reversed_at").isNull() | (F.col("reversed_at") >= F.lit(until).cast("timestamp_ntz"))
    return made.where(live & (F.col("source") != F.col("target"))).groupBy("source").agg(F.max_by("target", F.struct("at", "merge_id")).alias("target"))


def homes(merges: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(source, home): where each source ends up after all its steps; every round doubles the steps known.  Sources that lead into a circle have its smallest member as home."""
    step = checkpoint(merges.select("source", F.col("target").alias("home"), F.least("source", "target").alias("least")))
    for _ in range(step.count().bit_length()):  # then as many steps are known as there are merges
        after = step.select(F.col("source").alias("home"), F.col("home").alias("further"), F.col("least").alias("more"))
        step = checkpoint(step.join(after, "home", "left").select("source", F.coalesce("further", "home").alias("home"), F.least("least", F.coalesce("more", "least")).alias("least")))
    # a home that is a source itself lies in a circle, and by now its ``least`` is that of the whole circle
    circle = step.select(F.col("source").alias("home"), F.col("least").alias("smallest"))
    return step.select("source", "home").join(circle, "home", "left").select("source", F.coalesce("smallest", "home").alias("home"))


def claims(written: DataFrame, merged: DataFrame) -> DataFrame:
    """(claim_id, src, dst, relation, stance, support, tier, confidence, folded): claims after the merges (source, home).

    Equal claims are one under the smallest id; their passages are united, and the judgement is that of the highest tier, of equal ones the smaller id.  A claim
    whose ends became one is left out.  written: claim_id, src, dst, relation, stance, support (array), tier, confidence.
    """
    a, b = (merged.select(F.col("source").alias(end), F.col("home").alias(f"{end}_home")) for end in ("src", "dst"))
    w = written.join(a, "src", "left").join(b, "dst", "left").withColumns({"src": F.coalesce("src_home", "src"), "dst": F.coalesce("dst_home", "dst")}).where("src <> dst")
    judged = F.max_by(F.struct("tier", "confidence"), F.struct(F.coalesce("tier", F.lit(0)).alias("t"), (-F.col("claim_id")).alias("i")))
    support = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("support", F.array().cast("array<long>"))))))
    g = w.groupBy("src", "dst", "relation", "stance").agg(F.min("claim_id").alias("claim_id"), support.alias("support"), judged.alias("j"), F.count("*").alias("folded"))
    return g.select("claim_id", "src", "dst", "relation", "stance", "support", "j.tier", "j.confidence", "folded")


def entities(written: DataFrame, merged: DataFrame) -> DataFrame:
    """(entity_id, name, aliases, merged_from, redirects_to): entities after the merges; a home has the names and aliases of all that came to it, in order.  written: entity_id, name, aliases."""
    none = F.array().cast("array<string>")
    came = written.join(merged.withColumnRenamed("source", "entity_id"), "entity_id").groupBy("home").agg(
        F.flatten(F.collect_list(F.concat(F.coalesce("aliases", none), F.array("name")))).alias("more"), F.sort_array(F.collect_list("entity_id")).alias("merged_from")
    )
    e = written.join(came.withColumnRenamed("home", "entity_id"), "entity_id", "left").join(merged.withColumnRenamed("source", "entity_id").withColumnRenamed("home", "redirects_to"), "entity_id", "left")
    names = F.when(F.col("more").isNull(), F.coalesce("aliases", none)).otherwise(F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", none), "more"))))
    return e.select("entity_id", "name", names.alias("aliases"), F.coalesce("merged_from", F.array().cast("array<long>")).alias("merged_from"), "redirects_to")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(claim_id, change) between two states of ``claims``: ``gone`` (folded, or its ends became one), ``back``, ``moved`` (other ends), ``changed`` (other support or judgement)."""
    x, y = (t.select("claim_id", F.struct("src", "dst").alias(f"e_{k}"), F.struct("support", "tier", "confidence").alias(f"v_{k}")) for k, t in (("x", before), ("y", after)))
    both = x.join(y, "claim_id", "full")
    what = F.when(F.col("e_y").isNull(), "gone").when(F.col("e_x").isNull(), "back").when(F.col("e_x") != F.col("e_y"), "moved").when(~F.col("v_x").eqNullSafe(F.col("v_y")), "changed")
    return both.select("claim_id", what.alias("change")).where("change is not null")
