"""Predicates that searches, counts and models share, so that what is counted is what is found."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """What a search may ask for; an empty field asks for nothing."""

    tiers: Sequence[str] = ()
    languages: Sequence[str] = ()
    any_topic: Sequence[str] = ()
    all_topics: Sequence[str] = ()
    since: str | None = None
    until: str | None = None
    sites: Sequence[str] = ()
    cleared_only: bool = False
    with_junk: bool = False


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def overlap(column: str, wanted: Sequence[str]) -> Column:
    """Whether the arrays share an element; a null array never does."""
    return F.coalesce(F.arrays_overlap(F.col(column), strings(wanted)), F.lit(False))


def contains_all(column: str, wanted: Sequence[str], other: str | None = None) -> Column:
    """Whether all of ``wanted`` are in the array, or in it and another together; null arrays count as empty there."""
    none = F.array().cast("array<string>")
    have = F.coalesce(F.col(column), none)
    if other:
        have = F.array_union(have, F.coalesce(F.col(other), none))
    return F.size(F.array_except(strings(wanted), have)) == 0


def on_site(host: str, sites: Sequence[str]) -> Column:
    """The host itself or one below it; a pasted address counts by its host, and without any usable site nothing matches."""
    out = F.lit(False)
    for s in sites:
        key = s.split("://")[-1].split("/")[0].split("@")[-1].split(":")[0].lower().removeprefix("www.").strip()
        if key:
            out = out | (F.col(host) == key) | F.col(host).endswith("." + key)
    return out


def kept() -> Column:
    return F.col("retention") != "junk"


def conditions(f: Filters) -> Column:
    """The one definition of a search's filter."""
    out = F.lit(True)
    if not f.with_junk:
        out = out & kept()
    if f.tiers:
        out = out & F.col("tier").isin(*f.tiers)
    if f.languages:
        out = out & F.col("language").isin(*f.languages)
    if f.any_topic:
        out = out & overlap("topics", f.any_topic)
    if f.all_topics:
        out = out & contains_all("topics", f.all_topics)
    if f.since:
        out = out & (F.col("published") >= F.lit(f.since).cast("date"))
    if f.until:
        out = out & (F.col("published") <= F.lit(f.until).cast("date"))
    if f.sites:
        out = out & on_site("host", f.sites)
    if f.cleared_only:
        out = out & (F.col("trust") == "cleared")
    return F.coalesce(out, F.lit(False))


def long_enough(column: str = "text", least: int = 40) -> Column:
    return F.char_length(column) >= least


def cross_topic(a: str, b: str) -> Column:
    """Both sides have topics and share none; an unknown side is not different."""
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))


def embedding_tier(index: str = "chunk_index", first: int = 16, every: int = 16) -> Column:
    """The pass in which a passage is embedded: every row falls in exactly one."""
    i = F.coalesce(F.col(index), F.lit(0))
    return F.when(i < first, "first").when(i % every == 0, "then").otherwise("last")
