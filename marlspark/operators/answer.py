"""An answer out of one search's hits: by country where the question is about places, otherwise one list, with what the coverage of each part is.

Every step is a join or a window over the hits of one search, a bounded list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import places as P

#: Publishers of strong coverage, tiers of which it needs one, fewest characters of a passage that is shown where a longer one isn't met (fixed values).
PUBLISHERS, PRIMARY, SHOWN = 3, ["government", "peer_reviewed"], 120
#: What a tier weighs in choosing what leads, and what each further item of one publisher is worth of the one before (fixed values).
TIER_WEIGHT, REPEATED = {"government": 1.5, "peer_reviewed": 1.5, "preprint": 1.2, "institutional": 1.2, "press": 1.0, "informal": 0.8}, 0.5
#: Items of a group and of one list (fixed values).
TOP, TOP_LIST = 5, 10
#: How a question asks about places without naming one (fixed values).
ASKS = r"(?i)\b(?:countries|nations|cities|jurisdictions|worldwide|internationally|globally|around the world|(?:which|what|each|every|per|by|across|other|different) (?:country|city|jurisdiction))\b|^\s*where\b"


def grouping(questions: DataFrame, vocab: DataFrame, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """(id, by, why, named): ``place`` if the question names a country or city, is narrowed to some (``filtered``, codes or null) or asks about places; else ``none``."""
    named = P.counted(questions, vocab, id_col, text_col).groupBy(id_col).agg(F.sort_array(F.collect_set(F.upper(P.country_of(F.col("code"))))).alias("named"))
    q = questions.join(named, id_col, "left")
    why = F.when(F.col("named").isNotNull(), "named").when(F.size(F.coalesce("filtered", F.array().cast("array<string>"))) > 0, "filtered").when(F.col(text_col).rlike(ASKS), "asked").otherwise("neither")
    return q.select(id_col, F.when(why == "neither", "none").otherwise("place").alias("by"), why.alias("why"), F.coalesce("named", F.array().cast("array<string>")).alias("named"))


def _key() -> Column:
    return F.struct(F.char_length(F.trim("text")) >= SHOWN, F.col("score"), -F.col("chunk_id"))


def best_passages(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, chunk_id, score): long passages before short ones, then by score, then the smaller id."""
    best = hits.groupBy(*by).agg(F.max_by(F.struct("chunk_id", "score"), _key()).alias("b"))
    return best.select(*by, "b.chunk_id", "b.score")


def entries(hits: DataFrame, sources: DataFrame, named: DataFrame) -> DataFrame:
    """(code, source_id, chunk_id, score, why): where each source counts, and by which passage; code is null where it counts for no country.

    A source about one country counts there by its best passage; one about several counts for each that a hit of its own names, by the best of those hits.  Others are ``unplaced``
    because they were never examined (places null), name no place (``none``) or several without a passage that names one (``several``).

    hits: chunk_id, source_id, score, text; sources: source_id, places; named: chunk_id, code (a country that the passage names).
    """
    best = best_passages(hits, ["source_id"])
    codes = F.array_distinct(F.transform(F.filter(F.coalesce("places", F.array().cast("array<string>")), lambda c: c != ""), lambda c: F.upper(P.country_of(c))))
    about = sources.join(best.select("source_id"), "source_id", "left_semi").select("source_id", codes.alias("codes"), F.col("places").isNull().alias("unread"))
    one = about.where(F.size("codes") == 1).select("source_id", F.col("codes")[0].alias("code")).join(best, "source_id")
    many = about.where(F.size("codes") > 1).select("source_id", F.explode("codes").alias("code"))
    own = hits.join(named.select("chunk_id", F.upper("code").alias("code")).distinct(), "chunk_id").join(many, ["source_id", "code"])
    there = best_passages(own, ["source_id", "code"])
    rest = about.join(one.select("source_id"), "source_id", "left_anti").join(there.select("source_id").distinct(), "source_id", "left_anti")
    why = F.when(F.col("unread"), "unread").when(F.size("codes") == 0, "none").otherwise("several")
    unplaced = rest.join(best, "source_id").select(F.lit(None).cast("string").alias("code"), "source_id", "chunk_id", "score", why.alias("why"))
    placed = one.select("code", "source_id", "chunk_id", "score").unionByName(there.select("code", "source_id", "chunk_id", "score")).withColumn("why", F.lit("placed"))
    return placed.unionByName(unplaced)


def groups(rows: DataFrame, sources: DataFrame, by: str = "code", top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(by, sources, publishers, tiers, newest, coverage, place) of each group, and (by, item, source_id, chunk_id, score) of those that lead it.

    Coverage is strong with PUBLISHERS publishers and a primary tier among them.  Groups are placed strong first, then by publishers, sources and code.  The items that lead have the best score
    by tier, halved for each better one of the same publisher in the group; ties go to the smaller source.

    sources: source_id, publisher, tier, published.
    """
    about = rows.join(sources.select("source_id", "publisher", "tier", "published"), "source_id")
    strong = (F.count_distinct("publisher") >= PUBLISHERS) & F.bool_or(F.col("tier").isin(*PRIMARY))
    tiers = F.array_sort(F.collect_set("tier"))
    g = about.groupBy(by).agg(F.count("*").alias("sources"), F.count_distinct("publisher").alias("publishers"), tiers.alias("tiers"), F.max("published").alias("newest"), F.when(strong, "strong").otherwise("thin").alias("coverage"))
    place = F.row_number().over(Window.orderBy(F.col("coverage") != "strong", F.desc("publishers"), F.desc("sources"), by))
    table = F.create_map(*(x for t, v in TIER_WEIGHT.items() for x in (F.lit(t), F.lit(v))))
    value = F.col("score") * F.coalesce(F.try_element_at(table, F.col("tier")), F.lit(1.0))
    valued = about.withColumn("value", value).withColumn("nth", F.row_number().over(Window.partitionBy(by, "publisher").orderBy(F.desc("value"), "source_id")))
    lead = valued.withColumn("lead", F.col("value") * F.pow(F.lit(REPEATED), F.col("nth") - 1))
    item = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("lead"), "source_id"))
    items = lead.withColumn("item", item.cast("long")).where(F.col("item") <= top).select(by, "item", "source_id", "chunk_id", "score")
    return g.withColumn("place", place.cast("long")), items


def answer(hits: DataFrame, sources: DataFrame, named: DataFrame, by: str, top: int = TOP) -> DataFrame:
    """One row per item shown: part (``place``, ``unplaced`` or ``list``), place, code, coverage, sources, publishers, tiers, newest, item, source_id, chunk_id, score, passages.

    ``by`` is what ``grouping`` says of the question: with ``none`` all sources are one list.  ``passages`` counts the hits of an item's source.
    """
    n = hits.groupBy("source_id").agg(F.count("*").alias("passages"))
    if by == "none":
        parts = [("list", best_passages(hits, ["source_id"]).withColumn("code", F.lit("")), max(top, TOP_LIST))]
    else:
        e = entries(hits, sources, named)
        parts = [("place", e.where("code is not null"), top), ("unplaced", e.where("code is null").withColumn("code", F.lit("")), top)]
    out = None
    for name, rows, most in parts:
        g, items = groups(rows, sources, "code", most)
        part = items.join(g, "code").join(n, "source_id").select(F.lit(name).alias("part"), "place", "code", "coverage", "sources", "publishers", "tiers", "newest", "item", "source_id", "chunk_id", "score", "passages")
        out = part if out is None else out.unionByName(part)
    return out
