"""More of the graph of cited claims: support, contested pairs, upserts, redirects, rings; and of pages: menus and running headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from .graph import both_ways

#: Nearest neighbours of a node and the least similarity (fixed values).
SIMILAR, LEAST_SIMILARITY = 5, 0.70
#: Menus and running headers (fixed values).
MENU_LINES, MENU_WORDS, MENU_LINKED, EDGE_LINES, HEADER_PAGES, HEADER_SHARE = 5, 4, 0.7, 3, 4, 0.5


def neighbour_support(edges: DataFrame, node: str) -> DataFrame:
    """(other, support, confidence): distinct passages over all edges between, and the best confidence, -1 without any.  edges: src, dst, cited (array), confidence."""
    near = both_ways(edges.select("src", "dst", "cited", "confidence")).where(F.col("node") == node)
    each = near.groupBy("other").agg(F.coalesce(F.max("confidence"), F.lit(-1.0)).alias("confidence"))
    cited = near.select("other", F.explode("cited").alias("c")).distinct().groupBy("other").agg(F.count("*").alias("support"))
    return each.join(cited, "other", "left").select("other", F.coalesce("support", F.lit(0)).alias("support"), "confidence")


def contested_pairs(edges: DataFrame, limit: int) -> DataFrame:
    """(a, b, newest): pairs of edges that either side marks as contested, each once, newest first.  edges: edge_id, contested_by (array), created."""
    marks = edges.select("edge_id", "created", F.explode("contested_by").alias("other"))
    pairs = marks.select(F.least("edge_id", "other").alias("a"), F.greatest("edge_id", "other").alias("b"), "created")
    return pairs.groupBy("a", "b").agg(F.max("created").alias("newest")).orderBy(F.desc("newest"), "a", "b").limit(limit)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key…, cited, tier, judgement): one claim unites its passages; the judgement of the higher tier stands, at equal tiers the older one.

    old, new: key…, cited (array), tier (int), judgement.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = F.max_by("judgement", F.struct("tier", -F.col("_new")))
    return both.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cited")))).alias("cited"), F.max("tier").alias("tier"), best.alias("judgement"))


def redirected(ids: DataFrame, redirects: DataFrame, column: str) -> DataFrame:
    """``column`` follows (id, to) once.  Merges never chain, so a target that is itself redirected is an error."""
    chain = redirects.alias("a").join(redirects.select(F.col("id").alias("again")), F.col("a.to") == F.col("again"), "left_semi")
    if not chain.isEmpty():
        raise ValueError("a merge leads to an entity that was merged itself")
    r = redirects.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
    return ids.join(r, ids[column] == F.col("_id"), "left").withColumn(column, F.coalesce("_to", column)).drop("_id", "_to")


def edges_like(edges: DataFrame, passages: DataFrame, condition: Column, contested_only: bool = False) -> DataFrame:
    """Edges of which one passage meets the whole condition, or the contested ones.  edges: edge_id, cited (array), contested; passages: chunk_id and what the condition asks."""
    if contested_only:
        return edges.where("contested")
    good = passages.where(F.coalesce(condition, F.lit(False))).select("chunk_id")
    met = edges.select("edge_id", F.explode("cited").alias("chunk_id")).join(good, "chunk_id", "left_semi").select("edge_id").distinct()
    return edges.join(met, "edge_id", "left_semi")


def rings(cited: DataFrame, vectors: DataFrame, query: list[float], inner: int = 12, outer: int = 10, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(ring, id, value, total): the best cited neighbours, and the nearest others that aren't among the cited.  cited: id, support; vectors: id, v."""
    from ..functions.vector import literal

    near = vectors.join(cited.select("id"), "id", "left_anti").select("id", F.round(cosine(F.col("v"), literal(query)), 6).alias("value")).where(F.col("value") >= least)

    def ring(name: str, df: DataFrame, most: int) -> DataFrame:
        top = df.orderBy(F.desc("value"), "id").limit(most)
        return top.join(F.broadcast(df.agg(F.count("*").alias("total")))).select(F.lit(name).alias("ring"), "id", "value", "total")

    return ring("cited", cited.select("id", F.col("support").cast("double").alias("value")), inner).unionByName(ring("similar", near, outer))


def nearest_each(frontier: DataFrame, vectors: DataFrame, top: int = SIMILAR, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(id, other, similarity): the ``top`` nearest of each of a bounded frontier, which is sent to every task.  frontier, vectors: id, v."""
    f = frontier.select("id", F.col("v").alias("w"))
    pairs = vectors.select(F.col("id").alias("other"), "v").join(F.broadcast(f), F.col("id") != F.col("other"))
    near = pairs.select("id", "other", F.round(cosine(F.col("v"), F.col("w")), 6).alias("similarity")).where(F.col("similarity") >= least)
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return near.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")


def weighted_centroids(leaves: DataFrame, least: int = 1) -> DataFrame:
    """(parent, number, size, centroid): size-weighted means of leaves; parents below ``least`` go, the others are numbered anew.  leaves: parent, size, v (array of double).

    Parents are few (one row a group of clusters).
    """
    each = leaves.select("parent", "size", F.posexplode("v").alias("i", "x"))
    mean = each.groupBy("parent", "i").agg(F.round(F.sum(F.col("x") * F.col("size")) / F.sum("size"), 6).alias("x"))
    c = mean.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("centroid"))
    n = leaves.groupBy("parent").agg(F.sum("size").alias("size")).where(F.col("size") >= least)
    return n.join(c, "parent").withColumn("number", F.row_number().over(Window.orderBy("parent")).cast("long") - 1)


def menus(lines: DataFrame) -> DataFrame:
    """(page_id, first, last, lines): runs of at least five short lines most of which hold links, from the first link to the last.

    lines: page_id, i, words, linked.  A run is what stands between longer lines.
    """
    short = F.col("words") <= MENU_WORDS
    run = F.sum((~short).cast("int")).over(Window.partitionBy("page_id").orderBy("i"))
    g = lines.withColumn("run", run).where(short).groupBy("page_id", "run")
    g = g.agg(F.count("*").alias("lines"), F.count_if("linked").alias("links"), F.min(F.when(F.col("linked"), F.col("i"))).alias("first"), F.max(F.when(F.col("linked"), F.col("i"))).alias("last"))
    return g.where((F.col("lines") >= MENU_LINES) & (F.col("links") >= MENU_LINKED * F.col("lines"))).select("page_id", "first", "last", "lines")


def running_headers(lines: DataFrame) -> DataFrame:
    """(source_id, line, pages): lines at the edges of pages that come back, with digits folded, on at least half the pages and four.  lines: source_id, page, i, text."""
    by = Window.partitionBy("source_id", "page")
    edge = (F.row_number().over(by.orderBy("i")) <= EDGE_LINES) | (F.row_number().over(by.orderBy(F.desc("i"))) <= EDGE_LINES)
    folded = F.regexp_replace(F.trim("text"), "[0-9]+", "#")
    n = lines.groupBy("source_id").agg(F.count_distinct("page").alias("of"))
    often = lines.withColumn("edge", edge).where("edge").groupBy("source_id", folded.alias("line")).agg(F.count_distinct("page").alias("pages"))
    return often.join(n, "source_id").where((F.col("pages") >= HEADER_PAGES) & (F.col("pages") >= HEADER_SHARE * F.col("of"))).select("source_id", "line", "pages")


def normal_names(entities: DataFrame, noise: list[str], expand: dict[str, str], name: str = "name") -> DataFrame:
    """``entities`` with ``normal``: decomposed, without marks, case folded, signs as spaces, abbreviations expanded, noise words dropped unless all are."""
    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        s = names.str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True)
        return s.str.casefold().str.replace(r"[^\w\s]|_", " ", regex=True).str.split().str.join(" ")

    words = F.split(fold(F.col(name)), " ")
    if expand:
        table = F.create_map(*(F.lit(x) for pair in expand.items() for x in pair))
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    kept = F.filter(words, lambda w: ~w.isin(*noise))
    return entities.withColumn("normal", F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " "))
