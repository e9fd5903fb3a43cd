"""Bridges between sibling areas: claims whose evidence lies in both, nearest passages of each, terms in common.

Areas are a tree of some levels (area, level, parent); a leaf is an area that passages belong to.  Only siblings, areas of one level and parent, are bridged.  What is held in one task is a pair's few
candidates; claims and passages are joins and windows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot, unit

#: Siblings that an area gets a bridge to, passages of each side that are compared, and pairs that are kept (fixed values).
NEIGHBOURS, CANDIDATES, PAIRS = 3, 40, 3


def lineage(areas: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(leaf, level, area, parent): every area with itself and all above it.  areas: area, level, parent."""
    up = areas.select(F.col("area").alias("at"), "level", "parent")
    front = checkpoint(areas.select(F.col("area").alias("leaf"), F.col("area").alias("at")))
    out = None
    while not front.isEmpty():  # a round a level
        step = checkpoint(front.join(up, "at").select("leaf", "level", F.col("at").alias("area"), "parent"))
        out = step if out is None else out.unionByName(step)
        front = step.where("parent is not null").select("leaf", F.col("parent").alias("at"))
    return out if out is not None else areas.sparkSession.createDataFrame([], "leaf long, level int, area long, parent long")


def anchors(entities: DataFrame, members: DataFrame) -> DataFrame:
    """(node, leaf): the leaf in which most of a node's passages lie, ties to the smaller leaf.  entities: node, chunks; members: chunk_id, leaf."""
    each = entities.select("node", F.explode("chunks").alias("chunk_id")).join(members.select("chunk_id", "leaf"), "chunk_id").groupBy("node", "leaf").agg(F.count("*").alias("n"))
    return each.groupBy("node").agg(F.min_by("leaf", F.struct(-F.col("n"), F.col("leaf"))).alias("leaf"))


def cited(edges: DataFrame, homes: DataFrame, members: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b, level, edges, sources): siblings a < b that the evidence of a claim spans, with the claims (sorted) and the number of sources they cite.

    A claim lies in the leaves of its passages and in the homes of its ends.  edges: edge_id, src, dst, chunks; homes: node, leaf; members: chunk_id, leaf, source_id; lines: of ``lineage``.
    """
    e = edges.select("edge_id", "src", "dst", "chunks")
    said = e.select("edge_id", F.explode("chunks").alias("chunk_id")).join(members, "chunk_id")
    ends = e.select("edge_id", F.explode(F.array("src", "dst")).alias("node")).join(homes, "node")
    leaves = said.select("edge_id", "leaf").unionByName(ends.select("edge_id", "leaf")).distinct()
    # the areas of a claim by level and parent: siblings, a bounded list
    at = leaves.join(lines, "leaf").select("edge_id", "level", F.coalesce("parent", F.lit(-1)).alias("parent"), "area").distinct()
    spans = at.groupBy("edge_id", "level", "parent").agg(F.sort_array(F.collect_list("area")).alias("of")).where(F.size("of") > 1)
    pairs = spans.select("edge_id", "level", "of", F.posexplode("of").alias("i", "a")).select("edge_id", "level", "a", F.explode(F.slice("of", F.col("i") + 2, F.size("of"))).alias("b"))
    sources = pairs.join(said.select("edge_id", "source_id").distinct(), "edge_id", "left").groupBy("a", "b").agg(F.count_distinct("source_id").alias("sources"))
    return pairs.groupBy("a", "b", "level").agg(F.sort_array(F.collect_set("edge_id")).alias("edges")).join(sources, ["a", "b"])


def siblings(areas: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(a, b): each area with its nearest siblings, a < b.  areas: area, level, parent, centroid; children of one area are few."""
    x = areas.select("level", F.coalesce("parent", F.lit(-1)).alias("parent"), "area", unit(F.col("centroid")).alias("u"))
    y = x.select("level", "parent", F.col("area").alias("other"), F.col("u").alias("w"))
    s = x.join(y, ["level", "parent"]).where("area <> other").withColumn("s", F.round(dot(F.col("u"), F.col("w")), 9))
    near = s.withColumn("r", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("s"), "other"))).where(F.col("r") <= neighbours)
    return near.select(F.least("area", "other").alias("a"), F.greatest("area", "other").alias("b")).distinct()


def best_pairs(rows: pd.DataFrame, k: int) -> list[dict]:
    """Down the pairs of both sides' candidates, most similar first, none of them twice.  rows: side, chunk_id, v of one pair of areas."""
    import numpy as np

    sides = [rows[rows["side"] == s].sort_values("chunk_id") for s in ("a", "b")]
    if any(s.empty for s in sides):
        return []
    x, y = (np.array(s["v"].tolist(), float) for s in sides)
    x, y = (z / np.where((n := np.linalg.norm(z, axis=1, keepdims=True)) == 0, 1, n) for z in (x, y))
    sim = np.round(x @ y.T, 9)
    out, used = [], (set(), set())
    for at in np.argsort(-sim, axis=None, kind="stable"):
        i, j = divmod(int(at), len(y))
        p, q = int(sides[0]["chunk_id"].iloc[i]), int(sides[1]["chunk_id"].iloc[j])
        if i in used[0] or j in used[1] or p == q:
            continue
        out.append({"chunk_a": p, "chunk_b": q, "score": round(float(sim[i, j]), 4)})
        used[0].add(i)
        used[1].add(j)
        if len(out) == k:
            break
    return out


def nearest_passages(pairs: DataFrame, areas: DataFrame, members: DataFrame, lines: DataFrame, candidates: int = CANDIDATES, k: int = PAIRS) -> DataFrame:
    """(a, b, similar): for each pair of areas the k most similar passages of both, from the ``candidates`` of each side that lie nearest the other's centre.  members: chunk_id, leaf, v."""
    c = areas.select("area", unit(F.col("centroid")).alias("w"))
    sides = pairs.select("a", "b", F.lit("a").alias("side"), F.col("a").alias("area"), F.col("b").alias("towards")).unionByName(pairs.select("a", "b", F.lit("b"), F.col("b").alias("area"), F.col("a").alias("towards")).toDF("a", "b", "side", "area", "towards"))
    asked = sides.join(c.withColumnRenamed("area", "towards"), "towards").join(lines.select("leaf", "area"), "area")
    near = members.select("chunk_id", "leaf", "v").join(asked, "leaf").withColumn("s", F.round(dot(unit(F.col("v")), F.col("w")), 9))
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("a", "b", "side").orderBy(F.desc("s"), "chunk_id"))).where(F.col("r") <= candidates)

    def pick(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"a": key[0], "b": key[1], "similar": best_pairs(rows, k)}])

    # at most twice ``candidates`` rows a pair
    return few.select("a", "b", "side", "chunk_id", "v").groupBy("a", "b").applyInPandas(pick, "a long, b long, similar array<struct<chunk_a:long,chunk_b:long,score:double>>")


def bridges(areas: DataFrame, members: DataFrame, edges: DataFrame, entities: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(level, a, b, similarity, edges, sources, similar, shared_terms): every bridge of a build.

    areas: area, level, parent, centroid, terms; members: chunk_id, leaf, source_id, v; edges: edge_id, src, dst, chunks; entities: node, chunks, annotation.  Claims with a reader's
    note at one end are none that a source makes.
    """
    notes = entities.where("annotation").select("node")
    claims = edges.join(notes.withColumnRenamed("node", "src"), "src", "left_anti").join(notes.withColumnRenamed("node", "dst"), "dst", "left_anti")
    lines = checkpoint(lineage(areas.select("area", "level", "parent"), checkpoint))
    said = checkpoint(cited(claims, anchors(entities, members), members.select("chunk_id", "leaf", "source_id"), lines))
    pairs = checkpoint(siblings(areas).unionByName(said.select("a", "b")).distinct())
    similar = nearest_passages(pairs, areas, members, lines)
    one, two = (areas.select(F.col("area").alias(x), F.col("level").alias(f"level_{x}"), unit(F.col("centroid")).alias(f"u_{x}"), F.col("terms").alias(f"terms_{x}")) for x in "ab")
    out = pairs.join(one, "a").join(two, "b").join(said.drop("level"), ["a", "b"], "left").join(similar, ["a", "b"], "left")
    return out.select(
        F.col("level_a").alias("level"), "a", "b", F.round(dot(F.col("u_a"), F.col("u_b")), 4).alias("similarity"), F.coalesce("edges", F.array().cast("array<long>")).alias("edges"),
        F.coalesce("sources", F.lit(0).cast("long")).alias("sources"), F.coalesce("similar", F.array().cast("array<struct<chunk_a:long,chunk_b:long,score:double>>")).alias("similar"),
        F.filter("terms_a", lambda t: F.array_contains("terms_b", t)).alias("shared_terms"),
    )
