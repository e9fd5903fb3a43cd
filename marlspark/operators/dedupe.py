"""Duplicates among sources and passages: shared passages, near titles, novelty, chains of copies, boilerplate lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpoint
from ..functions.vector import dot, unit

#: Thresholds (fixed values): share of passages, sources that make a passage common, pages and share that make a line boilerplate.
EXACT_SHARE, COMMON, LINE_PAGES, LINE_SHARE = 0.9, 50, 5, 0.3


def shared_passages(chunks: DataFrame, share: float = EXACT_SHARE, common: int = COMMON, least: int = 1) -> DataFrame:
    """(later, earlier, share): sources most of whose distinct passages are in one earlier source.

    Passages of more than ``common`` sources pair nothing up but stay in the denominator; so a hash makes at most common**2 / 2 pairs.
    """
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    marks = chunks.select("source_id", F.md5(text).alias("mark")).distinct()
    total = marks.groupBy("source_id").agg(F.count("*").alias("n"))
    rare = marks.groupBy("mark").agg(F.count("*").alias("k")).where((F.col("k") > 1) & (F.col("k") <= common))
    some = marks.join(rare.select("mark"), "mark")
    a, b = some.select("mark", F.col("source_id").alias("later")), some.select("mark", F.col("source_id").alias("earlier"))
    pairs = a.join(b, "mark").where("earlier < later").groupBy("later", "earlier").agg(F.count("*").alias("both"))
    scored = pairs.join(total, F.col("later") == F.col("source_id")).withColumn("share", F.col("both") / F.col("n"))
    best = F.row_number().over(Window.partitionBy("later").orderBy(F.desc("share"), "earlier"))
    return scored.where(F.col("share") >= share).withColumn("r", best).where("r = 1").select("later", "earlier", F.round("share", 6).alias("share"))


def near_titles(sources: DataFrame, similarity: float = 0.985, ratio: float = 0.6, least: int = 8) -> DataFrame:
    """(later, earlier, similarity) of sources with one title key, a near vector and a like length.  sources: source_id, title, v, n_chars."""
    key = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    s = sources.select("source_id", key.alias("key"), unit(F.col("v")).alias("u"), "n_chars").where(F.char_length("key") >= least)
    a, b = (s.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("source_id", "u", "n_chars"))) for x in "ab")
    sim = F.round(dot(F.col("a_u"), F.col("b_u")), 6)
    like = F.least("a_n_chars", "b_n_chars") / F.greatest("a_n_chars", "b_n_chars")
    pairs = a.join(b, "key").where(F.col("b_source_id") < F.col("a_source_id")).where((sim >= similarity) & (like >= ratio)).withColumn("similarity", sim)
    best = F.max_by("b_source_id", F.struct("similarity", -F.col("b_source_id"))).alias("earlier")
    return pairs.groupBy(F.col("a_source_id").alias("later")).agg(best, F.max("similarity").alias("similarity"))


def translation_pairs(alternates: DataFrame, urls: DataFrame) -> DataFrame:
    """(later, earlier): sources whose declared English version is another source; fragments and closing slashes don't count, the smaller id has an address.

    alternates: source_id, url; urls: source_id, url, several for a source.
    """
    bare = F.regexp_replace(F.split_part("url", F.lit("#"), F.lit(1)), "/+$", "")
    known = urls.where("url <> ''").groupBy(bare.alias("at")).agg(F.min("source_id").alias("earlier"))
    return alternates.select(F.col("source_id").alias("later"), bare.alias("at")).join(known, "at").where("later <> earlier").select("later", "earlier")


#: Parts that the vectors of ``nearest_earlier`` are dealt to: every two parts meet in a task, so a vector comes back from as many tasks.
PARTS = 24


def nearest_earlier(vectors: DataFrame, above: float = 0.95, block: int = 8192, pivots: int = 64, tile: int = 512) -> DataFrame:
    """(chunk_id, earlier, similarity): each vector's nearest among smaller ids, if strictly nearer than ``above``.

    Vectors go to the nearest of ``pivots`` pivots and, ordered by that and their angle from it, into blocks.  Angles obey the triangle inequality, so two blocks whose angles from some
    pivot are further apart than arccos(above) hold no such pair and aren't multiplied.  The pairs are quadratic, but nothing is shuffled for them: blocks are written once, and a task reads the blocks of
    two of at most PARTS parts, multiplies each two once, ``tile`` rows at a time and in single precision, measures what may be nearest in double precision, and yields one row a vector at most.
    Null vectors take no part; a zero vector is like nothing.
    """
    import math

    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    plain = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("v").cast("array<double>").alias("v")).where("v is not null")
    if above >= 0:
        plain = plain.where(F.exists("v", lambda x: x != 0))
    chosen = plain.select("v").orderBy(F.xxhash64("v")).limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], "chunk_id long, earlier long, similarity double")

    def units(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    sent = spark.sparkContext.broadcast(units(np.array([r["v"] for r in chosen])))  # ``pivots`` vectors
    reach = math.acos(max(-1.0, min(1.0, above - 1e-6))) + 1e-6 if above >= 0 else math.pi
    matrix = lambda column: np.asarray(column.flatten()).reshape(len(column), -1)

    def near_pivots(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                x = units(matrix(part.column(1)))
                angle = np.arccos(np.clip(x @ sent.value.T, -1, 1))
                cell = angle.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(x.reshape(-1), x.shape[1]).cast(pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])], ["chunk_id", "v", "cell", "angle"])

    parts = max(1, min(PARTS, plain.count() // 4096))
    dealt = plain.mapInArrow(near_pivots, "chunk_id long, v array<double>, cell int, angle double").repartitionByRange(parts, "cell", "angle", "chunk_id").sortWithinPartitions("cell", "angle", "chunk_id")
    fields = "pack long, ids binary, vecs binary, low array<double>, high array<double>, cells array<struct<cell:int,low:double,high:double>>"
    schema = pa.schema([("pack", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("cells", pa.list_(pa.struct([("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])))])

    def packed(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                ids, x, cell, own = np.asarray(part.column(0)), matrix(part.column(1)), np.asarray(part.column(2)), np.asarray(part.column(3))
                angle = np.arccos(np.clip(x @ sent.value.T, -1, 1))
                cells = [{"cell": int(c), "low": float(own[cell == c].min()), "high": float(own[cell == c].max())} for c in np.unique(cell)]
                by_id = np.argsort(ids, kind="stable")
                yield pa.RecordBatch.from_pylist([{"pack": task << 32 | n, "ids": ids[by_id].tobytes(), "vecs": x[by_id].tobytes(), "low": angle.min(0).tolist(), "high": angle.max(0).tolist(), "cells": cells}], schema=schema)
                n += 1

    packs = checkpoint(dealt.mapInArrow(packed, fields)).coalesce(parts)
    one = packs.select(F.col("pack").alias("a"), F.col("ids").alias("ids_a"), F.col("vecs").alias("vecs_a"), "low", "high")
    two = packs.select(F.col("pack").alias("b"), F.col("ids").alias("ids_b"), F.col("vecs").alias("vecs_b"), "cells")
    from_pivot = lambda side, c: F.element_at(side, c["cell"] + 1)
    near = F.exists("cells", lambda c: (from_pivot(F.col("low"), c) - c["high"] <= reach) & (c["low"] - from_pivot(F.col("high"), c) <= reach))
    # a product of partitions, each read where it lies: to meet by a shuffle, a block would be copied once for every other
    pairs = one.join(two.hint("shuffle_replicate_nl"), (F.col("a") <= F.col("b")) & near).select("a", "ids_a", "vecs_a", "b", "ids_b", "vecs_b")

    def run(batches):
        best: dict[int, tuple] = {}  # of each block met: ids, the similarity of the nearest so far, and which it is

        for batch in batches:
            for k in range(batch.num_rows):
                (a, ia, va), (b, ib, vb) = ((batch.column(at)[k].as_py(), np.frombuffer(batch.column(at + 1)[k].as_buffer(), np.int64), np.frombuffer(batch.column(at + 2)[k].as_buffer())) for at in (0, 3))
                for pack, ids in ((a, ia), (b, ib)):
                    if pack not in best:
                        best[pack] = ids.copy(), np.full(len(ids), above), np.full(len(ids), np.iinfo(np.int64).max)
                meet(va.reshape(len(ia), -1), vb.reshape(len(ib), -1), best[a], best[b], tile, a == b)
        for ids, sim, which in best.values():
            ok = sim > above
            yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(which[ok]), pa.array(sim[ok])], ["chunk_id", "earlier", "similarity"])

    # dealt by id before they are summed up: a task has each vector once, so there is nothing to sum up before
    found = pairs.mapInArrow(run, "chunk_id long, earlier long, similarity double").repartition("chunk_id")
    return found.groupBy("chunk_id").agg(F.max_by("earlier", F.struct("similarity", -F.col("earlier"))).alias("earlier"), F.max("similarity").alias("similarity"))


def meet(x, y, best_x: tuple, best_y: tuple, tile: int, same: bool) -> None:
    """Take the nearest of smaller ids into (ids, similarity, which) of two blocks of unit vectors, each sorted by id; of equal similarity, rounded to six places, the smaller id.  same: they are one block."""
    import numpy as np

    small_x, small_y = x.astype(np.float32), y.astype(np.float32)
    # by how much a product in single precision may be off, twice, and what rounding makes equal
    slack = 2 * (x.shape[1] + 4) * 2.0**-23 + 1e-6

    def improve(s, own, v, other, w, best, at):
        ids, sim, which = best
        top = s.max(1)
        rows = np.flatnonzero(top >= sim[at] - slack)
        if not len(rows):
            return
        r, c = np.nonzero(s[rows] >= (top[rows] - slack)[:, None])
        r = rows[r]
        ok = other[c] < own[r]
        r, c = r[ok], c[ok]
        exact = np.round(np.einsum("ij,ij->i", v[r], w[c]), 6)
        order = np.lexsort((other[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.r_[True, r[1:] != r[:-1]][: len(r)]
        r, exact, earlier = r[first], exact[first], other[c[first]]
        now, who = sim[at][r], which[at][r]
        # what stands in ``sim`` without a vector is the threshold, which must be passed
        better = (exact > now) | ((exact == now) & (earlier < who) & (who != np.iinfo(np.int64).max))
        sim[at][r[better]], which[at][r[better]] = exact[better], earlier[better]

    wide = 1024
    for i in range(0, len(x), tile):
        p = slice(i, i + tile)
        own = best_x[0][p]
        for j in range(0, len(y), wide):
            q = slice(j, j + wide)
            other = best_y[0][q]
            x_later, y_later = own[-1] > other[0], other[-1] > own[0] and not same
            if not (x_later or y_later):
                continue
            s = small_x[p] @ small_y[q].T
            if x_later:
                improve(s if other[-1] < own[0] else np.where(other[None, :] < own[:, None], s, np.float32(-2)), own, x[p], other, y[q], best_x, p)
            if y_later:
                improve((s if own[-1] < other[0] else np.where(own[:, None] < other[None, :], s, np.float32(-2))).T, other, y[q], own, x[p], best_y, q)


def roots(pointers: DataFrame, checkpoint) -> DataFrame:
    """(id, root) of (id, to), each id at most once: the end of its chain, by pointer jumping; a loop's root is its smallest id.

    ``checkpoint`` writes a table between rounds.  After k rounds a pointer spans 2**k steps and ``least`` is the smallest id on them, so
    2**k beyond the number of ids still on the way means that only loops are left.
    """
    now = checkpoint(pointers.select("id", "to", F.least("id", "to").alias("least"), F.lit(True).alias("moving")))
    steps = 1
    while steps <= now.where("moving").count():
        on = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("least").alias("less"))
        now = checkpoint(
            now.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.least("least", F.coalesce("less", "least")).alias("least"), F.col("next").isNotNull().alias("moving"))
        )
        steps *= 2
    # what is left moves into a loop: there ``to`` is on the loop, and its smallest id is the loop's
    loops = now.select(F.col("id").alias("to"), F.col("least").alias("_loop"))
    return now.join(loops, "to", "left").select("id", F.when(F.col("moving"), F.col("_loop")).otherwise(F.col("to")).alias("root"))


def boilerplate(lines: DataFrame, pages: int = LINE_PAGES, share: float = LINE_SHARE) -> DataFrame:
    """(host, line, n): lines of (host, page_id, line) on at least ``pages`` pages and ``share`` of their host's pages."""
    once = lines.distinct()
    size = lines.select("host", "page_id").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    often = once.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= pages)
    return often.join(size, "host").where(F.col("n") >= share * F.col("pages")).select("host", "line", "n")
