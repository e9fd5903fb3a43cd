"""Hard-negative mining by a Voronoi-partitioned distributed join.

Vectors are made whole numbers (``floor(scale * x)``) and compared by their inner product with the anchor.  Adding the component sqrt(M^2 - |x|^2) to a candidate, M being
the largest norm, and 0 to an anchor a turns that order into one of distances: |a, x|^2 = |a|^2 + M^2 - 2 a.x, so the triangle inequality holds bounds.

1. Candidates go to the nearest of ``pivots`` pivots.  Ordered by label, cell and distance from the pivot they are written as blocks; a block knows its labels and,
   for each cell in it, the smallest and largest distance from that pivot.
2. Anchors are ordered the same way and written as groups; a group knows the smallest and largest distance of its anchors from every pivot.
3. Positives: the ``wanted`` nearest members of every cell bound from above how far the last positive of a group can be.  A block is replicated to a
   group only if one of its labels and of the group's is the same and its lower bound isn't beyond that; there the join is exact, and bounds leave out single anchors.
4. Negatives: the positives' scores name intervals of scores, that is, shells around each anchor.  A block is replicated to a group only if it may reach
   a shell and holds another label; again the join there is exact.

A group's blocks are dealt to shards, so that a task has one group and a bounded number of blocks, read one after another, nearest first.  Lists of the shards are merged by a
window.  Equal vectors of one label are held once, with as many of their smallest ids as lists can show, so copies make no large cell; equal anchors are asked once.
Bounds widen a block's reach by a share of 1e-9 for rounding; scores are whole numbers and exact (64-bit products where doubles would not be).

Defined results: rows take no part whose id, label or vector is null, that hold null or non-finite components, that have another length than most (of two lengths
equally frequent the larger counts), or whose whole numbers have a norm of 2^31 or more, as their scores may pass a long; zero vectors take part.  Rows that repeat
id, label and vector count once; of rows that share an id but not the rest each counts, and none is a positive of an anchor of that id.
A label below the shift's modulus moves on by one for ids that the shift divides.  Ties go to the smaller id.  A pair of anchor and
positive without a negative yields no row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, shuffle_partitions, stored

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Rows of a block of candidates and of a group of anchors, and blocks of a group that one task reads.
BLOCK, GROUP, BLOCKS = 1024, 2048, 256
SLACK = 1e-9
FIELDS = "n long, vecs binary, labels binary, ids binary, n_ids binary"


def whole(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, q): the rows that take part, in whole numbers."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    v = v.where("vec_id is not null and label is not null and vec is not null").where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 31))))
    v = v.withColumn("q", F.transform("vec", lambda x: F.floor(x * scale))).drop("vec")
    v = v.where(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < float(1 << 62))
    common = v.groupBy(F.size("q").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return v.where(F.size("q") == (common["dim"] if common else 0)).withColumn("q", F.col("q").cast("array<int>"))


def moved(rows: DataFrame, shift: int, modulus: int) -> DataFrame:
    """Labels of ids that ``shift`` divides move on by one."""
    return rows.withColumn("label", F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % modulus).otherwise(F.col("label")))


class Cells:
    """The pivots in the augmented space."""

    def __init__(self, pivots: np.ndarray, largest: float):
        p = pivots.astype(np.float64)
        self.dim, self.largest = p.shape[1], largest
        self.points = np.c_[p, np.sqrt(np.maximum(0, largest - (p**2).sum(1)))]
        self.norms = (self.points**2).sum(1)

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Of whole-number vectors from every pivot."""
        x = x.astype(np.float64)
        norms = (x**2).sum(1)
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0, self.largest - norms))
        far = norms + more**2
        return np.sqrt(np.maximum(0, far[:, None] + self.norms - 2 * (np.c_[x, more] @ self.points.T)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def assigned(rows: DataFrame, sent, anchors: bool, more: str) -> DataFrame:
    """``rows`` (label, q, ...) with the nearest pivot and the distance from it."""

    def run(batches):
        cells: Cells = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                d = cells.distances(matrix(part.column(1), cells.dim), anchors)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], [*part.schema.names, "cell", "dist"])

    return rows.mapInArrow(run, f"label long, q array<int>, {more}, cell int, dist double")


def in_pieces(batches, size: int):
    """Record batches of ``size`` rows, the last of fewer."""
    held, n = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, size - n)
            held, n, at = [*held, part], n + part.num_rows, at + part.num_rows
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_each_other(rows: DataFrame) -> DataFrame:
    """Rows of one label and cell next to each other, in tasks of about equal size."""
    return rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "label", "cell", "dist").sortWithinPartitions("label", "cell", "dist")


def flat(lists: pa.Array, kind) -> tuple[bytes, bytes]:
    """Values and lengths of a list column."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes(), np.diff(lists.offsets.to_numpy()).astype(np.int32).tobytes()


def blocks_of(candidates: DataFrame) -> DataFrame:
    """(block, FIELDS, own_labels, cells): cells has (cell, low, high) for each cell in the block."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for i, b in enumerate(in_pieces(batches, BLOCK)):
            label, cell, dist = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("label", "cell", "dist"))
            ids, n_ids = flat(b.column(b.schema.get_field_index("ids")), np.int64)
            order = np.argsort(cell, kind="stable")
            own, first = np.unique(cell[order], return_index=True)
            low, high = np.minimum.reduceat(dist[order], first), np.maximum.reduceat(dist[order], first)
            cells = [{"cell": int(c), "low": float(a), "high": float(z)} for c, a, z in zip(own, low, high)]
            vecs = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_pylist(
                [{"block": task << 32 | i, "n": b.num_rows, "vecs": vecs, "labels": label.astype(np.int64).tobytes(), "ids": ids, "n_ids": n_ids, "own_labels": np.unique(label).tolist(), "cells": cells}],
                schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("vecs", pa.binary()), ("labels", pa.binary()), ("ids", pa.binary()), ("n_ids", pa.binary()), ("own_labels", pa.list_(pa.int64())), ("cells", pa.list_(pa.struct([("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])))]),
            )

    return stored(near_each_other(candidates).mapInArrow(run, f"block long, {FIELDS}, own_labels array<long>, cells array<struct<cell:int,low:double,high:double>>"), "negatives-blocks")


def groups_of(anchors: DataFrame, sent) -> DataFrame:
    """(grp, FIELDS, own_labels, inner, outer, low, high): ids are the anchors' keys with, beside each, the scores of its positives.

    low, high: the smallest and largest distance from each pivot; inner, outer: the smallest and largest distance that a row within an interval can have.
    """

    def run(batches):
        from pyspark import TaskContext

        task, cells = TaskContext.get().partitionId(), sent.value
        for i, b in enumerate(in_pieces(batches, GROUP)):
            x = matrix(b.column(1), cells.dim)
            d = cells.distances(x, True)
            label, scores = b.column(0).to_numpy(), b.column(b.schema.get_field_index("scores"))
            values, counts = flat(scores, np.int64)
            ps, of = np.frombuffer(values, np.int64), np.repeat(np.arange(b.num_rows), np.frombuffer(counts, np.int32))
            far = (x.astype(np.float64) ** 2).sum(1)[of] + cells.largest
            lowest, highest = interval(ps)
            inner = np.sqrt(np.maximum(0, far - 2 * highest)).min() if len(ps) else 0.0
            outer = np.sqrt(np.maximum(0, far - 2 * lowest)).max() if len(ps) else 0.0
            keys = b.column(b.schema.get_field_index("key")).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_pylist(
                [{"grp": task << 32 | i, "n": b.num_rows, "vecs": x.astype(np.int32).tobytes(), "labels": label.astype(np.int64).tobytes(), "ids": keys.tobytes() + values, "n_ids": counts, "own_labels": np.unique(label).tolist(), "inner": float(inner), "outer": float(outer), "low": d.min(0).tolist(), "high": d.max(0).tolist()}],
                schema=pa.schema([("grp", pa.int64()), ("n", pa.int64()), ("vecs", pa.binary()), ("labels", pa.binary()), ("ids", pa.binary()), ("n_ids", pa.binary()), ("own_labels", pa.list_(pa.int64())), ("inner", pa.float64()), ("outer", pa.float64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]),
            )

    return stored(near_each_other(anchors).mapInArrow(run, f"grp long, {FIELDS}, own_labels array<long>, inner double, outer double, low array<double>, high array<double>"), "negatives-groups")


def interval(ps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest negative score that 50 ps <= 100 ns <= 95 ps allows."""
    return -(-ps // 2), ps - -(-ps // 20)


def pivot_bounds(groups: DataFrame) -> DataFrame:
    """(grp, own_labels, inner, outer, cell, low, high): one row per group and pivot."""
    each = groups.select("grp", "own_labels", "inner", "outer", F.posexplode(F.arrays_zip("low", "high")).alias("cell", "d"))
    return each.select("grp", "own_labels", "inner", "outer", "cell", F.col("d.low").alias("a_low"), F.col("d.high").alias("a_high"))


def reach_of_positives(bounds: DataFrame, candidates: DataFrame, wanted: int) -> DataFrame:
    """(grp, reach): how far the last of ``wanted`` rows of an anchor's label can be; null where there are fewer rows of a label."""
    nearest = candidates.select("label", "cell", "dist").withColumn("r", F.row_number().over(Window.partitionBy("label", "cell").orderBy("dist"))).where(F.col("r") <= wanted)
    labels = bounds.select("grp", F.explode("own_labels").alias("label"), "cell", "a_high")
    upper = labels.join(nearest, ["label", "cell"]).select("grp", "label", (F.col("a_high") + F.col("dist")).alias("upper"))
    last = upper.withColumn("r", F.row_number().over(Window.partitionBy("grp", "label").orderBy("upper"))).where(F.col("r") == wanted).select("grp", "label", "upper")
    every = bounds.select("grp", F.explode("own_labels").alias("label")).distinct().join(last, ["grp", "label"], "left")
    return every.groupBy("grp").agg(F.max(F.coalesce("upper", F.lit(float("inf")))).alias("reach"))


def served(bounds: DataFrame, blocks: DataFrame, shards: int, keep) -> DataFrame:
    """(grp, shard, block, nearest): the blocks that may serve each group, by the condition ``keep`` on the bounds of distance."""
    cells = blocks.select("block", F.col("own_labels").alias("b_labels"), F.explode("cells").alias("c")).select("block", "b_labels", F.col("c.cell").alias("cell"), F.col("c.low").alias("b_low"), F.col("c.high").alias("b_high"))
    met = bounds.join(cells, "cell")
    nearest = F.greatest(F.lit(0.0), F.col("a_low") - F.col("b_high"), F.col("b_low") - F.col("a_high")) * (1 - SLACK)
    farthest = (F.col("a_high") + F.col("b_high")) * (1 + SLACK)
    found = met.withColumns({"nearest": nearest, "farthest": farthest}).where(keep).groupBy("grp", "block").agg(F.min("nearest").alias("nearest"))
    return found.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))


def best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each slot with the highest score, ties to the smaller id."""
    order = np.lexsort((ids, -score, slot))
    slot, score, ids = slot[order], score[order], ids[order]
    first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
    rank = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
    return slot[rank < k], score[rank < k], ids[rank < k]


class Group:
    """A task's anchors, the best rows that each slot has met, and the score that a further row needs at least.

    Without intervals a slot is an anchor and rows of its own label count; with them a slot is an anchor and one of its intervals, and rows of
    other labels count.
    """

    def __init__(self, row: dict, cells: Cells, k: int, of_positives: bool):
        self.k, self.cells, self.of_positives = k, cells, of_positives
        self.x = np.frombuffer(row["vecs"], np.int32).reshape(row["n"], -1)
        self.labels = np.frombuffer(row["labels"], np.int64)
        ids = np.frombuffer(row["ids"], np.int64)
        self.keys, scores, counts = ids[: row["n"]], ids[row["n"] :], np.frombuffer(row["n_ids"], np.int32)
        self.norms = (self.x.astype(np.float64) ** 2).sum(1)
        self.pivots = cells.distances(self.x, True)
        none = np.iinfo(np.int64).min
        if of_positives:
            self.anchor, self.scores = np.arange(row["n"]), np.zeros(row["n"], np.int64)
            self.low, self.high = np.full(row["n"], none), np.full(row["n"], -none - 1)
        else:
            self.anchor, self.scores = np.repeat(np.arange(row["n"]), counts), scores
            self.low, self.high = interval(scores)
            self.low = self.low.copy()
        self.slot = self.score = self.ids = np.zeros(0, np.int64)

    def shells(self) -> tuple[np.ndarray, np.ndarray]:
        """For each slot the smallest and largest distance of a row that may still count."""
        far = self.norms[self.anchor] + self.cells.largest
        low, high = (np.maximum(0, far - 2.0 * s) for s in (self.high, self.low))
        return np.sqrt(low) * (1 - SLACK), np.sqrt(high) * (1 + SLACK)

    def meet(self, row: dict) -> None:
        y, labels = np.frombuffer(row["vecs"], np.int32).reshape(row["n"], -1), np.frombuffer(row["labels"], np.int64)
        ids, n_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["n_ids"], np.int32)
        first = np.r_[0, np.cumsum(n_ids)]
        cell, low, high = (np.array([c[f] for c in row["cells"]]) for f in ("cell", "low", "high"))
        d = self.pivots[:, cell]
        nearest = np.maximum(0, np.maximum(d - high, low - d)).min(1)[self.anchor]
        farthest = (d + high).max(1)[self.anchor]
        inner, outer = self.shells()
        slots = np.flatnonzero((nearest * (1 - SLACK) <= outer) & (farthest * (1 + SLACK) >= inner))
        exact = np.float64 if self.norms.max(initial=0) * (y.astype(np.float64) ** 2).sum(1).max() < 2.0**104 else np.int64
        for part in np.array_split(slots, -(-len(slots) // 1024) or 1):
            if not len(part):
                continue
            own, of = np.unique(self.anchor[part], return_inverse=True)
            products = (self.x[own].astype(exact) @ y.T.astype(exact))[of]
            same = self.labels[own][of][:, None] == labels
            lowest = np.maximum(self.low[part], np.iinfo(np.int64).min + 1)[:, None]
            fits = (same if self.of_positives else ~same) & (products >= lowest) & (products <= self.high[part][:, None])
            if len(labels) > self.k:
                least = np.where(fits, products, -np.inf if exact is np.float64 else np.iinfo(np.int64).min)
                fits &= products >= np.partition(least, len(labels) - self.k, axis=1)[:, len(labels) - self.k][:, None]
            at, col = np.nonzero(fits)
            if not len(at):
                continue
            many = n_ids[col]
            each = np.repeat(first[col], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            slot, score = np.repeat(part[at], many), np.repeat(products[at, col].astype(np.int64), many)
            self.slot, self.score, self.ids = best(np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.ids, ids[each]], self.k)
        count = np.bincount(self.slot, minlength=len(self.anchor))
        full = np.flatnonzero(count >= self.k)
        self.low[full] = self.score[np.cumsum(count)[full] - 1]  # a further row must tie with the last at least

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.keys[self.anchor[self.slot]], self.scores[self.slot], self.score, self.ids)], ["key", "ps", "score", "id"])


def local_join(groups: DataFrame, blocks: DataFrame, pairs: DataFrame, sent, k: int, of_positives: bool) -> DataFrame:
    """(key, ps, score, id): the exact join of each group with the blocks that may serve it, as lists of each shard."""
    pairs = stored(pairs, "negatives-pairs")
    nothing = F.lit(None).cast("array<struct<cell:int,low:double,high:double>>")
    fields = ["grp", "shard", "kind", "nearest", *(f.split()[0] for f in FIELDS.split(", ")), "cells"]
    asked = groups.join(pairs.select("grp", "shard").distinct(), "grp").withColumns({"kind": F.lit(0), "nearest": F.lit(0.0), "cells": nothing}).select(*fields)
    sent_out = blocks.join(pairs, "block").withColumn("kind", F.lit(1)).select(*fields)
    dealt = asked.unionByName(sent_out).repartition(shuffle_partitions(groups.sparkSession), "grp", "shard").sortWithinPartitions("grp", "shard", "kind", "nearest")

    def run(batches):
        group, cells = None, sent.value
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(j)[i].as_py() for j, name in enumerate(fields)}
                if row["kind"]:
                    group.meet(row)
                else:
                    if group:
                        yield group.found()
                    group = Group(row, cells, k, of_positives)
        if group:
            yield group.found()

    return dealt.mapInArrow(run, "key long, ps long, score long, id long")


def mine(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    anchor_every: int = 50, positives: int = 5, negatives: int = 3, scale: int = 256, shift: int = 7, modulus: int = 10, pivots: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the rows whose id ``anchor_every`` divides."""
    spark = vectors.sparkSession
    rows = stored(moved(whole(vectors, id_col, vec_col, label_col, scale), shift, modulus).distinct(), "negatives-rows")
    asked = rows.where(F.col("vec_id") % anchor_every == 0)
    wanted = positives + (asked.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1)  # rows of an anchor's id are in its list
    first = F.row_number().over(Window.partitionBy("label", "q").orderBy("vec_id"))
    few = rows.withColumn("r", first).where(F.col("r") <= max(wanted, negatives))
    distinct = stored(few.groupBy("label", "q").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "negatives-distinct")
    chosen = distinct.select("q").distinct().orderBy(F.xxhash64("q")).limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], RESULT)
    size = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = distinct.agg(F.max(size)).first()[0]
    sent = spark.sparkContext.broadcast(Cells(np.array([r["q"] for r in chosen], np.int32), largest * (1 + SLACK)))  # ``pivots`` vectors

    candidates = assigned(distinct, sent, False, "ids array<long>")
    blocks = blocks_of(candidates)
    n_blocks = blocks.count()
    anchors = stored(asked.groupBy("label", "q").agg(F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()), "negatives-anchors")
    named = stored(hot_join(asked, anchors, ["label", "q"], "n").select("vec_id", "key"), "negatives-named")

    def shards(groups: DataFrame) -> int:
        """So many that all tasks have work and none has more than BLOCKS blocks a group."""
        return max(1, -(-shuffle_partitions(spark) // max(1, groups.count())), -(-n_blocks // BLOCKS))

    plain = anchors.select("label", "q", "key", F.array().cast("array<long>").alias("scores"))
    groups = groups_of(assigned(plain, sent, True, "key long, scores array<long>"), sent)
    bounds = pivot_bounds(groups)
    reach = reach_of_positives(bounds, candidates, wanted)
    pairs = served(bounds.join(reach, "grp"), blocks, shards(groups), F.arrays_overlap("own_labels", "b_labels") & (F.col("nearest") <= F.col("reach") * (1 + SLACK)))
    met = local_join(groups, blocks, pairs, sent, wanted, True)
    top = met.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).where(F.col("r") <= wanted)
    tops = top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "score", "id"))).alias("top")).join(anchors.select("key", "n"), "key")
    own = hot_join(named, tops, ["key"], "n").select(F.col("vec_id").alias("anchor_id"), "key", F.slice(F.filter("top", lambda t: t["id"] != F.col("vec_id")), 1, positives).alias("top"))
    found = stored(own.select("anchor_id", "key", F.explode("top").alias("t")).select("anchor_id", "key", F.col("t.id").alias("positive_id"), F.col("t.score").alias("ps")), "negatives-positives")

    scores = found.where("ps >= 0").select("key", "ps").distinct().groupBy("key").agg(F.array_sort(F.collect_list("ps")).alias("scores"))
    shelled = groups_of(assigned(anchors.select("label", "q", "key").join(scores, "key").select("label", "q", "key", "scores"), sent, True, "key long, scores array<long>"), sent)
    other = (F.size(F.array_union("own_labels", "b_labels")) > 1) & (F.col("nearest") <= F.col("outer") * (1 + SLACK)) & (F.col("farthest") >= F.col("inner") * (1 - SLACK))
    met = local_join(shelled, blocks, served(pivot_bounds(shelled), blocks, shards(shelled), other), sent, negatives, False)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("key", "ps").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= negatives)
    lists = ranked.groupBy("key", "ps").agg(F.collect_list(F.struct("rank", F.col("id").alias("negative_id"), "score")).alias("found")).join(anchors.select("key", "n"), "key")
    joined = hot_join(found, lists, ["key", "ps"], "n").select("anchor_id", "positive_id", "ps", F.explode("found").alias("f"))
    return joined.select("anchor_id", "positive_id", "f.rank", "f.negative_id", F.col("ps").alias("positive_score"), F.col("f.score").alias("negative_score"))
