"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order of nearness.  The index has one row per block of vectors, with an inverted file: for each pivot the
block's vectors that have it among their nearest ``prefix`` pivots, and its rank there.  A query goes through the files of its own
nearest pivots and adds up, for each vector met, the footrule distance of the two prefixes (a pivot that one of them lacks counts as rank ``prefix``).
With 1024 pivots and prefixes of 48 that is about two postings a vector (prefix squared over pivots), where a distance takes as many steps as a vector has components.
The share ``rerank`` of a block with the smallest footrule distances, never fewer than ``least``, is measured exactly in double
precision.  With rerank=1 every vector of a block is measured, so the result is exact.

Equal vectors are indexed once, with their k + 1 smallest ids, which is all that a list of k can show of them.  Pivots are ``pivots``
distinct vectors with the smallest hashes, a bounded sample; every vector is indexed.  Blocks of queries meet blocks of the index in lanes: a block
of queries is sent once a lane, and a task merges what its blocks yield, so that it passes on k rows a query (more only where it had MOST_HELD rows in hand).

Defined results: vectors that are null, zero, of another length than most of ``vectors`` (of two lengths equally frequent the larger counts; queries of another length than that take no part either), or that hold null or non-finite components take no part, nor do
rows with a null id; repeated rows count once; a query's own id is never in its list; with fewer than k candidates all are returned; ties go to the
smaller id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored


def usable(vectors: DataFrame, id_col: str, vec_col: str, length: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, vec) of the rows that take part, and the length of their vectors: the given one, or else the commonest."""
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec")).where("vec_id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(finite & F.exists("vec", lambda x: x != 0))
    if length is None:
        common = v.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        length = common["dim"] if common else 0
    return v.where(F.size("vec") == length), length


def folded(vectors: DataFrame, k: int) -> DataFrame:
    """(vec, ids): distinct vectors with the k + 1 smallest ids of each."""
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = vectors.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def smallest_hashes(vectors: DataFrame, n: int) -> list:
    """The ``n`` rows with the smallest hashes of vec; the driver gets at most about four times as many, however many partitions there are."""
    marked = vectors.withColumn("h", F.xxhash64("vec"))
    total = vectors.count()
    if total > 4 * n:
        few = marked.where(F.col("h") < -(1 << 63) + (1 << 64) * 2 * n // total)
        rows = few.orderBy("h").limit(n).collect()
        if len(rows) == n:
            return rows
    return marked.orderBy("h").limit(n).collect()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, nearest first; ties go to the earlier pivot."""
    d = (pivots.astype(np.float64) ** 2).sum(1) - 2 * x.astype(np.float64) @ pivots.T.astype(np.float64)
    return np.argsort(d, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def build_index(distinct: DataFrame, pivots: np.ndarray, prefix: int, block: int) -> DataFrame:
    """(block, n, vecs, ids, n_ids, file_at, file_vec, file_rank): blocks of vectors, each with its inverted file."""

    def run(batches):
        from pyspark import TaskContext

        held, ids, n, serial = [], [], 0, 0
        task = TaskContext.get().partitionId()

        def emit():
            x = np.concatenate(held)
            perm = permutations(x, pivots, prefix)
            order = np.argsort(perm.reshape(-1), kind="stable")
            at = np.searchsorted(perm.reshape(-1)[order], np.arange(len(pivots) + 1))
            flat = np.array([i for each in ids for i in each], np.int64)
            count = np.array([len(each) for each in ids], np.int32)
            parts = [x, flat, count, at.astype(np.int64), (order // prefix).astype(np.int32), (order % prefix).astype(np.int16)]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | serial]), pa.array([len(x)]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["block", "n", "vecs", "ids", "n_ids", "file_at", "file_vec", "file_rank"])

        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                held.append(_matrix(part.column(0)))
                ids += part.column(1).to_pylist()
                n += part.num_rows
                if n >= block:
                    yield emit()
                    held, ids, n, serial = [], [], 0, serial + 1
        if n:
            yield emit()

    return stored(distinct.mapInArrow(run, "block long, n long, vecs binary, ids binary, n_ids binary, file_at binary, file_vec binary, file_rank binary"), "permutation-index")


def query_blocks(queries: DataFrame, size: int) -> DataFrame:
    """(q_ids, q_vecs): blocks of queries."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part.column(0), np.int64).tobytes()], pa.binary()), pa.array([_matrix(part.column(1)).tobytes()], pa.binary())], ["q_ids", "q_vecs"])

    return queries.select("vec_id", "vec").mapInArrow(run, "q_ids binary, q_vecs binary")


def footrule_candidates(query: np.ndarray, at: np.ndarray, vec: np.ndarray, rank: np.ndarray, n: int, prefix: int, width: int) -> np.ndarray:
    """The ``width`` vectors of a block nearest to the query's prefix by footrule, ties to the earlier; those that share no pivot come last."""
    if width >= n:
        return np.arange(n)
    # what sharing a pivot takes off the distance of two prefixes without a common pivot
    stretches = list(map(slice, at[query].tolist(), at[query + 1].tolist()))
    mine = np.repeat(np.arange(prefix), at[query + 1] - at[query])
    theirs = np.concatenate([rank[w] for w in stretches]).astype(np.int64)
    gain = np.bincount(np.concatenate([vec[w] for w in stretches]), 2 * (prefix - np.maximum(mine, theirs)), n)
    return np.argpartition(-gain, width)[:width]


#: Rows of lists that a task holds before it passes them on.
MOST_HELD = 1 << 21


def firsts(qid: np.ndarray, own: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, distance) the k nearest of each query, ties to the smaller id; a row that recurs counts once."""
    order = np.lexsort((own, d, qid))
    qid, own, d = qid[order], own[order], d[order]
    again = np.r_[False, (qid[1:] == qid[:-1]) & (own[1:] == own[:-1]) & (d[1:] == d[:-1])]
    qid, own, d = qid[~again], own[~again], d[~again]
    first = np.r_[True, qid[1:] != qid[:-1]] if len(qid) else np.zeros(0, bool)
    rank = np.arange(len(qid)) - np.maximum.accumulate(np.where(first, np.arange(len(qid)), 0))
    return qid[rank < k], own[rank < k], d[rank < k]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    pivots: int = 1024, prefix: int = 48, rerank: float = 0.1, least: int = 256, block: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of ``vectors`` by Euclidean distance; both tables have the same columns."""
    spark = vectors.sparkSession
    plain, length = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col, length)[0].distinct()
    distinct = stored(folded(plain, k), "distinct-vectors")
    rows = smallest_hashes(distinct.select("vec"), pivots)
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    number = np.float32 if dict(distinct.dtypes)["vec"] == "array<float>" else np.float64
    chosen = np.array([r["vec"] for r in rows], number)
    prefix = min(prefix, len(chosen))
    lanes = shuffle_partitions(spark)
    index = build_index(distinct, chosen, prefix, block).withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
    blocks = query_blocks(asked, 2048).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("lane", F.col("lane").cast("long"))
    # by merging: the planner counts a block of queries once, not once a lane, and would collect and broadcast what it takes for a few MB
    met = index.join(blocks.hint("merge"), "lane").select("n", "vecs", "ids", "n_ids", "file_at", "file_vec", "file_rank", "q_ids", "q_vecs")
    dim = chosen.shape[1]

    def run(batches):
        held: dict[bytes, tuple] = {}  # the best of each block of queries among the blocks met so far

        def passed_on():
            for qid, own, d in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (qid, own, d)], ["query_id", "vec_id", "score"])
            held.clear()

        for b in batches:
            for n, *data in zip(*(c.to_pylist() for c in b.columns)):
                kinds = (number, np.int64, np.int32, np.int64, np.int32, np.int16, np.int64, number)
                x, ids, n_ids, at, vec, rank, q_ids, q = (np.frombuffer(d, t) for d, t in zip(data, kinds))
                x, q = x.reshape(-1, dim).astype(np.float64), q.reshape(-1, dim)
                first = np.concatenate([[0], np.cumsum(n_ids)])
                width = min(n, max(least, int(np.ceil(rerank * n))))
                out = [held.pop(data[6])] if data[6] in held else []
                for qid, y, perm in zip(q_ids.tolist(), q.astype(np.float64), permutations(q, chosen, prefix)):
                    near = footrule_candidates(perm, at, vec, rank, n, prefix, width)
                    d = np.sqrt(((x[near] - y) ** 2).sum(1))
                    if len(near) > k + 1:  # ties at the cut stay in
                        cut = np.partition(d, k)[k]
                        near, d = near[d <= cut], d[d <= cut]
                    of = np.repeat(np.arange(len(near)), n_ids[near])
                    own = np.concatenate([ids[first[i] : first[i + 1]] for i in near])
                    d, own = d[of][own != qid], own[own != qid]
                    best = np.lexsort((own, d))[:k]
                    out.append((np.full(len(best), qid), own[best], d[best]))
                held[data[6]] = firsts(*map(np.concatenate, zip(*out)), k)
                if sum(len(h[0]) for h in held.values()) > MOST_HELD:
                    yield from passed_on()
        yield from passed_on()

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
