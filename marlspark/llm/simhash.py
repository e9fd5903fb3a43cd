"""Near-duplicates by SimHash: every pair of fingerprints within the radius is found by tiled exact comparison.

Fingerprints are grouped by the population counts of their four 16-bit words.  Two fingerprints that differ in r bits have
population counts that differ by r at most in all, so a tile is compared only with tiles whose counts differ by no more
than the radius; every other pair of tiles is skipped without loss.  A pair of tiles is compared at once with numpy
exclusive-or and bit counts.  It yields links that span its components (at most as many as it has fingerprints, so
a large group of near copies never yields all its pairs).  Components follow by alternating star contraction.

Only distinct fingerprints are compared; a tile has at most ``tile`` of them, larger groups are split by a second hash.

Defined results: null and empty texts have fingerprint 0 and are linked like any other; fewer than three words are hashed as
one sequence; rows with a null doc_id get their component's smallest doc_id, or null if it has none; repeated rows get equal
results; an empty table gives an empty table; very long texts are read whole; other columns are not read.
"""

from __future__ import annotations

from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, batches_by_bytes, hot_join, prepared, stored, text_bytes


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned integer: a bit is 1 if set in over half the shingles' hashes."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = len(words) - shingle + 1
    parts = map(joined.__getitem__, map(slice, start[:n].tolist(), end[shingle - 1 :].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for b in batches_by_bytes(batches, 1):
            fp = np.array([fingerprint(t, shingle) for t in text_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def spanning_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between left[i] and right[j] that join whatever is linked within ``radius``, at most len(left) + len(right)."""
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
    i, j = np.nonzero(near)
    if len(i) <= len(left) + len(right):
        return left[i], right[j]
    # many links: grow trees breadth first, each fingerprint is reached once
    seen_l, seen_r = np.zeros(len(left), bool), np.zeros(len(right), bool)
    a, b = [], []
    for root in range(len(left)):
        if seen_l[root] or not near[root].any():
            continue
        seen_l[root] = True
        front = np.array([root])
        while len(front):
            hit = near[front]
            new = np.flatnonzero(hit.any(0) & ~seen_r)
            seen_r[new] = True
            a.append(left[front[hit[:, new].argmax(0)]])
            b.append(right[new])
            back = near[:, new]
            more = np.flatnonzero(back.any(1) & ~seen_l)
            seen_l[more] = True
            a.append(left[more])
            b.append(right[new[back[more].argmax(1)]] if len(new) else right[:0])
            front = more
    return np.concatenate(a), np.concatenate(b)


#: Tiles of a cell that one key of the join has.
STRIP = 8


def _tile_pairs(fps: DataFrame, radius: int, tile: int) -> DataFrame:
    counts = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(0xFFFF)).cast("int") for s in (0, 16, 32, 48)]
    cells = fps.select("fp", F.array(*counts).alias("cell"))
    size = F.broadcast(cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))  # at most 17 ** 4 cells
    tiles = stored(
        cells.join(size, "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list("fp").alias("fps")),
        "simhash-tiles",
    )
    reach = range(-radius, radius + 1)
    steps = [d for d in product(reach, repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    step = F.explode(F.array(*(F.array(*map(F.lit, d)) for d in steps)))
    left = tiles.select("fps", F.col("cell").alias("of"), F.col("part").alias("from"), step.alias("d"))
    left = left.select("fps", "from", "of", F.zip_with("of", "d", lambda x, y: x + y).alias("cell"))
    # the tiles of a cell that has many are met STRIP at a time, so that no key has all pairs of a large cell
    strips = F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / STRIP).cast("int"))
    left = left.join(size, "cell").select("fps", "from", "of", "cell", F.explode(strips).alias("strip"))
    right = tiles.select("cell", F.col("part").alias("to"), F.col("fps").alias("other"), F.floor(F.col("part") / STRIP).cast("int").alias("strip"))
    return left.join(right, ["cell", "strip"]).where("of <> cell or `from` <= `to`").select("fps", "other")


def links(fps: DataFrame, radius: int = 3, tile: int = 2048) -> DataFrame:
    """(u, v), u > v: links among distinct fingerprints ``fp`` that join all that differ in ``radius`` bits or fewer."""

    def run(batches):
        for b in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(b.column(0), b.column(1)):
                x, y = (np.asarray(z.values).view(np.uint64) for z in (x, y))
                x, y = (z.view(np.int64) for z in spanning_links(x, y, radius))
                us.append(np.maximum(x, y)[x != y])
                vs.append(np.minimum(x, y)[x != y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return _tile_pairs(fps, radius, tile).mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node u that has links with its component's smallest node v, by alternating star contraction.

    Each round is written to the workspace.  The minimum of a node's neighbours is aggregated before it is joined back, so
    a node with very many neighbours is neither collected nor sorted in one task.
    """
    edges, state = stored(edges, "star"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.where("u <> v"), "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = stored(small.where("u <> v").distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, tile: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (its smallest doc_id)."""
    prints = stored(fingerprints(prepared(docs, id_col, text_col), shingle), "simhash-prints")
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-groups")
    roots = components(links(groups.select("fp"), radius, tile))
    of = groups.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("v", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(of.join(ids, "root").select("fp", "n", "component_id"), "simhash-components")
    return hot_join(prints, of, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
