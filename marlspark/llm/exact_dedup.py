"""Exact deduplication by an extendible-hash index on shared files.

1. One scan gives each text's 64-bit hash, SHA-256 and size, written to the workspace.
2. The directory starts with one bucket.  While a bucket's distinct texts are larger than its capacity it is split by
   the next bit of the hash, and the directory doubles when the bucket was as deep as the directory.
3. Owner tasks each take buckets next to each other, that is, a range of hashes, of about equal bytes.  The rows of a bucket arrive ordered by hash; texts with
   one hash form a chain, and a text joins a link of the chain only when the bytes are equal.  The chains are
   written as the index.
4. Rows look up their link by hash and SHA-256.

Copies are folded within each batch before they are shuffled, so a text that holds a third of all rows reaches its
owner as one entry a batch, and rows of groups with a noticeable share of all rows look up their link where they are.  The counts that shape the directory
come as one row a hash prefix: four prefixes a bucket, at most 2**MOST_DEPTH; where that many buckets of ``capacity`` bytes don't hold the distinct texts, the
capacity grows instead.  A bucket is never held as a whole, so its size only says how evenly owners are loaded.

Defined results: null counts as the empty text; a null doc_id counts as smaller than any other, and keep_id is null
only where a whole group has null ids; rows that repeat both doc_id and text are all marked kept if their id is kept; an empty
table gives an empty table; very long texts are compared whole; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, hot_join, prepared, shuffle_partitions, stored, text_bytes

ENTRY = pa.schema([("owner", pa.int32()), ("bucket", pa.int64()), ("h", pa.int64()), ("sha", pa.binary()), ("n_bytes", pa.int64()), ("n", pa.int64()), ("keep_id", pa.int64()), ("text", pa.binary())])
LINK = pa.schema([("bucket", pa.int64()), ("h", pa.int64()), ("link", pa.int32()), ("sha", pa.binary()), ("n_bytes", pa.int64()), ("group_size", pa.int64()), ("keep_id", pa.int64())])


def normalised(column: pa.Array) -> list[bytes]:
    """Texts with A-Z lower-cased and nothing else changed."""
    return text_bytes(pc.ascii_lower(column.fill_null("")))


#: Bits of the hash that the directory looks at, at most.
MOST_DEPTH = 22


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches_by_bytes(batches, 1):
            texts = normalised(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([signed(xxhash.xxh64_intdigest(t)) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())],
                ["doc_id", "h", "sha", "n_bytes"],
            )

    return docs.mapInArrow(run, "doc_id long, h long, sha binary, n_bytes long")


class Directory:
    """An extendible-hash directory: ``slots[prefix]`` is the bucket of a hash that begins with these ``depth`` bits."""

    def __init__(self, sizes: dict[int, int], max_depth: int, capacity: int):
        """sizes: bytes by prefix of ``max_depth`` bits; places: the share of all bytes before each bucket."""
        total = np.zeros((1 << max_depth) + 1, np.int64)
        for prefix, size in sizes.items():
            total[prefix + 1] = size
        total = np.cumsum(total)
        size_of = lambda prefix, depth: total[(prefix + 1) << (max_depth - depth)] - total[prefix << (max_depth - depth)]
        self.depth, self.slots, self.local = 0, np.zeros(1, np.int64), [0]
        work = [(0, 0)]
        while work:
            prefix, local = work.pop()
            if local == max_depth or size_of(prefix, local) <= capacity:
                continue
            if local == self.depth:  # the directory doubles: each slot becomes two with the same bucket
                self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
            low, span = (prefix << 1) << (self.depth - local - 1), 1 << (self.depth - local - 1)
            old = self.slots[low]
            self.local[old] = local + 1
            self.slots[low + span : low + 2 * span] = len(self.local)
            self.local.append(local + 1)
            work += [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
        first = np.zeros(len(self.local), np.int64)
        first[self.slots[::-1]] = np.arange(len(self.slots))[::-1]  # each bucket's first slot
        self.places = total[first << (max_depth - self.depth)] / max(1, total[-1])

    def bucket(self, h: np.ndarray) -> np.ndarray:
        """h: signed 64-bit hashes."""
        if not self.depth:
            return np.zeros(len(h), np.int64)
        return self.slots[(h.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


def directory(prints: DataFrame, capacity: int) -> Directory:
    each = prints.groupBy("h").agg((F.max("n_bytes") + 64).alias("size"))
    total = each.agg(F.sum("size")).first()[0] or 0
    capacity = max(capacity, total >> (MOST_DEPTH - 2))
    max_depth = min(MOST_DEPTH, max(1, (total // capacity).bit_length() + 2))
    got = each.groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("prefix")).agg(F.sum("size").alias("size")).toArrow()
    return Directory(dict(zip(got["prefix"].to_pylist(), got["size"].to_pylist())), max_depth, capacity)


def entries(docs: DataFrame, index: Directory, owners: int) -> DataFrame:
    """One row per distinct text of a batch, with its bucket and the owner of that."""
    sent = docs.sparkSession.sparkContext.broadcast(index)  # at most 2**MOST_DEPTH slots of 8 bytes

    def run(batches):
        index = sent.value
        for b in batches_by_bytes(batches, 1):
            chains: dict[int, list[list]] = {}
            for doc, text in zip(b.column(0).to_pylist(), normalised(b.column(1))):
                chain = chains.setdefault(signed(xxhash.xxh64_intdigest(text)), [])
                for link in chain:
                    if link[0] == text:
                        link[1], link[2] = link[1] + 1, larger(link[2], doc)
                        break
                else:
                    chain.append([text, 1, doc])
            rows = [(h, hashlib.sha256(t).digest(), len(t), n, keep, t) for h, chain in chains.items() for t, n, keep in chain]
            h, *rest = zip(*rows)
            h = np.array(h, np.int64)
            bucket = index.bucket(h)
            owner = np.minimum(index.places[bucket] * owners, owners - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(bucket), pa.array(h), *(pa.array(c, f.type) for c, f in zip(rest, list(ENTRY)[3:]))], schema=ENTRY)

    return docs.mapInArrow(run, "owner int, bucket long, h long, sha binary, n_bytes long, n long, keep_id long, text binary")


def chained(rows: DataFrame) -> DataFrame:
    """The owners' work: rows come in order of bucket and hash, so only one chain is held at a time."""

    def run(batches):
        key, chain, out = None, [], []

        def flush():
            out.extend((*key, i, link[1], len(link[0]), link[2], link[3]) for i, link in enumerate(chain))

        for b in batches_by_bytes(batches, 6):
            for bucket, h, sha, _, n, keep, text in zip(*(c.to_pylist() for c in b.columns)):
                if (bucket, h) != key:
                    if key:
                        flush()
                    key, chain = (bucket, h), []
                for link in chain:
                    if link[0] == text:
                        link[2], link[3] = link[2] + n, larger(link[3], keep)
                        break
                else:
                    chain.append([text, sha, n, keep])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), LINK)], schema=LINK)
                out.clear()
        if key:
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), LINK)], schema=LINK)

    return rows.mapInArrow(run, "bucket long, h long, link int, sha binary, n_bytes long, group_size long, keep_id long")


def build_index(docs: DataFrame, prints: DataFrame, capacity: int = 4 << 20) -> DataFrame:
    """The index as a table in the workspace: bucket, hash, place in the chain, SHA-256, size, group_size, keep_id."""
    owners = shuffle_partitions(docs.sparkSession)
    owned = entries(docs, directory(prints, capacity), owners).repartitionById(owners, "owner").sortWithinPartitions("bucket", "h").drop("owner")
    return stored(chained(owned), "exact-index")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = prepared(docs, id_col, text_col)
    prints = stored(fingerprints(docs), "exact-prints")
    index = build_index(docs, prints, capacity).select("h", "sha", "group_size", "keep_id")
    return hot_join(prints, index, ["h", "sha"], "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
