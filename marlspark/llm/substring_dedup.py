"""Removal of repeated passages: every word that lies in a window of words which also starts earlier is dropped.

1. Every task counts its windows in count-min sketches.  A sketch is two rows of 2**log2_cells counters that stop at two, since only
   "at least two" is asked; a task sends the cells it touched, coded by their distances (about a byte a cell).  The
   sketches are merged by ranges of cells.
2. A second pass takes up only windows whose counters all say "at least two".  The sketch never counts too little, so no repeated
   window is lost.  Within a chunk of documents all but the first of equal windows are settled at once, so a passage that very many
   documents share reaches the shuffle once a chunk.  The rest is grouped by 96 bits of hash, 64 and 32 from two hashes of each word that know nothing of each other,
   into ranges of hashes.  Ranges grow in number with the input, so that a task holds about ``RANGE`` windows at most, whatever the size of the input.
3. Documents meet the places of their repeated windows and are put together without the covered words.

The merged sketch that each task reads has four cells a window, but 2**log2_cells at most in each of its two rows (64 MB in all at 28).  Over more windows
than that it sorts out fewer of them, which costs shuffle but never changes the result.

Order: smaller doc_id first (null before all), then the hash of the text, then the place in the text.  Defined results: a null text has
no words; texts shorter than a window lose nothing; rows that repeat doc_id and text are one document and get equal results; an
empty table gives an empty table; very long texts are read whole, several chunks' worth if need be; other columns are not read.
"""

from __future__ import annotations

import struct
from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, prepared, shuffle_partitions, stored, text_bytes

#: Odd multipliers of the two window hashes (any odd numbers do).
A1, A2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
NO_ID = -(1 << 63)
#: Words that a task counts, or looks up in the sketch, at a time.
COUNTED, LOOKED_UP = 1 << 20, 1 << 19
#: Windows of a range, and bytes that a word takes up at least on average, from which the number of windows is guessed.
RANGE, WORD_BYTES = 1 << 22, 5


class WordHashes(dict):
    """Two 64-bit hashes of words, kept while there are not too many; a word's number says where its hashes stand."""

    def __init__(self):
        super().__init__()
        self.both = array("Q")

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(word)
        self.both.extend((h >> 64, h & 0xFFFFFFFFFFFFFFFF))
        n = self[word] = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        """A row of two hashes a word."""
        if len(self) > 500_000:
            self.clear()
            self.both = array("Q")
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.both, np.uint64).reshape(-1, 2)[at]


class Windows:
    """Two hashes of all windows of ``size`` words in arrays of word hashes laid end to end."""

    def __init__(self, size: int):
        self.size, self.powers = size, {}

    def _power(self, a: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if a not in self.powers or len(self.powers[a][0]) < n:
            m = max(n, 1 << 16)
            up, down = np.full(m, a, np.uint64), np.full(m, pow(a, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers[a] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, down = self.powers[a]
        return up[:n], down[:n]

    def _rolled(self, words: np.ndarray, a: int) -> np.ndarray:
        up, down = self._power(a, len(words))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
        return (total[self.size :] - total[: -self.size]) * down[: len(words) - self.size + 1]

    def hashes(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(h1, h2, index of the document, place in it) of all windows."""
        lens = np.array([len(d) for d in docs], np.int64)
        n = np.maximum(lens - self.size + 1, 0)
        if not n.sum():
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        words = np.concatenate(docs)
        doc = np.repeat(np.arange(len(docs)), n)
        place = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        at = place + np.repeat(np.concatenate([[0], np.cumsum(lens)[:-1]]), n)
        return self._rolled(words[:, 0], A1)[at], self._rolled(words[:, 1], A2)[at], doc, place


def _pieces(batches, size: int, most: int):
    """Chunks of about ``most`` words, as ((doc_id, text hash), first place, word hashes); a longer text is taken in overlapping parts."""
    hashes, chunk, held = WordHashes(), [], 0
    for b in batches_by_bytes(batches, 1):
        for doc, text, th in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist()):
            words = text.split()
            if len(words) < size:
                continue
            key, hashed = (NO_ID if doc is None else doc, th), hashes.of(words)
            for i in range(0, len(hashed) - size + 1, most):
                part = hashed[i : i + most + size - 1]
                chunk.append((key, i, part))
                held += len(part)
                if held >= most:
                    yield chunk
                    chunk, held = [], 0
    if chunk:
        yield chunk


def coded(cells: np.ndarray) -> bytes:
    """Ascending numbers as bytes of their distances; 255 says: add 255 and go on."""
    d = np.diff(cells, prepend=0)
    many = d // 255
    out = np.full(len(d) + int(many.sum()), 255, np.uint8)
    out[np.cumsum(many + 1) - 1] = d % 255
    return out.tobytes()


def decoded(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return np.cumsum(b, dtype=np.int64)[b != 255]


def _cells(h: np.ndarray, log2_cells: int) -> np.ndarray:
    return (h >> np.uint64(64 - log2_cells)).astype(np.int64)


def merged_sketch(docs: DataFrame, size: int, log2_cells: int) -> np.ndarray:
    """The bits "counted at least twice" of both rows, as packed bytes: of a fixed size whatever the input."""
    log2_shards = min(5, log2_cells)
    span = 1 << (log2_cells - log2_shards)

    def count(batches):
        windows = Windows(size)
        for chunk in _pieces(batches, size, COUNTED):
            h1, h2, _, _ = windows.hashes([p[2] for p in chunk])
            rows = []
            for row, h in enumerate((h1, h2)):
                cells = np.sort(_cells(h, log2_cells))
                new = np.concatenate([[True], cells[1:] != cells[:-1]])
                again = np.concatenate([~new[1:], [False]])[new]
                cells = cells[new]
                bounds = np.searchsorted(cells, np.arange(0, (1 << log2_cells) + 1, span))
                for s in range(1 << log2_shards):
                    part, twice = cells[bounds[s] : bounds[s + 1]] - s * span, again[bounds[s] : bounds[s + 1]]
                    if len(part):
                        rows.append((row << log2_shards | s, coded(part[~twice]), coded(part[twice])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "once", "twice"])

    def merge(batches):
        shard, one, two = None, None, None

        def result():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(two).tobytes()], pa.binary())], ["shard", "bits"])

        for b in batches:
            for s, once, twice in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard:
                    if shard is not None:
                        yield result()
                    shard, one, two = s, np.zeros(span, bool), np.zeros(span, bool)
                cells = decoded(once)
                two[cells[one[cells]]] = True
                one[cells] = True
                cells = decoded(twice)
                one[cells] = two[cells] = True
        if shard is not None:
            yield result()

    parts = docs.mapInArrow(count, "shard int, once binary, twice binary").repartition(2 << log2_shards, "shard").sortWithinPartitions("shard")
    out = np.zeros((2 << log2_shards, (span + 7) // 8), np.uint8)
    for batch in parts.mapInArrow(merge, "shard int, bits binary").toArrow().to_batches():
        for s, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
            out[s] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.reshape(2, -1)


def _packed(keys, doc: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Arrays by document; ``doc`` ascends."""
    which, counts = np.unique(doc, return_counts=True)
    table = keys[which] if isinstance(keys, np.ndarray) else np.array([keys[i] for i in which], np.int64).reshape(-1, 2)
    return struct.pack("<QQ", len(which), len(doc)) + b"".join([table.tobytes(), counts.astype("<u4").tobytes(), *(a.tobytes() for a in arrays)])


def _unpacked(data: bytes, *kinds: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    docs, n = struct.unpack_from("<QQ", data)
    at = 16
    table = np.frombuffer(data, np.int64, 2 * docs, at).reshape(-1, 2)
    at += 16 * docs
    counts = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    out = []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += out[-1].nbytes
    return table, counts, out


#: Documents are dealt to ranges by simple arithmetic, which Python and Spark do alike.
PRIME, FACTOR = (1 << 31) - 1, 48271


def _dealt(table: np.ndarray, ranges: int) -> np.ndarray:
    return (table[:, 0] % PRIME * FACTOR + table[:, 1] % PRIME) % ranges


def _by_range(table: np.ndarray, doc: np.ndarray, place: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Windows to remove as rows (range, data), a row for each range of documents."""
    of = _dealt(table, ranges)[doc]
    order = np.lexsort((place, doc, of))
    doc, place, of = doc[order], place[order], of[order]
    bounds = np.searchsorted(of, np.arange(ranges + 1))
    rows = [(int(r), _packed(table, doc[i:j], place[i:j])) for r, i, j in zip(range(ranges), bounds, bounds[1:]) if i < j]
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["range", "data"])


def repeated_windows(docs: DataFrame, size: int, log2_cells: int, parts: int) -> DataFrame:
    """(range, data): the places of windows whose words also start earlier, packed by one of ``parts`` ranges of documents."""
    sketch = docs.sparkSession.sparkContext.broadcast(merged_sketch(docs, size, log2_cells))

    def candidates(batches):
        windows, bits = Windows(size), sketch.value
        for chunk in _pieces(batches, size, LOOKED_UP):
            chunk = sorted({(key, i): part for key, i, part in chunk}.items(), key=lambda x: x[0])
            h1, h2, doc, place = windows.hashes([p for _, p in chunk])
            kept = np.arange(len(h1))
            for row, h in enumerate((h1, h2)):
                c = _cells(h[kept], log2_cells)
                kept = kept[(bits[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1]
            h1, h2, doc = h1[kept], (h2[kept] >> np.uint64(32)).astype("<u4"), doc[kept]
            place = (place[kept] + np.array([i for (_, i), _ in chunk], np.int64)[doc]).astype("<u4")
            keys = [key for (key, _), _ in chunk]
            order = np.lexsort((h2, h1))  # stable: of equal windows the earliest comes first
            a, b = h1[order], h2[order]
            later = np.zeros(len(order), bool)
            later[order[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]] = True
            rows = []
            if later.any():
                rows.append((int(keys[doc[later][0]][0]) % parts, 1, _packed(keys, doc[later], place[later])))
            first = np.flatnonzero(~later)
            part = ((h1[first] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[by], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(bounds)):
                at = first[by[bounds[p] : bounds[p + 1]]]
                rows.append((int(p), 0, _packed(keys, doc[at], h1[at], h2[at], place[at])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["part", "kind", "data"])

    def group(batches):
        held: dict[int, list] = {}
        for b in batches:
            for part, kind, data in zip(*(c.to_pylist() for c in b.columns)):
                if kind:
                    table, counts, (place,) = _unpacked(data, "<u4")
                    yield _by_range(table, np.repeat(np.arange(len(table)), counts), place, parts)
                else:
                    held.setdefault(part, []).append(data)
        for part in list(held):
            got = [_unpacked(d, "<u8", "<u4", "<u4") for d in held.pop(part)]
            table, which = np.unique(np.concatenate([g[0] for g in got]), axis=0, return_inverse=True)
            doc = np.repeat(which.reshape(-1), np.concatenate([g[1] for g in got]))
            h1, h2, place = (np.concatenate([g[2][i] for g in got]) for i in range(3))
            del got
            order = np.lexsort((place, doc, h2, h1))
            h1, h2, doc, place = h1[order], h2[order], doc[order], place[order]
            new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc != doc[head]) | (place != place[head])
            if later.any():
                yield _by_range(table, doc[later], place[later], parts)

    sent = docs.mapInArrow(candidates, "part int, kind int, data binary").repartitionById(parts, "part")
    return sent.mapInArrow(group, "range int, data binary")


def remove_repeats(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text", log2_cells: int = 28) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, text (the kept words, joined by one space)."""
    docs = prepared(docs, id_col, text_col).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    windows = (docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // WORD_BYTES  # a guess that sizes tables and nothing else
    log2_cells = min(log2_cells, max(16, (4 * windows).bit_length()))
    ranges = max(shuffle_partitions(docs.sparkSession), windows // RANGE)
    found = stored(repeated_windows(docs, size, log2_cells, ranges), "repeated-windows")

    def assemble(batches):
        now, places = None, {}
        for b in batches_by_bytes(batches, 4):
            out = []
            for of, is_text, data, doc, th, text, doc_id in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(5).to_pylist(), b.column(3).to_pylist(), text_bytes(b.column(4)), b.column(6).to_pylist()):
                if of != now:
                    now, places = of, {}
                if not is_text:
                    table, counts, (place,) = _unpacked(data, "<u4")
                    for key, p in zip(map(tuple, table.tolist()), np.split(place, np.cumsum(counts)[:-1])):
                        places.setdefault(key, []).append(p)
                    continue
                words = text.split()
                n, removed = len(words), 0
                if (doc, th) in places:
                    cover = np.zeros(n + 1, bool)
                    for p in places[doc, th]:
                        cover[p] = True
                    step = cover.astype(np.int64)
                    step[size:] -= cover[:-size]
                    kept = np.cumsum(step)[:n] == 0
                    removed = n - int(kept.sum())
                    words = compress(words, kept.tolist())
                out.append((doc_id, n, removed, b" ".join(words)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n_words", "n_removed", "text"]
                )

    doc = F.coalesce("doc_id", F.lit(NO_ID))
    of = F.pmod(F.pmod(doc, F.lit(PRIME)) * FACTOR + F.pmod(F.col("th"), F.lit(PRIME)), F.lit(ranges)).cast("int").alias("range")
    texts = docs.select(of, F.lit(True).alias("is_text"), F.lit(None).cast("binary").alias("data"), "th", "text", doc.alias("doc"), "doc_id")
    spots = found.select("range", F.lit(False).alias("is_text"), "data", *(F.lit(None).cast(t).alias(c) for c, t in (("th", "long"), ("text", "string"), ("doc", "long"), ("doc_id", "long"))))
    # a range's spots come before its texts, and a task holds the spots of one range at a time
    met = texts.unionByName(spots).repartitionById(ranges, "range").sortWithinPartitions("range", "is_text")
    return met.mapInArrow(assemble, "doc_id long, n_words long, n_removed long, text binary").withColumn("text", F.col("text").cast("string"))
