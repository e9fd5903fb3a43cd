"""Harmonic packing of documents into token sequences of a fixed capacity.

A document's ids are cut into full sequences and one rest.  A rest longer than capacity/(k+1) and at most capacity/k belongs to class k, and every bin of
class k takes exactly k of them.  What such a bin then lacks, less than capacity/(k+1) and a quarter of it on average where lengths are even, is cut off the front of the
next rests that come; what is left of those goes to its own class.  So each class has its fixed number of documents and bins have no padding.  Each task fills its
own bins from its own split, so no shuffle is needed, and what it holds is bounded: less than one open bin a class and one that is being topped up.  What
its open bins hold at the end of the split is laid end to end and cut at the capacity; the very last such stretch is cut into powers of two, which need no padding.

Defined results: a null or empty text has just the end id; a very long text is cut like any other; repeated rows
are packed as often as they occur; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batches_by_bytes, prepared, text_bytes

#: Chunks of text kept in a worker's memory before the older half of them goes, and the longest that is kept.
MOST_CHUNKS, LONGEST_CHUNK = 400_000, 80
#: A chunk is a word of letters that no normalisation but lower-casing changes, with or without a mark after it, or anything else.
CHUNK = re.compile("([a-zß-öø-ÿ]{1,40})([.,;:!?]{0,9}) |([^ ]+) ")


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded long"


class ChunkEncoder:
    """The ids of a text as little-endian 32-bit integers, for a tokenizer that drops white space and marks word ends.

    Since no token spans white space, a text's ids are those of its chunks between ASCII white space, one after
    another; a chunk met before is looked up.  New chunks that are one word of Latin letters, with or without a mark after it,
    are encoded many at a time, laid out with spaces between, and told apart by the tokens that end a word.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    @classmethod
    @functools.cache
    def shared(cls, path: str) -> "ChunkEncoder":
        """One encoder a worker process; a task that ends has it forget its chunks, as idle workers keep their memory."""
        return cls(path)

    def forget(self) -> None:
        self.known, self.older, self.cores = {}, {}, {}

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> None:
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(part) and stop[-1] == len(ids):
                data, at = ids.tobytes(), [0, *(4 * stop).tolist()]
                self.cores.update(zip(part, map(data.__getitem__, map(slice, at, at[1:]))))
            else:
                self.cores.update(zip(part, self._each(part)))

    def _encode(self, chunks: list[bytes]) -> None:
        """Puts new chunks into the memory."""
        shaped = CHUNK.findall((b" ".join(chunks) + b" ").decode().lower())  # as the tokenizer would
        if other := [c for c, t in zip(chunks, shaped) if t[2]]:
            self.known.update(zip(other, self._each([c.decode() for c in other])))
        if len(self.cores) > MOST_CHUNKS:
            self.cores.clear()
        cores = self.cores
        self._words(list({x for word, mark, _ in shaped for x in (word, mark) if x and x not in cores}))
        self.known.update((c, cores[word] + cores[mark] if mark else cores[word]) for c, (word, mark, _) in zip(chunks, shaped) if word)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > MOST_CHUNKS:
            self.older, self.known = self.known, {}
        cut = [t.split() for t in texts]
        known, older = self.known, self.older
        new = set().union(*cut).difference(known) if cut else set()
        known.update((c, older[c]) for c in new.intersection(older))
        if missing := list(new.difference(older)):
            self._encode(missing)
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for c in new:
            if len(c) > LONGEST_CHUNK:
                del known[c]
        return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset in the sequence, and padded: the length that the sequence is padded to."""
    if capacity & (capacity - 1) or capacity < 16:
        raise ValueError("capacity must be a power of two, 16 at least")

    def run(batches):
        encoder, end = ChunkEncoder.shared(tokenizer), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        serial, open_bins, done = 0, {}, []
        topped, room = [], 0  # the bin that is being topped up, and what it lacks

        def close(pieces: list[tuple], padded: int = 0) -> None:
            nonlocal serial
            at = 0
            for doc, start, ids, total in pieces:
                done.append((doc, start, len(ids) // 4, ids, total, base + serial, at, padded))
                at += len(ids) // 4
            serial += 1

        def emit():
            cols = list(zip(*done)) if done else [()] * 8
            done.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches_by_bytes(batches, 1, 4 << 20):
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(text_bytes(b.column(1)))):
                ids += end
                total, start = len(ids) // 4, 0
                while total - start >= capacity:
                    close([(doc, start, ids[4 * start : 4 * (start + capacity)], total)], capacity)
                    start += capacity
                if room and start < total:
                    take = min(room, total - start)
                    topped.append((doc, start, ids[4 * start : 4 * (start + take)], total))
                    start, room = start + take, room - take
                    if not room:
                        close(topped, capacity)
                if start < total:  # then no bin is being topped up
                    k = capacity // (total - start)
                    bin_ = open_bins.setdefault(k, [])
                    bin_.append((doc, start, ids[4 * start :], total))
                    if len(bin_) == k:
                        topped = open_bins.pop(k)
                        room = capacity - sum(len(p[2]) for p in topped) // 4
                        if not room:
                            close(topped, capacity)
            yield emit()
        encoder.forget()

        rest = (topped if room else []) + [p for k in sorted(open_bins) for p in open_bins[k]]
        left = sum(len(p[2]) // 4 for p in rest)
        sizes = [capacity] * (left // capacity) + [1 << i for i in range(capacity.bit_length() - 1, -1, -1) if (left % capacity) >> i & 1]
        now: list[tuple] = []
        room = sizes.pop(0) if sizes else 0
        width = room
        for doc, start, ids, total in rest:
            while ids:
                take = min(room, len(ids) // 4)
                now.append((doc, start, ids[: 4 * take], total))
                ids, start, room = ids[4 * take :], start + take, room - take
                if not room:
                    close(now, width)
                    now, room = [], sizes.pop(0) if sizes else 0
                    width = room
        if done:
            yield emit()

    return prepared(docs, id_col, text_col).mapInArrow(run, SCHEMA)
