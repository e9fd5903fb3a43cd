"""Interaction audit of five filters: what each removes in every order of applying them.

1. One scan judges each whole text by the filters A to D and notes its SHA-256; a grouping by SHA-256 gives the smallest id of each text, and filter E fails a
   document whose text a smaller id has.  Labels join by id.
2. The failures of a document are five bits.  A table of 32 x 120, made once, says for each pattern of bits and each order of the five filters the
   step at which the document goes: its first failure in that order.
3. Tasks look their documents up and count part, order and step with ``np.bincount``, once for all documents and once for each label; every
   figure is a sum, so the partial arrays of the tasks are added by a grouping.

A task holds the arrays of at most ``MOST_PARTS`` parts at a time and passes them on before it takes more.  Copies of a text with a noticeable share of all rows
meet their smallest id where they are.

Defined results: null text counts as empty; the part of a null source is the empty string; a document without an id is neither smaller nor larger than
any other, so it never fails E nor makes another fail, and it has no labels; rows that repeat an id don't fail E by each other; an id with several
rows of labels has a label if one of them says so; a part has all 600 rows, zeros included; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, hot_join, stored, text_bytes

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: ``PLACE[o, f]``: the step at which filter f stands in order o, from 0.
PLACE = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])
#: ``BITS[mask, f]``: whether a document of these failures fails filter f.
BITS = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1).astype(bool)
#: ``FIRST[mask, o]``: the step of order o at which a document of these failures goes; STEPS if it never does.
FIRST = np.where(BITS[:, None, :], PLACE[None], STEPS).min(2)
#: Parts whose arrays a task holds at a time, about 60 KB each.
MOST_PARTS = 256

UPPER = bytes(range(65, 91))
MARKS = b"#$%&*|"
#: Bytes that continue a character; all others begin one.
CONTINUE = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """The bits of A to D; text: UTF-8."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.translate(None, CONTINUE))
    short = len(words) < 50
    repeats = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, UPPER))) > 5 * points
    marked = len(text.translate(None, MARKS)) < len(text)
    return short | repeats << 1 | loud << 2 | marked << 3


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, mask, sha): failures of A to D as bits."""

    def run(batches):
        for b in batches_by_bytes(batches, 1):
            texts = text_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.fill_null(b.column(2), ""), pa.array([failures(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
                ["doc_id", "part", "mask", "sha"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(part_col).cast("string").alias("part"))
    return plain.mapInArrow(run, "doc_id long, part string, mask int, sha binary")


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic): one row per document, with the failures of all five filters as bits."""
    seen = stored(judged(docs, id_col, text_col, part_col), "filter-audit")
    first = seen.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    full = hot_join(seen, first, ["sha"], "n").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 1 << 4).otherwise(0)).alias("mask"))
    said = labels.where(f"{id_col} is not null").groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    named = full.where("doc_id is not null").join(said, "doc_id", "left").fillna(False, ["good", "toxic"])
    unnamed = full.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return named.unionByName(unnamed).select("part", "mask", "good", "toxic")


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


class Tally:
    """Counts of one part: by order and step, for all documents and each label, and by pattern of failures."""

    def __init__(self):
        self.gone = np.zeros((3, len(ORDERS), STEPS + 1), np.int64)
        self.masks = np.zeros(1 << STEPS, np.int64)

    def figures(self) -> list[np.ndarray]:
        """The arrays of FIGURES, each of orders x steps; sums of them over tasks are the figures of all."""
        removed, good, toxic = self.gone[:, :, :STEPS]
        letter = np.argsort(PLACE, axis=1)  # the filter at each step of each order
        fails = (self.masks[:, None] * BITS).sum(0)
        alone = self.masks[1 << np.arange(STEPS)]
        whole = np.bincount(letter.reshape(-1), removed.reshape(-1), STEPS).astype(np.int64)
        kept = self.masks.sum() - np.cumsum(removed, axis=1)
        return [kept, removed, fails[letter] - removed, alone[letter], good, toxic, whole[letter]]


def counted(rows: DataFrame) -> DataFrame:
    """Partial figures of each task: part, filter_order, step and FIGURES."""

    def run(batches):
        held: dict[str, Tally] = {}

        def passed_on():
            for part, tally in held.items():
                columns = [pa.array([part] * len(ORDERS) * STEPS), pa.array(np.repeat(ORDERS, STEPS)), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(a.reshape(-1)) for a in tally.figures()], ["part", "filter_order", "step", *FIGURES])
            held.clear()

        for b in batches:
            codes = b.column(0).dictionary_encode()
            part, mask = codes.indices.to_numpy(), b.column(1).to_numpy()
            labelled = [np.ones(len(mask), bool), *(b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))]
            names = codes.dictionary.to_pylist()
            by_part = np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=len(names)))[:-1])
            for name, own in zip(names, by_part):
                if name not in held and len(held) == MOST_PARTS:
                    yield from passed_on()
                tally = held.setdefault(name, Tally())
                tally.masks += np.bincount(mask[own], minlength=1 << STEPS)
                for gone, label in zip(tally.gone, labelled):
                    step = FIRST[mask[own[label[own]]]]
                    at = np.arange(len(ORDERS)) * (STEPS + 1) + step
                    gone += np.bincount(at.reshape(-1), minlength=gone.size).reshape(gone.shape)
        yield from passed_on()

    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    partial = counted(masks(docs, labels, id_col, text_col, part_col))
    return partial.groupBy("part", "filter_order", "step").agg(*(F.sum(f).alias(f) for f in FIGURES))
