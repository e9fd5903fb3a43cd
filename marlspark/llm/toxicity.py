"""Toxicity scores from class-conditional Kneser-Ney models of characters.

A text is read as its units: what stands between white space, lower-cased, signs and digits included; runs of letters of scripts without spaces are
read as overlapping pairs, and units of more than ``PIECE`` characters in pieces that know the characters before them.  A model predicts each character of a unit, and
its end, from the up to ``ORDER - 1`` characters before it, the unit's start included:

    p(x | h) = (max(c(hx) - DISCOUNT, 0) + freed(h) * shared(x | h)) / c(h)

where c are the counts of the class (pairs of a document and a distinct unit of it, so repeating a unit in a document adds nothing), freed(h) is what the
discount takes away after h, and shared is the backoff that both classes share: interpolated Kneser-Ney after the last three characters and after none,
from continuation counts (the number of distinct characters before an n-gram) in all documents, labelled or not.  A class that has not met h takes the
backoff alone, so of rare expressions both classes think alike, and their ratio is one.

A toxic text is ordinary for the most part.  Its model is a mixture: each unit is from the toxic model with probability ``SHARE``, else from the ordinary one.  The
evidence is the difference of the two log-likelihoods of the text, that of the mixture less that of the ordinary model, divided by the number of units; a logistic
curve fitted to labelled documents that no count has seen turns it into a score.

The ratios of n-grams and histories that a class has met are what scoring needs.  They come from labelled rows, at most ``most_labels`` of them (those with the smallest
hashes of doc_id), and are sent to the tasks by 64 bits of hash each where there are at most ``most_ratios``; beyond that they stay a table that units are joined to.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0: folds 1 to 3 give the counts and fold 4 the curve.

Defined results: null and empty texts have evidence 0; a null doc_id counts as held out; labels without doc_id or class are ignored, and of several
labels of a document the largest holds; without training rows of both classes every score is 0; repeated rows get equal results; an empty table gives
an empty table; very long texts are read whole; no column but the text enters a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, shuffle_partitions, stored

#: Chosen on folds 1 to 4.
ORDER, DISCOUNT, SHARED_DISCOUNT, SHARE = 8, 1.0, 0.75, 0.003
PIECE = 64
#: Runs of Thai, Lao, Burmese, Khmer, Chinese, Japanese and Korean.
WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]+")
SPACE = re.compile(r"\s")
#: Characters of a text from which on its units are not made at once, and units kept in a worker's memory.
STRETCH, MOST_KNOWN = 1 << 19, 300_000
#: What begins and ends a unit, and what begins the name of a piece of one; units hold no white space.
START, END, PART = "\n", " ", "\t"


def _pairs(run: re.Match) -> str:
    r = run[0]
    return f" {' '.join(r[i : i + 2] for i in range(max(1, len(r) - 1)))} "


def _stretches(text: str):
    """The text in stretches that end at white space."""
    at = 0
    while len(text) - at > STRETCH:
        stop = m.start() if (m := SPACE.search(text, at + STRETCH)) else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


def pieces(unit: str) -> list[str]:
    w = START + unit + END
    return [PART + w[max(0, i - ORDER + 1) : i + PIECE] for i in range(1, len(w), PIECE)]


def unit_lists(text: str | None):
    """The units of a text, a list a stretch."""
    for part in _stretches((text or "").lower()):
        found = (WIDE.sub(_pairs, part) if WIDE.search(part) else part).split()
        if found and max(map(len, found)) > PIECE:
            found = [p for u in found for p in (pieces(u) if len(u) > PIECE else (u,))]
        yield found


def whole(unit: str) -> str:
    """A unit with the marks of its start and end, or a piece of one with the characters before it."""
    return unit[1:] if unit[0] == PART else START + unit + END


def grams(unit: str) -> list[str]:
    """For each character that is predicted, it and what it is predicted from."""
    s = whole(unit)
    return [s[max(0, i - ORDER + 1) : i + 1] for i in range(1 if s[0] == START else ORDER - 1, len(s))]


def gathered(docs: DataFrame) -> DataFrame:
    """(unit, n0, n1) and (five, null, null) from (text, cls), in parts: the counts of each class of the units of its documents, and the n-grams of up to
    five characters of all documents."""

    def run(batches):
        count, seen, fives = [Counter(), Counter()], set(), set()

        def emit():
            for names, ns in ((list(count[0] | count[1]), count), (list(fives), None)):
                for i in range(0, len(names), 1 << 16):
                    part = names[i : i + (1 << 16)]
                    columns = [pa.array([c[k] for k in part], pa.int64()) for c in ns] if ns else [pa.nulls(len(part), pa.int64())] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *columns], ["name", "n0", "n1"])

        for b in batches_by_bytes(batches, 0, 2 << 20):
            for text, cls in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                once = set().union(*unit_lists(text))
                if cls is not None:
                    count[cls].update(once)
                new = once.difference(seen)
                seen |= new
                for u in new:
                    w = whole(u)
                    fives.update([w[i : i + 5] for i in range(len(w) - 4)])
                    if w[0] == START:
                        fives.update((w[:2], w[:3], w[:4]))
                if len(seen) > MOST_KNOWN:
                    yield from emit()
                    count, seen, fives = [Counter(), Counter()], set(), set()
        yield from emit()

    return docs.mapInArrow(run, "name string, n0 long, n1 long")


def class_counts(parts: DataFrame) -> DataFrame:
    """(gram, n0, n1): the counts of each class of the n-grams of units, each at the character that it predicts."""
    n = shuffle_partitions(parts.sparkSession)  # named, so that few bytes of units don't end up in one task
    units = parts.where("n0 is not null").repartition(n, "name").groupBy("name").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    piece = F.col("name").startswith(PART)
    w = units.select(F.when(piece, F.substring("name", F.lit(2), F.length("name"))).otherwise(F.concat(F.lit(START), "name", F.lit(END))).alias("w"), "n0", "n1")
    first = F.when(F.col("w").startswith(START), 2).otherwise(ORDER)
    at = w.select("w", "n0", "n1", F.explode(F.sequence(first, F.length("w"))).alias("i"))
    gram = F.substring("w", F.greatest(F.col("i") - (ORDER - 1), F.lit(1)), F.least("i", F.lit(ORDER)))
    return at.select(gram.alias("gram"), "n0", "n1").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def ratios(counts: DataFrame, fives: DataFrame) -> DataFrame:
    """(name, history, ratio): the log-ratio of the classes for each n-gram and each history that a class has met."""
    size = F.length("gram")
    last = lambda k, c="gram": F.substring(c, -k, k)
    taken = lambda c: F.greatest(F.col(c) - SHARED_DISCOUNT, F.lit(0.0))
    # single characters, by the number of distinct characters before them
    ones = fives.select(last(2, "name").alias("two")).distinct().groupBy(last(1, "two").alias("x")).agg(F.count("*").alias("k1"))
    total = ones.agg(F.sum("k1").alias("t"), F.count("*").alias("m"))  # one row
    ones = ones.join(F.broadcast(total)).select("x", ((taken("k1") + SHARED_DISCOUNT * F.col("m") / (F.col("m") + 1)) / F.col("t")).alias("b1"))
    # the last three characters and the next one, by the number of distinct characters before them
    fours = fives.where(F.length("name") == 5).groupBy(last(4, "name").alias("s4")).agg(F.count("*").alias("k4"))
    threes = fours.groupBy(F.substring("s4", 1, 3).alias("h3")).agg(F.sum("k4").alias("t4"), F.count("*").alias("m4"))
    fours = fours.join(threes, F.substring("s4", 1, 3) == F.col("h3")).select("s4", (taken("k4") / F.col("t4")).alias("a4"), (SHARED_DISCOUNT * F.col("m4") / F.col("t4")).alias("f4"))

    met = counts.withColumn("h", F.substring("gram", F.lit(1), size - 1))
    free = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT)))
    histories = met.groupBy("h").agg(*(F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)), *(free(f"n{c}").alias(f"f{c}") for c in (0, 1)))
    full = met.withColumns({"x": last(1), "s4": F.when(size > 4, last(4))}).join(histories, "h").join(F.broadcast(ones), "x").join(fours, "s4", "left")  # ``ones`` has a row a character, fewer than Unicode's 1.2 million
    shared = F.when(F.col("a4").isNull(), F.col("b1")).otherwise(F.col("a4") + F.col("f4") * F.col("b1"))
    p = [F.when(F.col(f"t{c}") > 0, (F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) + F.col(f"f{c}") * shared) / F.col(f"t{c}")).otherwise(shared) for c in (0, 1)]
    unmet = [F.when(F.col(f"t{c}") > 0, F.col(f"f{c}") / F.col(f"t{c}")).otherwise(1.0) for c in (0, 1)]
    row = lambda name, history, q: (F.col(name).alias("name"), F.lit(history).alias("history"), (F.log(q[1]) - F.log(q[0])).alias("ratio"))
    return full.select(*row("gram", False, p)).unionByName(histories.select(*row("h", True, unmet)))


#: Odd multipliers of the hashes, and what sets those of histories apart (any odd numbers do).
BASE, MIX, ASIDE = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def _laid(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, places within the string, where each string starts) of strings laid end to end."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(lens) - lens
    return codes, np.arange(len(codes)) - np.repeat(starts, lens), starts


def _windows(codes: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """The sum that names the last up to ``width`` characters of a string at each place."""
    total = codes.copy()
    for j in range(1, min(width, len(codes))):
        total[j:] += np.where(place[j:] >= j, codes[:-j] * np.uint64(pow(BASE, j, 1 << 64)), np.uint64(0))
    return total


#: Ratios are whole numbers of this part of a nat, and a unit's evidence of that; sums of them do not depend on their order.
GRAIN, FINE = 2.0**-24, 2.0**-32


def keyed(table: DataFrame) -> DataFrame:
    """(key, ratio, first): names as 64 bits of hash, ratios in GRAIN; ``first`` marks the names that begin units: the bare start and the start with one character."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                codes, place, starts = _laid(b.column(0).to_pylist())
                key = _windows(codes, place, ORDER)[np.append(starts[1:], len(codes)) - 1]
                history = np.asarray(b.column(1))
                key = _spread(np.where(history, key ^ ASIDE, key)).view(np.int64)
                first = (codes[starts] == np.uint64(ord(START) + 1)) & (np.diff(np.append(starts, len(codes))) <= np.where(history, 1, 2))
                grains = np.rint(np.clip(b.column(2).to_numpy(), -60, 60) / GRAIN).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(grains), pa.array(first)], ["key", "ratio", "first"])

    return table.select("name", "history", "ratio").mapInArrow(run, "key long, ratio int, first boolean")


def _mixed(grains: np.ndarray) -> np.ndarray:
    """What units speak for the mixture, in FINE, from their summed ratios."""
    return np.rint(np.log(1 - SHARE + SHARE * np.exp(np.clip(grains * GRAIN, -30, 30))) / FINE).astype(np.int64)


class Ratios:
    """Ratios by key: sorted keys, found by their leading bits."""

    def __init__(self, keys: np.ndarray, ratio: np.ndarray):
        keys = keys.view(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ratio = keys[order], ratio[order].astype(np.int32)
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.first = np.append(self.first, np.int32(len(keys)))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The ratio of each key, not a number for those without."""
        out = np.full(len(keys), np.nan)
        bucket = (keys >> self.shift).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.ratio[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


def unit_ratios(units: list[str], table: Ratios) -> np.ndarray:
    """The log-ratio of each unit, in GRAIN.  A history that begins a unit is met only if the n-gram before it is, so few places are looked up."""
    codes, place, starts = _laid(list(map(whole, units)))
    grams, before = _windows(codes, place, ORDER), _windows(codes, place, ORDER - 1)
    ratio, met, lens = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool), np.diff(np.append(starts, len(codes)))
    anchored = codes[starts] == np.uint64(ord(START) + 1)

    def settle(at: np.ndarray, r: np.ndarray, other: np.ndarray | None = None) -> None:
        known = ~np.isnan(r)
        met[at[known]] = True
        ratio[at[known]] = r[known].astype(np.int64)
        rest = at[~known]
        ratio[rest] = (np.nan_to_num(table.of(_spread(before[rest - 1] ^ ASIDE))) if other is None else other[~known]).astype(np.int64)

    for i in range(1, ORDER):
        at = starts[anchored & (lens > i)] + i
        if i > 1:
            at = at[met[at - 1]]
        settle(at, table.of(_spread(grams[at])))
    later = np.flatnonzero(place >= np.repeat(np.where(anchored, ORDER, ORDER - 1), lens))
    other = table.of(_spread(before[later - 1] ^ ASIDE))
    later, other = later[~np.isnan(other)], other[~np.isnan(other)]
    settle(later, table.of(_spread(grams[later])), other)
    return np.add.reduceat(ratio, starts)


class Model:
    """The ratios, as arrays or as a table where they are too many, and the curve."""

    def __init__(self, counts: DataFrame, fives: DataFrame, most_ratios: int):
        self.slope, self.offset, self.ratios, self.table = 1.0, 0.0, None, None
        n0, n1 = counts.agg(F.sum("n0"), F.sum("n1")).first()
        self.usable = bool(n0 and n1)
        if self.usable:
            self.table = stored(keyed(ratios(counts, fives)), "toxic-ratios")
            if self.table.count() <= most_ratios:
                got = self.table.toArrow()
                self.ratios, self.table = Ratios(got["key"].to_numpy(), got["ratio"].to_numpy()), None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def evidence(self, texts: list[str | None], known: dict | None = None) -> np.ndarray:
        """What speaks for the toxic class, in nats a thousand units."""
        total, n = [0] * len(texts), np.zeros(len(texts), np.int64)
        if not self.usable:
            return np.zeros(len(texts))
        known = {} if known is None else known
        held: list[tuple[int, list[str]]] = []

        def settle():
            new = list(set().union(*(units for _, units in held)).difference(known))
            if len(known) + len(new) > MOST_KNOWN:
                known.clear()
                new = list(set().union(*(units for _, units in held)))
            for i in range(0, len(new), 1 << 16):
                part = new[i : i + (1 << 16)]
                known.update(zip(part, _mixed(unit_ratios(part, self.ratios)).tolist()))
            for i, units in held:
                total[i] += sum(map(known.__getitem__, units))
            held.clear()

        size = 0
        for i, t in enumerate(texts):
            for units in unit_lists(t):
                if units:
                    held.append((i, units))
                    n[i] += len(units)
                    size += len(units)
                if size > 1 << 18:
                    settle()
                    size = 0
        settle()
        return 1000 * (np.array(total, np.float64) * FINE) / np.maximum(n, 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -40, 40)))

    def fit_curve(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression in one variable by Newton's method, with a slight penalty on the slope."""
        if not self.usable or len(set(toxic.tolist())) < 2:
            self.usable = False
            return
        x, w = np.column_stack([evidence, np.ones(len(evidence))]), np.zeros(2)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
            step = np.linalg.solve(hessian, x.T @ (toxic - p) - np.array([1e-3, 1e-6]) * w)
            w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = map(float, w)


def fold(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)), F.lit(0)).cast("int")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = 1_000_000, most_ratios: int = 1 << 25, most_curve: int = 20_000) -> Model:
    """labels: doc_id, toxic (0 or 1).  At most ``most_labels`` labelled rows are learnt from, and ``most_curve`` of them fit the curve."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).where(fold("id") > 0)
    known = F.broadcast(stored(known.orderBy(F.xxhash64("id"), "id").limit(most_labels), "toxic-labels"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = texts.join(known, "id", "left").select("text", F.when(fold("id") < 4, F.col("toxic")).alias("cls"))
    parts = stored(gathered(counted), "toxic-parts")
    fives = parts.where("n0 is null").select("name").distinct()
    model = Model(stored(class_counts(parts), "toxic-grams"), stored(fives, "toxic-fives"), most_ratios)

    bound = texts.join(known.where(fold("id") == 4).orderBy(F.xxhash64("id"), "id").limit(most_curve), "id").select("id", "text", "toxic")
    rows = measured(bound, model, "text", keep=["id", "toxic"]).orderBy(F.xxhash64("id"), "id", "evidence").limit(most_curve).toPandas()  # ids may repeat
    model.fit_curve(rows["evidence"].to_numpy(), rows["toxic"].to_numpy())
    return model


def measured(docs: DataFrame, model: Model, text_col: str, keep: list[str], names: tuple[str, str] = ("evidence", "score")) -> DataFrame:
    """The columns ``keep``, with evidence and score under ``names``."""
    inner = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text"))
    if model.table is not None:
        out = _joined(inner, model)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)  # at most ``most_ratios`` pairs of 8 bytes
        schema = [f"_{i} {t}" for i, (_, t) in enumerate(docs.select(*keep).dtypes)]

        def run(batches):
            known: dict[str, float] = {}
            for b in batches_by_bytes(batches, len(keep), 2 << 20):
                evidence = sent.value.evidence(b.column(len(keep)).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(evidence), pa.array(sent.value.score(evidence))], [f"_{i}" for i in range(len(keep))] + ["evidence", "score"])

        out = inner.mapInArrow(run, ", ".join([*schema, "evidence double", "score double"]))
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), F.col("evidence").alias(names[0]), F.col("score").alias(names[1]))


def _joined(docs: DataFrame, model: Model) -> DataFrame:
    """The same by joins, for ratios that are too many to be sent: the units of distinct texts meet their n-grams' ratios."""

    def split(batches):
        for b in batches_by_bytes(batches, 2, 2 << 20):
            for th, size, text in zip(*(c.to_pylist() for c in b.columns)):
                for units in unit_lists(text):
                    if units:
                        unit, k = zip(*Counter(units).items())
                        yield pa.RecordBatch.from_arrays([pa.array([th] * len(unit), pa.int64()), pa.array([size] * len(unit), pa.int32()), pa.array(unit), pa.array(k, pa.int64())], ["th", "size", "unit", "k"])

    def named(batches):
        for b in batches_by_bytes(batches, 0, 2 << 20):
            units = b.column(0).to_pylist()
            found = [grams(u) for u in units]
            strings = [g for f in found for g in f]
            codes, place, starts = _laid(strings)
            ends = np.append(starts[1:], len(codes)) - 1
            of = [u for u, f in zip(units, found) for _ in f]
            gram, before = _windows(codes, place, ORDER)[ends], _windows(codes, place, ORDER - 1)[ends - 1]
            first = [len(g) == 2 and g[0] == START for g in strings]
            yield pa.RecordBatch.from_arrays([pa.array(of), *(pa.array(_spread(k).view(np.int64)) for k in (gram, before ^ ASIDE)), pa.array(first)], ["unit", "key", "other", "first"])

    text = F.coalesce("_text", F.lit(""))
    mark = {"_th": F.xxhash64(text), "_size": F.char_length(text)}
    docs = docs.withColumns(mark)
    units = stored(docs.select("_th", "_size", text.alias("_text")).dropDuplicates(["_th", "_size"]).mapInArrow(split, "th long, size int, unit string, k long"), "toxic-units")
    each = units.select("unit").distinct().mapInArrow(named, "unit string, key long, other long, first boolean")
    # every unit has the bare start as its first history and few characters after it: what begins units is a row a character, and is sent
    begins = F.broadcast(model.table.where("first").select("key", "ratio"))
    rest = model.table.where("not first").select("key", "ratio")
    unmet = lambda t: t.select(F.col("key").alias("other"), F.col("ratio").alias("unmet"))
    first = each.where("first").join(begins, "key", "left").join(F.broadcast(unmet(model.table.where("first"))), "other", "left")
    later = each.where("not first").join(rest, "key", "left").join(unmet(rest), "other", "left")
    part = first.select("unit", "ratio", "unmet").unionByName(later.select("unit", "ratio", "unmet"))
    summed = part.groupBy("unit").agg(F.sum(F.coalesce("ratio", "unmet", F.lit(0)).cast("long")).alias("s"))
    nats = F.log(1 - SHARE + SHARE * F.exp(F.greatest(F.least(F.col("s") * GRAIN, F.lit(30.0)), F.lit(-30.0))))
    fine = units.join(summed.select("unit", F.rint(nats / FINE).cast("long").alias("fine")), "unit")
    of = fine.groupBy("th", "size").agg((1000 * (F.sum(F.col("k") * F.col("fine")).cast("double") * FINE) / F.sum("k")).alias("evidence"))
    out = docs.join(of, (F.col("th") == F.col("_th")) & (F.col("size") == F.col("_size")), "left").withColumn("evidence", F.coalesce("evidence", F.lit(0.0)))
    return out.withColumn("score", _curve(F.col("evidence"), model))


def _curve(evidence: Column, model: Model) -> Column:
    x = F.greatest(F.least(evidence * model.slope + model.offset, F.lit(40.0)), F.lit(-40.0))
    return 1 / (1 + F.exp(-x))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = 1_000_000, most_ratios: int = 1 << 25, most_curve: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, evidence."""
    model = train(docs, labels, id_col, text_col, most_labels, most_ratios, most_curve)
    out = measured(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, "text", keep=["doc_id"])
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
