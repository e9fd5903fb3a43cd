"""Personal data: base patterns, and overlapping candidates judged by boosted trees.

Base spans (``email``, ``ip``, ``card``, ``phone``) are always reported.  High-recall generators propose further spans, which may overlap each other and base
spans: anything around an at sign or its spelled-out form, and runs of digits with common separators, whole and cut at either end.  Boosted trees judge each by format
(digits, groups, separators, check digit, octets) and context (words before it, neighbouring characters).  A candidate whose probability reaches its kind's
threshold, and that overlaps no base span and no better candidate, is reported as ``likely_email`` or ``likely_number``.

There are no labels of personal data, so the trees learn from the base patterns.  Positive are candidates that cover a base span, and base spans written in other
ways: addresses with their signs spelled out, phone numbers with 00 for the plus sign.  Negative are positive ones with a digit changed so that their check fails, or
without their ending, and candidates that no base pattern touches, unless they are spelled-out addresses or their digits are grouped as in some positive.
The sample is bounded: ``most_docs`` documents with the smallest hashes, of each at most ``most_each`` candidates and a quarter as many base spans, spread evenly over
the text, of all at most ``most_rows`` examples.  Each threshold is set on a third of the sample that the trees have not seen, as the lowest with a
precision of at least ``precision``; a kind with too few positives there reports no candidates.

The generators propose runs of digits and separators of 7 to 40 characters and addresses of at most 64 characters on either side of the sign: longer ones are no
numbers or mailboxes that anyone uses.  Base spans have no such bounds.

Matches are leftmost and do not overlap within a kind; places are counted in code points, the end is exclusive.

Defined results: a null text counts as empty; a null doc_id is kept; repeated rows get equal results; an empty table gives an empty table; very long texts are read
whole, in time proportional to their length; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import batches_by_bytes, prepared

#: Kinds in the order in which spans with one start are listed.
KINDS = ["email", "ip", "card", "phone", "likely_email", "likely_number"]

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can begin within a run of digits only where it could begin at the run's start, so runs are taken whole
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Words that announce personal data, by what they announce (fixed values).
CUES = {
    "email": ["mail", "e-mail", "email", "contact", "correo", "courriel", "kontakt"],
    "number": ["phone", "tel", "call", "mobile", "fax", "card", "visa", "account", "iban", "ssn", "telefon", "teléfono", "téléphone", "karte", "tarjeta", "carte", "passport"],
    "other": ["version", "page", "isbn", "price", "total", "date", "order", "section", "figure", "chapter"],
}
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?:at|@) ?[\])}] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?(?:dot|\.) ?[\])}] ?|\.)[A-Za-z0-9-]{1,63})+|[^\s@]{1,64}@[^\s@]{1,64}")
# a run of digits and what stands between their groups, taken whole
RUN = re.compile(r"[+(]?[0-9](?:[0-9 ()./-]*[0-9])?")
GROUP = re.compile(r"[+(]{0,2}[0-9]+")
#: Fewest and most characters of a number that is proposed.
LEAST, MOST = 7, 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        before = text[done:at]
        start = at - (len(before) - len(before.rstrip(LOCAL)))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        # the next match begins after this one, or, as it can hold no second at sign, after this sign
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank in KINDS, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits_of(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
        out.sort()
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind: 0 email or 1 number, end) of all proposed spans, overlapping ones included."""
    out = set()
    if "@" in text or re.search(r"[\[({] ?at ?[\])}]", text):
        out.update((m.start(), 0, m.end()) for m in SPELLED.finditer(text))
    for m in RUN.finditer(text):
        s, e = m.span()
        if e - s < LEAST:
            continue
        if e - s > MOST:  # several numbers side by side: every row of groups that could be one
            groups = [g.span() for g in GROUP.finditer(text, s, e)]
            for i, (a, _) in enumerate(groups):
                for _, b in groups[i:]:
                    if b - a > MOST:
                        break
                    if b - a >= LEAST:
                        out.add((a, 1, b))
            continue
        cuts = [s + i for i, c in enumerate(m[0]) if c in " ()"]
        out.add((s, 1, e))
        if cuts:
            first, last = cuts[0] + 1, cuts[-1]
            while first < e and text[first] in " )":
                first += 1
            if e - first >= 7:
                out.add((first, 1, e))
            if last - s >= 7:
                out.add((s, 1, last))
    return sorted(out)


def features(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    d = digits_of(s)
    groups = re.findall(r"[0-9]+", s)
    before = text[max(0, start - 40) : start].lower()
    cue = lambda k: float(any(w in before for w in CUES[k]))
    prev, after = text[start - 1 : start], text[end : end + 1]
    host = s.rpartition("@")[2] if "@" in s else ""
    return [
        len(s), len(d), len(d) / max(1, len(s)), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, max(map(len, groups), default=0),
        s.startswith("+"), "(" in s, s.count(" "), s.count("-"), s.count("."), s.count("/"), "@" in s, host.count("."), len(host.rpartition(".")[2]),
        luhn(d) and len(d) >= 12, len(groups) == 4 and s.count(".") == 3 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        prev.isalnum(), after.isalnum(), prev in ".-/+", after in "-/", cue("email"), cue("number"), cue("other"), sum(c.isalpha() for c in s) / max(1, len(s)),
    ]


def shape(s: str) -> str:
    return re.sub(r"[0-9]", "9", s)


def corrupted(text: str, start: int, rank: int, end: int) -> str | None:
    """The text with the span changed so that it is no personal data any more."""
    s = text[start:end]
    if rank == 0:
        return text[:start] + s.rpartition(".")[0].replace(".", " ") + text[end:]
    if rank == 1:
        return text[:start] + re.sub(r"^[0-9]+", "999", s) + text[end:]
    if rank == 2:
        last = (int(s[-1]) + 1) % 10
        return text[:end - 1] + str(last) + text[end:]
    return text[: start + 1] + "0" * 16 + text[start + 1 :]


class Spans:
    """Sorted (start, rank, end) that are asked what overlaps a stretch."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.spans, self.starts = spans, [s for s, _, _ in spans]
        self.reach = list(accumulate((e for _, _, e in spans), max))

    def over(self, start: int, end: int):
        """Those that overlap, from the last one back."""
        i = bisect_left(self.starts, end) - 1
        while i >= 0 and self.reach[i] > start:
            if self.spans[i][2] > start:
                yield self.spans[i]
            i -= 1

    def touched(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end) - 1
        return i >= 0 and self.reach[i] > start


def rewritten(text: str, start: int, rank: int, end: int) -> list[str]:
    """The span as people write it to keep it from programs."""
    s = text[start:end]
    if rank == 0:
        local, _, host = s.partition("@")
        return [f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local} (at) {host}"]
    return ["00" + s[1:]] if rank == 3 else []


def spread(items: list, most: int) -> list:
    return items if len(items) <= most else [items[i * len(items) // most] for i in range(most)]


def examples(text: str, most: int = 200) -> list[tuple[int, int, str, list[float]]]:
    """(kind, label, shape, features) of a text's candidates, of corrupted and of rewritten ones."""
    base, out = base_spans(text), []
    known = Spans(base)
    for s, kind, e in spread(candidates(text), most):
        hit = any((min(e, be) - max(s, bs)) * 2 >= max(e - s, be - bs) for bs, _, be in known.over(s, e))
        if hit or kind or "@" in text[s:e]:
            out.append((kind, int(hit), shape(text[s:e]), features(text, s, e)))
    for s, rank, e in spread(base, most // 4):
        low, after = max(0, s - 60), text[e : e + 20]
        near = corrupted(text[low:e] + after, s - low, rank, e - low)
        left = Spans(base_spans(near))
        out += [(kind, 0, "", features(near, cs, ce)) for cs, kind, ce in candidates(near) if not left.touched(cs, ce)]
        for other in rewritten(text, s, rank, e):
            near, at = text[low:s] + other + after, s - low
            out += [(kind, 1, shape(other), features(near, cs, ce)) for cs, kind, ce in candidates(near) if cs == at and ce == at + len(other)]
    return out


class Judge:
    """The trees and thresholds; without any, only base spans are found."""

    def __init__(self, trees: BoostedTrees | None = None, thresholds: tuple[float, float] = (2.0, 2.0)):
        self.trees, self.thresholds = trees, thresholds

    def spans(self, texts: list[str]) -> list[tuple[list, list]]:
        """(base, all) of each text."""
        found = [base_spans(t) for t in texts]
        rows, where = [], []
        if self.trees is not None:
            for i, t in enumerate(texts):
                base = Spans(found[i])
                for s, kind, e in candidates(t):
                    if self.thresholds[kind] <= 1 and not base.touched(s, e):
                        rows.append(features(t, s, e))
                        where.append((i, s, kind, e))
        more: dict[int, list] = {}
        if rows:
            p = self.trees.probability(np.array(rows, np.float64))
            for k in np.argsort(-p, kind="stable"):
                i, s, kind, e = where[k]
                if p[k] < self.thresholds[kind]:
                    continue
                taken = more.setdefault(i, [])  # sorted and apart
                after = bisect_right(taken, (s, 9, 0))
                if not (after and taken[after - 1][2] > s) and not (after < len(taken) and taken[after][0] < e):
                    insort(taken, (s, 4 + kind, e))
        return [(b, sorted(b + more.get(i, []))) for i, b in enumerate(found)]


def fit(rows: list[tuple[int, int, str, list[float]]], precision: float = 0.98) -> Judge:
    """Trees from two thirds of the examples, thresholds from the rest.  Shapes of positives are no negatives elsewhere."""
    good = {s for _, y, s, _ in rows if y}
    rows = [r for r in rows if r[1] or not r[2] or r[2] not in good]
    y = np.array([r[1] for r in rows])
    if len(rows) < 50 or y.sum() < 10 or y.sum() == len(y):
        return Judge()
    x, kind = np.array([r[3] for r in rows], np.float64), np.array([r[0] for r in rows])
    third = np.arange(len(rows)) % 3 == 0
    trees = BoostedTrees().fit(x[~third], y[~third])
    p, thresholds = trees.probability(x[third]), []
    for k in (0, 1):
        order = np.argsort(-p[kind[third] == k])
        right, score = y[third][kind[third] == k][order], p[kind[third] == k][order]
        exact = np.cumsum(right) / np.arange(1, len(right) + 1) if len(right) else np.zeros(0)
        ok = np.flatnonzero((exact >= precision) & (np.cumsum(right) >= 10))
        thresholds.append(max(0.5, float(score[ok[-1]])) if len(ok) else 2.0)
    return Judge(trees, tuple(thresholds))


def train(docs: DataFrame, most_docs: int = 20_000, most_rows: int = 60_000, precision: float = 0.98, most_each: int = 200) -> Judge:
    """docs: doc_id, text."""
    keys = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)  # bounded by most_docs
    sample = docs.join(F.broadcast(keys), "doc_id", "left_semi")

    def run(batches):
        for b in batches_by_bytes(batches, 0, 4 << 20):
            rows = [r for t in b.column(0).to_pylist() for r in examples(t or "", most_each)]
            if rows:
                kind, label, form, values = zip(*rows)
                order = [zlib.crc32(repr(v).encode()) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(label, pa.int32()), pa.array(form), pa.array([[float(z) for z in v] for v in values], pa.list_(pa.float64())), pa.array(order, pa.int64())], ["kind", "label", "shape", "x", "o"])

    got = sample.select("text").mapInArrow(run, "kind int, label int, shape string, x array<double>, o long").orderBy("o", "kind", "label", "shape").limit(most_rows)
    return fit([(r["kind"], r["label"], r["shape"], r["x"]) for r in got.collect()], precision)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", judge: Judge | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, arrays of (start, rank in KINDS, end)."""
    docs = prepared(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(judge or train(docs))
    span = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
    named = lambda spans: [{"start": s, "rank": r, "end": e} for s, r, e in spans]

    def run(batches):
        for b in batches_by_bytes(batches, 1, 4 << 20):
            got = sent.value.spans(b.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([named(x) for x, _ in got], span), pa.array([named(y) for _, y in got], span)], ["doc_id", "base", "spans"])

    kind = "array<struct<start:int,rank:int,end:int>>"
    return docs.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    names = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return find(docs, id_col, text_col).select("doc_id", *map(count, KINDS[:4]), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
