"""Hard negatives, the audit of filters and license notices against brute-force versions."""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import regex

from marlspark.llm import filter_audit, hard_negatives, notices, queries

from ..parity import connection, same
from .cases import CLASHES, TEXTS, awkward, by_text, multiset, rows


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_filter_audit"])
def test_agrees_with_sql(spark, sf_dir, name):
    assert same(queries.QUERIES[name](spark, sf_dir), connection(sf_dir), queries.ORACLE_SQL[name])


# ---- hard negatives


def mined(data, every=50, positives=5, negatives=3):
    """data: (vec_id, label, vector), all of which take part."""
    moved = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)) for i, label, v in data}
    out = set()
    for a, label, q in moved:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, other)), i, mark == label) for i, mark, other in moved]
        near = sorted((s, i) for s, i, alike in scored if alike and i != a)[:positives]
        for ps, p in near:
            ps = -ps
            fit = sorted((s, i) for s, i, alike in scored if not alike and 50 * ps <= -100 * s <= 95 * ps)[:negatives]
            out |= {(a, p, r, i, ps, -s) for r, (s, i) in enumerate(fit, 1)}
    return out


def vectors(spark, data, kind="float"):
    more = ", ".join(f"`{c}` string" for c in [*CLASHES, "q", "cell", "ids", "grp"])
    schema = f"vec_id long, embedding array<{kind}>, label int, {', '.join(dict.fromkeys(more.split(', ')))}"
    width = schema.count("` string")
    return spark.createDataFrame([(i, v, label, *["clash"] * width) for i, label, v in data], schema)


def random_vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * spread
    return [(int(i), int(rng.integers(0, 10)), [float(np.float32(x)) for x in centres[rng.integers(6)] + rng.normal(size=dim) * 0.3]) for i in range(n)]


@pytest.mark.parametrize("dim, spread", [(3, 0.2), (8, 1.0), (8, 20.0)])
def test_hard_negatives(spark, dim, spread):
    data = random_vectors(900, dim, dim, spread)
    got = [tuple(r) for r in hard_negatives.mine(vectors(spark, data), pivots=20).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(data) and got


def test_hard_negatives_in_small_blocks(spark, monkeypatch):
    """Many groups, blocks and shards: bounds leave out most pairs, and nothing is lost."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "GROUP", 8)
    monkeypatch.setattr(hard_negatives, "BLOCKS", 4)
    data = random_vectors(1500, 4, 5, 8.0)
    got = hard_negatives.mine(vectors(spark, data), anchor_every=10, pivots=40)
    assert multiset(rows(got)) == multiset(mined(data, every=10))


def test_bounds_leave_out_blocks(spark, monkeypatch):
    """Of clusters far apart, a group isn't served by most blocks of its own label."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    data = random_vectors(3000, 4, 9, 200.0)
    seen = []
    plain = hard_negatives.served
    monkeypatch.setattr(hard_negatives, "served", lambda b, blocks, *rest: seen.append((plain(b, blocks, *rest), b.select("grp").distinct().count() * blocks.count())) or seen[-1][0])
    hard_negatives.mine(vectors(spark, data), pivots=40).count()
    kept, pairs = seen[0][0].count(), seen[0][1]
    assert 0 < kept < 0.5 * pairs


def test_hard_negatives_of_copies(spark):
    """A third of all rows are one vector, anchors among them, and ids tie."""
    data = [(i, 1 if i % 3 else i % 10, [0.5, -0.25, 1.0] if i % 3 else v) for i, _, v in random_vectors(1200, 3, 2)]
    assert multiset(rows(hard_negatives.mine(vectors(spark, data)))) == multiset(mined(data))


def test_hard_negatives_awkward(spark):
    data = random_vectors(300, 3, 4)
    bad = [(5000, 1, None), (5001, 1, [1.0, None, 2.0]), (5002, 1, [1.0, math.nan, 2.0]), (5003, 1, [math.inf, 0.0, 0.0]), (5050, None, [1.0, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (5100, 2, [1.0, 2.0]), (5150, 1, []), (5200, 1, [1e30, 0.0, 0.0])]
    good = [(6000, 3, [0.0, 0.0, 0.0]), (6001, 3, [0.0, 0.0, 0.0]), (6002, 4, [0.0, 0.0, 0.0]), (6050, 4, [1.0, 1.0, 1.0]), (6050, 4, [2.0, 1.0, 1.0]), (6100, 5, [30000.0, -1.0, 7.0]), (6101, 5, [30000.0, -1.0, 8.0]), (6102, 6, [20000.0, 0.0, 0.0])]
    got = hard_negatives.mine(vectors(spark, data + bad + good + good + data[:40], "double"))
    assert multiset(rows(got)) == multiset(mined(data + good))
    assert any(r["anchor_id"] == 6000 for r in got.collect())


def test_hard_negatives_of_large_numbers(spark):
    """Products beyond what doubles hold exactly."""
    data = [(i, i % 4, [4_000_000.0 - i / 256, 3_999_000.0 + i * 3 / 256]) for i in range(0, 400)]
    assert multiset(rows(hard_negatives.mine(vectors(spark, data, "double")))) == multiset(mined(data))


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(vectors(spark, [])).collect() == []
    assert hard_negatives.mine(vectors(spark, [(50, 1, [1.0, 2.0])])).collect() == []
    assert hard_negatives.mine(vectors(spark, [(50, 1, None)])).collect() == []


# ---- audit of filters


def audited(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    marks = {}
    for i, good, toxic in labels:
        if i is not None:
            g, x = marks.get(i, (False, False))
            marks[i] = g or good == 1, x or toxic == 1
    parts = {}
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and smallest[t] < i,
        }
        parts.setdefault(source or "", []).append(({f for f in fails if fails[f]}, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out = []
    for part, members in parts.items():
        total, block = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone, left = [m for m in left if f in m[0]], [m for m in left if f not in m[0]]
                total[f] += len(gone)
                alone = sum(m[0] == {f} for m in members)
                block.append([part, order, step, len(left), len(gone), sum(f in m[0] for m in members) - len(gone), alone, sum(m[1] for m in gone), sum(m[2] for m in gone), f])
        out += [(*b[:-1], total[b[-1]]) for b in block]
    return out


def audit_rows(got):
    return multiset(rows(got.select("part", "filter_order", "step", *filter_audit.FIGURES)))


def test_filter_audit(spark):
    docs = awkward(spark)
    long = " ".join(f"w{i}" for i in range(60))
    extra = spark.createDataFrame([(200 + i, t, s) for i, (t, s) in enumerate([(long, "x"), (long, "y"), (long + " #", "x"), ("A" + long, "x"), (long.upper(), None), (long, ""), ("ÄÖ " * 60, "x")])], "doc_id long, text string, source string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 1, 1), (None, 1, 1), (201, 1, None), (999, 1, 1), (11, None, 1)], "doc_id long, quality int, toxic int")
    data = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    assert audit_rows(filter_audit.audit(docs, labels)) == multiset(audited(data, [tuple(r) for r in labels.collect()]))


def test_filter_audit_of_copies_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "MOST_PARTS", 3)
    rng = random.Random(4)
    data = [(i if rng.random() < 0.95 else None, "same text" if i % 3 else rng.choice(TEXTS[:16]), rng.choice("abcdefghij")) for i in range(700)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 700, 2)]
    got = filter_audit.audit(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert audit_rows(got) == multiset(audited(data, labels))


def test_filter_audit_of_nothing(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert audit_rows(filter_audit.audit(one, labels)) == multiset(audited([(1, None, None)], []))


# ---- license notices


def plain(text):
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})))


def based(text):
    words = plain(text).split(" ") if plain(text) else []
    found = [(i, label) for phrase, label in notices.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def fuzzy(text):
    """(label, edits, matched words) by the pattern over the whole line, without seeds."""
    out = []
    for notice, label in notices.NOTICES:
        k = min(6, len(notice) // 10)
        for m in regex.finditer(rf"(?e)(?<![^ ])(?:{notice}){{e<={k}}}(?![^ ])", plain(text)):
            if notices.NAMES & set(notice.split()) <= set(m[0].split(" ")):
                out.append((label, sum(m.fuzzy_counts), m[0]))
    return out


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def damaged(notice, n, rng):
    for _ in range(n):
        i = rng.randrange(len(notice))
        notice = rng.choice([notice[:i] + notice[i + 1 :], notice[:i] + rng.choice("abcxyz ") + notice[i:], notice[:i] + rng.choice("abcxyz") + notice[i + 1 :]])
    return notice


def fuzzy_texts(seed):
    rng = random.Random(seed)
    filler = ["lorem", "the", "license", "mit", "gnu", "public", "cc", "by", "é😀", "Licence", "under", "apache", "general", "it", "of", "software"]
    out = []
    for _ in range(250):
        parts = [rng.choice(filler) for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), damaged(rng.choice(notices.NOTICES)[0], rng.randrange(5), rng))
        out.append(rng.choice([" ", ", ", "\n", "--"]).join(parts))
    return out


def test_notices(spark):
    data = by_text(awkward(spark)) + list(enumerate(fuzzy_texts(7)))
    data += [(1, "GNU General Public License\tv3, CC-BY 4.0; cc by cc by"), (2, "x" * 300_000 + " MIT  License"), (3, "mit license " * 3000), (4, "The bit license, it license, my licence"), (5, "Under the MIT Licence.")]
    got = {}
    for r in notices.report(spark.createDataFrame(data, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    want = {}
    for i, t in data:
        found = fuzzy(t)
        base = based(t)
        labels = sorted({label for label, _, _ in found} | set(base[4].split(",")) - {""})
        want.setdefault(i, []).append((*base, ",".join(labels)))
    for i in want:
        assert multiset((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in got[i]) == multiset(want[i])
    for i, t in data:
        if len(got[i]) > 1:
            continue
        r, found = got[i][0], fuzzy(t)
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) >= (r["n_base"] > 0) and (r["score"] > 0) == bool(r["labels"])
        matches = json.loads(r["matches"])
        assert multiset((m["label"], m["edits"], plain(t[m["start"] : m["end"]])) for m in matches) == multiset(found)
        assert all(distance(m["notice"], plain(t[m["start"] : m["end"]])) <= m["edits"] <= min(6, len(m["notice"]) // 10) for m in matches)
    assert sum("mit" in r["labels"] for r in got[5]) and not [r for r in got[4] if r["labels"] == "mit" and r["n_words"] == 8]


def test_no_notice_within_the_bound_is_lost():
    """Every damaged notice of at most k edits, whose names stand, gives its label (the distance by dynamic programming)."""
    s, rng = notices.search(tuple(notices.NOTICES), 10, 6), random.Random(11)
    tried = 0
    for notice, label in notices.NOTICES:
        k = min(6, len(notice) // 10)
        for _ in range(60):
            t = re.sub(" +", " ", damaged(notice, rng.randrange(k + 1), rng)).strip()
            if distance(notice, t) <= k and notices.NAMES & set(notice.split()) <= set(t.split()):
                tried += 1
                assert label in notices.scan(f"Note. {t}! End.".encode(), s)[5].split(",")
    assert tried > 500


def test_notices_in_a_long_text_take_time_in_proportion():
    import time

    s = notices.search(tuple(notices.NOTICES), 10, 6)
    for unit in ("icense ", "icense", "public license ", "apache licence "):
        began = time.monotonic()
        notices.scan((unit * (600_000 // len(unit))).encode(), s)
        assert time.monotonic() - began < 30, unit
