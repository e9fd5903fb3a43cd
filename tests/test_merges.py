"""Merges undone exactly, and draws for an audit."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from marlspark.checkpoints import checkpoint
from marlspark.operators import audits as U
from marlspark.operators import merges as M

CLAIM = "claim_id long, src long, dst long, relation string, stance string, support array<long>, tier int, confidence double"
LOG = "merge_id long, source long, target long, at timestamp_ntz, reversed_at timestamp_ntz"


def state(spark, written, log):
    df = spark.createDataFrame(log, "merge_id long, source long, target long, at string, reversed_at string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "reversed_at")})
    return M.claims(spark.createDataFrame(written, CLAIM), M.homes(M.standing(df), checkpoint))


def rows(df):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


def brute(written, log):
    to = {}
    for _, s, t, at, back in sorted(log, key=lambda m: (m[3], m[0])):
        if back is None and s != t:
            to[s] = t

    def home(x):
        seen = []
        while x in to and x not in seen:
            seen.append(x)
            x = to[x]
        if x in to:  # a circle
            return min(seen[seen.index(x) :])
        return x

    groups = {}
    for c in written:
        src, dst = home(c[1]), home(c[2])
        if src != dst:
            groups.setdefault((src, dst, c[3], c[4]), []).append(c)
    out = []
    for (src, dst, relation, stance), cs in groups.items():
        best = max(cs, key=lambda c: (c[6] or 0, -c[0]))
        out.append((min(c[0] for c in cs), src, dst, relation, stance, tuple(sorted({p for c in cs for p in c[5] or []})), best[6], best[7], len(cs)))
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    return [(i, r.randrange(12), r.randrange(12), r.choice("ab"), r.choice("+-"), [r.randrange(9) for _ in range(r.randrange(4))] if r.random() < 0.9 else None, r.choice([None, 1, 2, 3]), r.random()) for i in range(150)]


def test_fold_fold_unfold_is_the_start(spark):
    written = made(3)
    start = rows(state(spark, written, []))
    a, b = (1, 4, 2, "2024-01-01", None), (2, 2, 7, "2024-01-02", None)
    first, both = rows(state(spark, written, [a])), rows(state(spark, written, [a, b]))
    assert start != first != both and start == brute(written, []) and both == brute(written, [a, b])
    # the older merge taken back under the newer one, and the other way round
    gone = "2024-01-03"
    assert rows(state(spark, written, [(*a[:4], gone), b])) == rows(state(spark, written, [b])) == brute(written, [b])
    assert rows(state(spark, written, [a, (*b[:4], gone)])) == first
    assert rows(state(spark, written, [(*a[:4], gone), (*b[:4], gone)])) == start
    # what was written meanwhile stays
    more = [*written, (900, 7, 4, "a", "+", [77], 3, 0.5)]
    assert rows(state(spark, more, [(*a[:4], gone), (*b[:4], gone)])) == brute(more, [])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_log(spark, seed):
    r = random.Random(seed)
    written = made(seed)
    log = [(i, r.randrange(12), r.randrange(12), f"2024-01-{1 + i:02d}", r.choice([None, None, "2024-03-01"])) for i in range(8)]
    assert rows(state(spark, written, log)) == brute(written, log)


def test_a_long_chain_and_a_circle(spark):
    chain = [(i, i, i + 1) for i in range(40)] + [(100, 60, 61), (101, 61, 62), (102, 62, 60), (103, 70, 60), (104, 55, 61)] + [(200 + i, 300 + i, 300 + (i + 1) % 11) for i in range(11)]
    log = spark.createDataFrame([(i, s, t) for i, s, t in chain], "merge_id long, source long, target long").withColumns({"at": F.lit("2024-01-01").cast("timestamp_ntz"), "reversed_at": F.lit(None).cast("timestamp_ntz")})
    got = {r["source"]: r["home"] for r in M.homes(M.standing(log), checkpoint).collect()}
    assert got == {i: 40 for i in range(40)} | {60: 60, 61: 60, 62: 60, 70: 60, 55: 60} | {300 + i: 300 for i in range(11)}


def test_entities_and_changes(spark):
    e = spark.createDataFrame([(1, "A", ["a"]), (2, "B", None), (3, "C", ["c", "a"])], "entity_id long, name string, aliases array<string>")
    h = spark.createDataFrame([(2, 1), (3, 1)], "source long, home long")
    assert {r["entity_id"]: (r["aliases"], r["merged_from"], r["redirects_to"]) for r in M.entities(e, h).collect()} == {1: (["B", "C", "a", "c"], [2, 3], None), 2: ([], [], 1), 3: (["c", "a"], [], 1)}
    w = [(1, 1, 5, "r", "+", [1], 1, 0.1), (2, 2, 5, "r", "+", [2], 2, 0.2), (3, 3, 6, "r", "+", [3], 1, 0.3), (4, 8, 9, "r", "+", None, None, None)]
    before, after = state(spark, w, []), state(spark, w, [(1, 2, 1, "2024-01-01", None), (2, 3, 1, "2024-01-01", None)])
    assert {tuple(r) for r in M.changes(before, after).collect()} == {(1, "changed"), (2, "gone"), (3, "moved")}
    assert {tuple(r) for r in M.changes(after, before).collect()} == {(1, "changed"), (2, "back"), (3, "moved")}


@pytest.mark.parametrize("size", [0, 1, 7, 50, 10_000])
def test_draw(spark, size):
    r = random.Random(5)
    data = [(i, r.choice("aabbbbc") if i % 50 else "rare") for i in range(1000)]
    df = spark.createDataFrame(data, "item long, kind string")
    one, two = (sorted(tuple(x) for x in U.draw(d, "item", "kind", size, "s").collect()) for d in (df.coalesce(1), df.repartition(7, "item")))
    assert one == two and len(one) == min(size, 1000)
    n = {k: sum(x == k for _, x in data) for k in "abc"} | {"rare": sum(x == "rare" for _, x in data)}
    taken = {k: sum(x[0] == k for x in one) for k in n}
    fair = {k: Fraction(min(size, 1000) * v, 1000) for k, v in n.items()}
    assert all(abs(taken[k] - fair[k]) < 1 for k in n)
    assert one != sorted(tuple(x) for x in U.draw(df, "item", "kind", size, "t").collect()) or size in (0, 10_000) or size == 1
    assert all(x[2] <= x[4] for x in one)


def test_report_of_few_grades(spark):
    drawn = spark.createDataFrame([("a", 1, 1, 10, 3), ("a", 2, 2, 10, 3), ("a", 3, 3, 10, 3), ("b", 9, 1, 4, 1)], "kind string, item long, position long, n long, take long")
    grades = spark.createDataFrame([(1, True), (2, True), (2, False), (3, None), (9, None)], "item long, right boolean")
    got = {r["kind"]: tuple(r)[1:] for r in U.report(drawn, grades, "item", "kind").collect()}
    assert got["b"] == (4, 1, 0, 0, None, None, None) and got["a"][:5] == (10, 3, 2, 1, 0.5) and 0 < got["a"][5] < 0.5 < got["a"][6] < 1
