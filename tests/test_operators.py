"""Boundaries and properties of single operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marlspark.checkpoints import checkpoint
from marlspark.functions import text as X
from marlspark.functions.predicates import Filters, conditions, contains_all, on_site, overlap
from marlspark.operators import analytics as A
from marlspark.operators import dedupe as D
from marlspark.operators import graph as G
from marlspark.operators import relational as R
from marlspark.operators import search as S


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


def test_fusion_is_the_sum_of_reciprocal_ranks_in_any_order_of_arms(spark):
    rng = random.Random(1)
    arms = [[(i, r + 1) for r, i in enumerate(rng.sample(range(20), 12))] for _ in range(3)]
    frames = [spark.createDataFrame(a, "chunk_id long, rank long") for a in arms]
    want = {}
    for a in arms:
        for i, r in a:
            want[i] = want.get(i, 0) + 1 / (60 + r)
    for order in (frames, frames[::-1]):
        got = {r["chunk_id"]: r["score"] for r in S.fuse(order).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_cap_equals_going_down_the_list(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(6), rng.randrange(9) / 10) for i in range(60)]
    got = [r["chunk_id"] for r in S.cap_per_source(spark.createDataFrame(rows, "chunk_id long, source_id long, score double"), 3, 25).collect()]
    first, rest, seen = [], [], {}
    for i, s, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        seen[s] = seen.get(s, 0) + 1
        (first if seen[s] <= 3 else rest).append(i)
    assert got == (first + rest)[:25]


def test_null_arrays_never_match(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, ["a"]), (4, ["a", None])], "i int, t array<string>")
    assert [r.i for r in df.where(overlap("t", ["a"])).collect()] == [3, 4]
    assert [r.i for r in df.where(contains_all("t", ["a"])).collect()] == [3, 4]


def test_undated_sources_fail_date_bounds_and_no_site_matches_nothing(spark):
    df = spark.createDataFrame([(1, "kept", None, "a.b"), (2, "kept", "2020-01-01", "b")], "i int, retention string, published string, host string").withColumn("published", F.to_date("published"))
    assert [r.i for r in df.where(conditions(Filters(since="2019-01-01"))).collect()] == [2]
    assert df.where(on_site("host", ["  "])).count() == 0
    assert df.where(on_site("host", ["http://B/x"])).count() == 2


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://User:pw@Example.com:80/A?utm_source=x&b=2#frag", "http://example.com/A?b=2"), ("https://e.com", "https://e.com/"), ("ftp://e.com/", None), ("https://e.com/?ref=1", "https://e.com/"), ("mailto:x", None),
    ],
)
def test_normal_urls(spark, url, want):
    assert one(spark, url, "string", X.normal_url(F.col("x"))) == want


def test_reference_list_bounds_are_inclusive(spark):
    entry = "[1] " + "a" * 56
    text = "\n".join([entry] * 3 + ["b" * 120])
    assert one(spark, text, "string", X.reference_list(F.col("x"))) is True
    assert one(spark, text + "b", "string", X.reference_list(F.col("x"))) is False
    assert one(spark, "\n".join([entry] * 2), "string", X.reference_list(F.col("x"))) is False


def test_wide_pairs(spark):
    assert one(spark, "a日本語b字", "string", X.wide_pairs(F.col("x"))) == ["日本", "本語", "字"]


def test_chains_and_loops_of_copies(spark):
    rows = [(2, 1), (3, 2), (4, 3), (10, 11), (11, 12), (12, 10), (5, 12), (20, 20)]
    got = {r["id"]: r["root"] for r in D.roots(spark.createDataFrame(rows, "id long, to long"), checkpoint).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 5: 10, 20: 20}


def test_novelty_threshold_is_strict(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.95, 0.3122498999199199]), (3, [0.96, 0.28])]
    got = {r["chunk_id"]: r["earlier"] for r in D.nearest_earlier(spark.createDataFrame(rows, "chunk_id long, v array<double>"), above=0.95).collect()}
    assert got == {3: 2}


def test_routes(spark):
    links = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "x", 9), ("x", "c", 1), ("c", "d", 1)], "a string, b string, support long")
    assert [r["node"] for r in G.route(links, "a", "d", 4, checkpoint).collect()] == ["a", "b", "c", "d"]
    assert G.route(links, "a", "zz", 4, checkpoint).count() == 0


def test_weighted_mean_leaves_out_missing_parts(spark):
    df = spark.createDataFrame([(0.5, None), (None, None), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(G.weighted([(F.col("a"), 0.3), (F.col("b"), 0.1)])).collect()] == [pytest.approx(0.5), None, pytest.approx(0.75)]


def test_shares_are_clamped_and_add_up(spark):
    rows = [("a", 10.0, 0.05, 0.4), ("b", 1.0, 0.2, 0.9), ("c", 1.0, 0.05, 0.9), ("d", 0.5, 0.05, 0.9)]
    got = {r["topic"]: r["share"] for r in A.clamp_shares(spark.createDataFrame(rows, "topic string, weight double, floor double, ceiling double")).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-5)
    assert got["a"] <= 0.4 + 1e-6 and got["b"] >= 0.2 - 1e-6


def test_empty_tables_give_empty_results(spark):
    e = spark.createDataFrame([], "user_id long, ts timestamp, v long")
    assert R.asof_join(e.drop("v"), e, by="user_id", on="ts", value="v").count() == 0
    assert D.boilerplate(spark.createDataFrame([], "host string, page_id long, line string")).count() == 0


def test_common_words_still_give_candidates(spark):
    names = [f"steel bolt{i}" for i in range(300)] + ["Steel", "steel", "xy", "xy", "other thing"]
    data = [(i, n, "k") for i, n in enumerate(names)] + [(400, "steel", "another kind")]
    e = spark.createDataFrame(data, "id long, name string, kind string")
    assert G.blocking(e, common=12).where("a < 300").count() == 0  # the capped pairs lose them all
    words = {i: set(n.lower().split()) - {"xy"} for i, n, _ in data}
    want = {}
    for i, n, k in data:
        others = [(m.lower() != n.lower(), j) for j, m, q in data if q == k and j != i and (m.lower() == n.lower() or words[i] & words[j])]
        want[i] = [j for _, j in sorted(others)[:25]]
    assert {r["id"]: r["others"] for r in G.candidates(e).collect()} == want
    members = {(r["kind"], r["word"], r["id"]): r["members"] for r in G.blocks(e).collect()}
    assert len(members) == sum(map(len, words.values())) and members["k", "steel", 0] == 302


@pytest.mark.parametrize("above, block", [(0.95, 16), (0.8, 16), (0.3, 16), (0.95, 2048), (-0.5, 32)])
def test_nearest_earlier(spark, above, block):
    """Clusters, copies, a zero and a null vector: no pair above the threshold is lost, however small the blocks."""
    import numpy as np

    rng = np.random.default_rng(int(abs(above) * 100) + block)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 6)) * 0.12
    x[40], x[41], x[200] = x[7], x[7], 0.0
    ids = rng.permutation(300) * 3
    rows = [(int(i), [float(a) for a in v]) for i, v in zip(ids, x)] + [(5000, None)]
    got = {r["chunk_id"]: (r["earlier"], r["similarity"]) for r in D.nearest_earlier(spark.createDataFrame(rows, "chunk_id long, v array<double>").repartition(3), above, block, pivots=9).collect()}
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    sim = np.round(u @ u.T, 6)
    want = {}
    for i in range(300):
        best = max(((sim[i, j], -ids[j]) for j in range(300) if ids[j] < ids[i]), default=None)
        if best and best[0] > above:
            want[int(ids[i])] = (int(-best[1]), float(best[0]))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_far_blocks_do_not_meet(spark):
    """Of clusters far apart, few pairs of blocks are multiplied."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(16), 64, axis=0) + rng.normal(size=(1024, 16)) * 0.01
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "chunk_id long, v array<double>")
    found = D.nearest_earlier(df, 0.95, 32, pivots=40)
    assert found.count() == 1024 - 16  # all but each cluster's first


def test_shingles_split_a_text_once(spark):
    """The words are bound once, not split again for every shingle."""
    c = S.shingles(F.col("text"))
    words = [f"W{i % 700}" for i in range(900)]
    text = spark.createDataFrame([(0, " ".join(words)), (1, "one two"), (2, "")], "id long, text string")
    frame = text.select("id", c.alias("s"))
    assert frame._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
    got = {r["id"]: r["s"] for r in frame.collect()}
    low = [w.lower() for w in words]
    assert got[0] == list(dict.fromkeys(" ".join(low[i : i + 5]) for i in range(896))) and got[1] == got[2] == []


def test_blocking_gives_every_pair(spark):
    """Out of representatives and membership come exactly the pairs that share a word, however common it is."""
    rng = random.Random(5)
    data = [(i, " ".join(rng.choices(["red", "blue", "old", "ring", "rod", "xy", "Rod"], k=rng.randrange(4))), rng.choice("kl")) for i in range(120)]
    words = {i: {w.lower() for w in n.split() if len(w) > 2} for i, n, _ in data}
    kind = {i: k for i, _, k in data}
    rows = G.blocking(spark.createDataFrame(data, "id long, name string, kind string")).collect()
    head = {i: i for i in words} | {r["b"]: r["a"] for r in rows if r["same"]}
    met = {(r["a"], r["b"]): r["shared"] for r in rows if not r["same"]}
    for i in words:
        for j in range(i + 1, 120):
            a, b = sorted((head[i], head[j]))
            got = len(words[i]) if a == b else met.get((a, b), 0)
            assert got == (len(words[i] & words[j]) if kind[i] == kind[j] else 0)


def test_candidates_are_found_once_a_name(spark):
    """Copies of a name don't multiply the rows that are met: a thousand entities of two names make a few dozen."""
    e = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "Red bolt").otherwise("red rod").alias("name"), F.lit("k").alias("kind"))
    made = G.candidates(e)
    got = {r["id"]: r["others"] for r in made.collect()}
    for i in (0, 1, 30, 999):
        want = sorted((j % 2 != i % 2, j) for j in range(1000) if j != i)
        assert got[i] == [j for _, j in want[:25]]
    assert "salt" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert G.candidates(spark.createDataFrame([(1, None, "k"), (2, " ", "k"), (3, "AB", "k"), (4, "ab ", "k")], "id long, name string, kind string")).orderBy("id").collect() == [(1, []), (2, []), (3, [4]), (4, [3])]
