"""Passages, names, areas, searches and routes: small awkward tables, and brute force where SQL has no word for it."""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspark.checkpoints import checkpoint
from marlspark.functions import names as N
from marlspark.operators import areas as A
from marlspark.operators import harvest as H
from marlspark.operators import lexical as L
from marlspark.operators import pairing as P
from marlspark.operators import passages as T
from marlspark.operators import standing as W
from marlspark.plans import standing_queries as Q
from marlspark.sources import corpus as C


def made_text(r: random.Random) -> str:
    word = lambda: r.choice(["a", "bridge", "Toll", "12.5", "ü", "x" * r.choice([3, 30, 2500])] if r.random() < 0.02 else ["a", "bridge", "Toll", "12.5", "ü"])
    parts = []
    for _ in range(r.randrange(0, 9)):
        kind = r.randrange(4)
        if kind == 0:
            parts.append("# " + word())
        elif kind == 1:
            parts.append(" ".join(word() + r.choice(["", "", ".", "!"]) for _ in range(r.randrange(1, 900))))
        elif kind == 2:
            parts.append("\n".join("| " + " | ".join(word() for _ in range(4)) + " |" if r.random() < 0.8 else "| | nan | - |" for _ in range(r.randrange(1, 200))))
        else:
            parts.append(" \t ")
    return r.choice(["", "\n", "  "]) + r.choice(["\n\n", "\n \n\n"]).join(parts)


def test_passages_hold_all_but_empty_rows():
    r = random.Random(4)
    for _ in range(300):
        text = made_text(r)
        got = T.spans(text)
        assert all(0 <= a < b <= len(text) and b - a <= T.MOST and text[a:b] == text[a:b].strip() for a, b in got)
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
        ends = [0, *(x for s in got for x in s), len(text)]
        for a, b in zip(ends[::2], ends[1::2]):  # what lies between passages is white space or rows without content
            assert not re.sub(r"(?m)^\s*\|(\s*(nan|-)?\s*\|)+\s*$", "", text[a:b]).strip(), text[a:b]
        # two neighbours that fit into the aim together stay apart only where something keeps them apart
        small = [b - a for a, b in got if b - a < T.LEAST]
        assert len(small) <= max(1, len(got) // 2 + 1)


def test_passages_of_known_texts():
    assert T.spans(None) == T.spans("") == T.spans(" \n\n ") == []
    assert T.spans("# Title\n\n" + "a" * 500) == [(0, 509)]
    assert T.spans("a" * 700 + "\n\n" + "b" * 700) == [(0, 700), (702, 1402)]
    assert T.spans("a" * 1190 + "\n\n" + "b" * 50) == [(0, 1242)]  # too short to stand alone
    long = "One two three. " * 200  # one paragraph, cut where sentences begin
    assert all(long[a:b].endswith(".") and b - a <= T.TARGET for a, b in T.spans(long))
    assert [b - a for a, b in T.spans("x" * 4500)] == [2000, 2000, 500]
    with pytest.raises(ValueError):
        T.spans("a", target=10, most=5)


def test_passages_of_a_table(spark):
    rows = [(1, "x" * 4500, "q"), (2, None, "q"), (3, "  ", "q"), (4, "one\n\ntwo", "q"), (4, "one\n\ntwo", "q")]
    t = spark.createDataFrame(rows, "id long, text string, place string")
    got = sorted((r["id"], r["place"], r["start"], len(r["text"])) for r in T.passages(t, "id").collect())
    assert got == [(1, 0, 0, 2000), (1, 1, 2000, 2000), (1, 2, 4000, 500), (4, 0, 0, 8), (4, 0, 0, 8)]
    pages = spark.createDataFrame([(1, 2, "second"), (1, 1, "first\n\n" + "y" * 1500), (2, 1, None)], "id long, page int, text string")
    assert sorted((r["id"], r["page"], r["place"], r["text"][:5]) for r in T.page_passages(pages, "id").collect()) == [(1, 1, 0, "first"), (1, 2, 1, "secon")]


def test_definitions():
    assert H.definitions("The Land Transport Authority (LTA) and the Agency for Science, Technology and Research (ASTR).") == [("LTA", "Land Transport Authority"), ("ASTR", "Agency for Science, Technology and Research")]
    assert H.definitions("It ended. Board (B) of Old Roads (OR), the Urban Roads Board's (URB)") == [("OR", "Old Roads"), ("URB", "Urban Roads Board")]
    for none in [None, "", "(LTA)", "Land: Transport Authority (LTA)", "Land Transport. Authority (LTA)", "land transport authority (lta)", "Long (LONG)", "a b (A B)"]:
        assert H.definitions(none) == []
    many = "Land Transport Authority (LTA), " * 20000  # time in proportion to the text
    assert H.definitions(many) == [("LTA", "Land Transport Authority")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("title, want", [
    ("  A  study of roads ", "A study of roads"), ("A study | Acme", "A study"), ("Home | Acme", None), ("report.PDF", None), (None, None), ("ab", None),
    ("Untitled document", None), ("2.3Methods of old", "Methods of old"), ("A - B - acme.org", "A - B"), ("Microsoft Word - x", None), ("www.acme.org", None),
])
def test_titles(spark, title, want):
    assert one(spark, N.clean_title(F.lit(title).cast("string"), F.lit("Acme"), F.lit("www.acme.org"))) == want


@pytest.mark.parametrize("name, want", [("Ministry of Works", "agency"), ("Changi Station", "infrastructure"), ("base station", "concept"), ("true positive rate", "metric"), ("", "concept"), ("of Works Act", "scheme"), (None, "concept")])
def test_kinds(spark, name, want):
    assert one(spark, N.entity_kind(F.lit(name).cast("string"))) == want


def test_language(spark):
    en, de = "This is the house of the man that would have been there and not with them. " * 5, "Das ist nicht der Mann, den die Frau und das Kind mit dem Hund sind. " * 5
    rows = [(en, "en"), (de, "de"), (en + de, None), (en[:60], None), ("1" * 900 + en[:300], None), ("x " * 300, None), (None, None)]
    t = spark.createDataFrame(rows, "text string, want string")
    assert all(r["got"] == r["want"] for r in t.select("want", N.language(F.col("text")).alias("got")).collect())


def test_searches(spark):
    rows = [(1, "Toll roads, toll bridges"), (2, "the toll road"), (3, "Roads (toll)"), (4, None), (5, ""), (6, "c++ roads toll roads")]
    t = spark.createDataFrame(rows, "chunk_id long, text string")
    find = lambda **k: [r[0] for r in t.where(L.matches(F.col("text"), L.Terms(**k))).orderBy("chunk_id").collect()]
    assert find(words=("toll", "roads")) == [1, 3, 6] and find(phrases=("toll roads",)) == [1, 6] and find(words=("toll",), without=("roads",)) == [2]
    assert find(either=(("bridges", "the toll"),)) == [1, 2] and find() == [1, 2, 3, 4, 5, 6]
    table = {(r["word"], r["chunk_id"]): (r["tf"], r["length"]) for r in L.postings(t).collect()}
    assert table == {("toll", 1): (2, 4), ("roads", 1): (1, 4), ("bridges", 1): (1, 4), ("toll", 2): (1, 2), ("road", 2): (1, 2), ("roads", 3): (1, 2), ("toll", 3): (1, 2), ("c", 6): (1, 4), ("roads", 6): (2, 4), ("toll", 6): (1, 4)}
    assert L.extent(t) == (4, 3.0) and L.extent(t.limit(0)) == (0, 1.0)
    got = L.bm25(L.postings(t), *L.extent(t), ["toll", "roads"]).collect()

    def score(tf, df, n):
        return math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 3))

    want = {1: score(2, 4, 4) + score(1, 3, 4), 3: score(1, 4, 2) + score(1, 3, 2), 6: score(1, 4, 4) + score(2, 3, 4)}
    assert {r["chunk_id"]: r["score"] for r in got} == pytest.approx(want, abs=2e-6)
    assert [r["chunk_id"] for r in got] == sorted(want, key=lambda i: -want[i])


def test_wide_arm(spark):
    t = spark.createDataFrame([(1, "数据搜索"), (2, "搜索 数据"), (3, "数 据搜索"), (4, None)], "chunk_id long, text string")
    assert [tuple(r) for r in L.wide_arm(t, "数据 and 搜索").collect()] == [(1, 2), (2, 2)]
    assert L.wide_arm(t, "latin").collect() == []


def test_area_names(spark):
    rows = [(1, 10, None, ["data", "roads", "open data"]), (1, 11, None, ["open data", "tolls", "roads"]), (1, 12, None, ["open data", "roads"]), (1, 13, "Law", ["x"]), (1, 14, "Law", ["y"]), (2, 10, None, ["tax"]), (2, 15, None, []), (2, 16, None, [])]
    t = spark.createDataFrame(rows, "shown int, area int, field string, terms array<string>")
    got = {(r["shown"], r["area"]): r["name"] for r in A.area_names(t).collect()}
    assert got == {(1, 10): "Open data (roads)", (1, 11): "Open data (tolls)", (1, 12): "Open data", (1, 13): "Law", (1, 14): "Law", (2, 10): "Tax", (2, 15): None, (2, 16): None}


def unit(m):
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def table(spark, sf_dir):
    e = C.vectors(spark, sf_dir).orderBy("chunk_id").toPandas()
    return e["chunk_id"].to_numpy(), e["topic"].to_numpy(), np.stack(e["v"])


def test_headline_topics_by_numpy(spark, sf_dir):
    ids, topic, v = table(spark, sf_dir)
    u, want = unit(v), {}
    away = unit(v[topic == 9].mean(0))
    for t in range(5):
        even, odd = (topic == t) & (ids % 2 == 0), (topic == t) & (ids % 2 == 1)
        if not even.any():
            continue
        s = np.round(u @ unit(v[even].mean(0)), 6)
        gain = np.round(u @ unit(v[odd].mean(0)) - u @ away, 6) if t and odd.any() else None
        ok = s >= A.FLOOR_ALONE if gain is None else (s >= A.FLOOR) & (gain >= A.LEAD)
        want |= {(int(i), t): float(x) for i, x in zip(ids[ok], s[ok])}
    got = {(r["id"], r["topic"]): r["score"] for r in Q.headlines(spark, sf_dir).collect()}
    assert want and got == pytest.approx(want, abs=2e-6)


def test_labels_by_numpy(spark, sf_dir):
    ids, topic, v = table(spark, sf_dir)
    areas, names = np.unique(ids % 60), np.unique(topic)
    c, w = np.stack([v[ids % 60 == a].mean(0) for a in areas]), np.stack([v[topic == t].mean(0) for t in names])
    sims = np.round(unit(c - c.mean(0)) @ unit(w - w.mean(0)).T, 6)
    want = {}
    for a, row in zip(areas, sims):
        s = np.sort(row)[::-1]
        if s[0] >= A.LABEL_SURE or (s[0] >= A.LABEL_FLOOR and s[0] - s[min(2, len(s) - 1)] >= A.LABEL_LEAD):
            want[int(a)] = int(names[row.argmax()])
    got = {r["area"]: r["label"] for r in Q.labels(spark, sf_dir).collect()}
    assert want and got == want


def test_lists_that_go_to_all_tasks_are_bounded(spark):
    many = spark.range(A.MOST_LISTED + 1).select(F.col("id").alias("label"), F.array(F.lit(1.0)).alias("v"))
    with pytest.raises(ValueError):
        A.fitting_labels(spark.range(1).select(F.col("id").alias("area"), F.array(F.lit(1.0)).alias("v")), many)


def test_matching_by_walking_down(spark):
    r = random.Random(7)
    rows = [(i, j, round(r.choice([0.5, 0.9, 0.95, r.random()]), 2)) for i in range(25) for j in range(20) if r.random() < 0.6]
    t = spark.createDataFrame(rows, "new long, old long, similarity double")
    want, a, b = [], set(), set()
    for i, j, s in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if s >= A.SAME_AREA and i not in a and j not in b:
            want.append((i, j, s))
            a.add(i)
            b.add(j)
    assert sorted(tuple(x) for x in A.matched(t, checkpoint).collect()) == sorted(want)
    assert A.matched(t.limit(0), checkpoint).count() == 0


def walked_down(news, olds, span=20000):
    """All pairs of a part, best first, walked down in memory; halves round up, in decimals as printed; what is not a number is above all, and given as infinite."""
    rows = []
    for (i, p, x), (j, q, y) in ((a, b) for a in news for b in olds):
        if None not in (x, y) and p == q:
            s = 1 - abs(x - y) / span
            s = math.inf if math.isnan(s) else float(Decimal(repr(s)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) if math.isfinite(s) else s
            if s >= A.SAME_AREA:
                rows.append((i, j, s))
    want, a, b = [], set(), set()
    for i, j, s in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if i not in a and j not in b:
            want.append((i, j, s))
            a.add(i)
            b.add(j)
    return sorted(want)


@pytest.mark.parametrize("seed, n, m, wide, values, rows", [(1, 60, 90, 300, 10_000, 8), (2, 80, 40, 9000, 10_000, 12), (3, 50, 120, 9000, 15, 30), (4, 40, 40, 30, 8, 5), (5, 70, 70, 40_000, 60, 6)])
def test_tiles_give_what_the_walk_gives(spark, seed, n, m, wide, values, rows):
    r = random.Random(seed)
    at = [round(r.uniform(-wide / 10, wide), 2) for _ in range(values)]
    news, olds = [(i * 7 % 1009, r.randrange(2), r.choice(at)) for i in range(n)], [(i, r.randrange(2), r.choice(at)) for i in range(m)]
    if seed == 2:  # ids that rise along the line hang on each other from end to end
        news = [(i, p, x) for i, (_, p, x) in enumerate(sorted(news, key=lambda t: t[2]))]
    if seed in (2, 4):
        news += [(5000, 0, None), (5001, 1, math.nan), (5002, 0, math.inf), (5003, 1, -math.inf)]
        olds += [(6000, 1, math.nan), (6001, 0, math.inf), (6002, 1, math.inf), (6003, 0, None)]
    frames = [spark.createDataFrame(t, f"{name} long, part int, at double") for name, t in (("new", news), ("old", olds))]
    got = sorted((a, b, math.inf if math.isnan(s) else s) for a, b, s in P.nearest_matched(*frames, checkpoint, span=20000, rows=rows).collect())
    assert got and got == walked_down(news, olds)


def test_an_id_in_several_places_is_taken_once(spark):
    news, olds = [(1, 0, 0.0), (1, 1, 0.0), (1, 0, 0.0), (2, 0, 3.0)], [(1, 0, 0.0), (2, 0, 1.0), (3, 1, 0.0)]
    frames = [spark.createDataFrame(t, f"{name} long, part int, at double") for name, t in (("new", news), ("old", olds))]
    assert sorted(tuple(x) for x in P.nearest_matched(*frames, checkpoint, span=20000).collect()) == [(1, 1, 1.0), (2, 2, 0.9999)] == walked_down(news, olds)
    assert P.nearest_matched(frames[0].limit(0), frames[1], checkpoint, span=20000).count() == 0


def test_levels_are_those_of_rounded_likeness(spark):
    far = P.levels(4, 0.9)
    pairs = [(a, a + 2 * k + 1 + d) for k in range(1010) for a, d in ((0.0, 0.0), (100.1, 0.0), (-7.37, 0.01), (8000.3, -0.01))]
    got = spark.createDataFrame(pairs, "x double, y double").select("x", "y", P.similarity(F.col("x"), F.col("y"), 20000, 4).alias("s")).collect()
    assert len(far) == 1001 and all(bisect_left(far, abs(r["x"] - r["y"]) / 20000 - 1) == min(round((1 - r["s"]) * 10_000), 1001) for r in got)


def test_equal_places_are_not_taken_one_a_round(spark, tmp_path, monkeypatch):
    suppliers, customers = [(i, 3, 100.0 + i % 2) for i in range(30)], [(i, 3, 100.0) for i in range(40)] + [(90, 4, 100.0)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    written = []
    monkeypatch.setattr(Q, "checkpoint", lambda df: written.append(1) or checkpoint(df))
    assert sorted(tuple(r) for r in Q.kept_places(spark, str(tmp_path)).collect()) == walked_down(suppliers, customers)
    assert len(written) <= 4  # it was two for each of the pairs


def best_route(cited, similar, start, goal, depth):
    """Level by level in memory: {node: (similar hops, -score, from, kind, route)}."""
    steps = [(x, y, kind, s) for kind, links in (("cited", cited), ("similar", similar)) for a, b, s in links for x, y in ((a, b), (b, a))]
    seen, front = {start}, {start: (0, ())}
    for _ in range(depth):
        reached = {}
        for x, y, kind, s in steps:
            if x in front and y not in seen:
                rank = (front[x][0] + (kind == "similar"), -s, x, kind)
                if y not in reached or rank < reached[y][0]:
                    reached[y] = (rank, front[x][1] + ((x, y, kind, s),))
        seen |= set(reached)
        front = {y: (rank[0], way) for y, (rank, way) in reached.items()}
        if goal in front:
            return list(front[goal][1])
    return []


def test_mixed_routes_by_brute_force(spark, sf_dir):
    cited, similar = C.links(spark, sf_dir).select("a", "b", "support"), Q.likeness(spark, sf_dir)
    rows = [[tuple(r) for r in t.collect()] for t in (cited, similar)]
    start, goal = Q.route_ends(cited)
    got = [(r["src"], r["dst"], r["kind"], r["score"]) for r in Q.mixed(spark, sf_dir).orderBy("step").collect()]
    assert got and got == [(a, b, k, float(s)) for a, b, k, s in best_route(*rows, start, goal, 6)]
    small = lambda rows: spark.createDataFrame(rows, "a string, b string, score double")
    c, s = [("x", "y", 1.0), ("y", "z", 2.0), ("u", "v", 1.0)], [("x", "w", 0.9), ("w", "z", 0.99), ("z", "q", 0.5)]
    find = lambda a, b, depth=4: [(r["src"], r["dst"], r["kind"]) for r in W.mixed_route(small(c), small(s), a, b, depth, checkpoint).orderBy("step").collect()]
    assert find("x", "z") == [("x", "y", "cited"), ("y", "z", "cited")]  # as short as the similar one, but cited
    assert find("x", "q") == [("x", "y", "cited"), ("y", "z", "cited"), ("z", "q", "similar")]
    assert find("x", "v") == find("x", "x") == find("x", "q", 2) == []


def test_guarded_sql(spark):
    spark.range(5).createOrReplaceTempView("five")
    five = lambda q, n=200: W.guarded_sql(spark, q, n, ["five"])
    rows, more = five("select id from five where id < 4;", 3)
    assert rows.count() == 3 and more
    rows, more = five("WITH t AS (SELECT id FROM five) SELECT * FROM t", 10**9)
    assert rows.count() == 5 and not more
    assert five("select 'drop; delete' as `update`, (select max(id) from Five) as m from five where id in (select id from five) limit 1")[0].collect()[0].m == 4
    for bad in [
        "", " ; ", "select 1; select 2", "drop table five", "explain select 1", "select * from six", "with t as (select 1) insert into five select * from t",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "select reflect('java.lang.System', 'getProperty', 'user.home')", "select TRY_REFLECT('java.lang.System', 'exit')",
        "select id from five where id = (select java_method('java.lang.System', 'nanoTime'))", "with t as (select java_method('java.lang.System', 'nanoTime') as x) select 1 from five",
        "select * from parquet.`/root/testdata/sf0.001/nation.parquet`", "select * from five join text.`/etc/passwd` on true", "select 1 from five where exists (select * from csv.`/etc/passwd`)",
        "select IDENTIFIER('java_' || 'method')('java.lang.System', 'nanoTime')", "select * from IDENTIFIER('parq' || 'uet.`/tmp`')", "select * from default.five", "select * from five, lateral (select * from text.`/etc/passwd`)",
        "select /* x */ java_method /* y */ ('java.lang.System', 'nanoTime') from five", "select transform(id) using 'cat' from five", "select system.builtin.reflect('java.lang.System', 'nanoTime')",
    ]:
        with pytest.raises(W.Refused):
            five(bad)


def test_trust_of_small_tables(spark):
    rows = [("a", i, False, False) for i in range(5)] + [("b", 1, True, False), *(("b", i, False, True) for i in range(2, 9)), ("c", 1, False, True), ("c", 2, True, False), ("d", 1, False, False), ("e", 1, False, True)]
    t = spark.createDataFrame(rows, "domain string, at long, flagged boolean, mapped boolean")
    got = {r["domain"]: (r["state"], r["clean_fetches"]) for r in W.trust(t, spark.createDataFrame([("e",), ("e",)], "domain string")).collect()}
    assert got == {"a": ("cleared", 5), "b": ("quarantined", 7), "c": ("cleared", 0), "d": ("unscreened", 1), "e": ("rejected", 0)}


def test_a_definition_far_from_its_bracket():
    far = "Land" + " " * 5000 + "Transport" + "\n" * 1 + " " * 3000 + "Authority (LTA)"
    assert H.definitions(far) == [("LTA", "Land Transport Authority")]
    assert H.definitions("y" * 9000 + " Urban Redevelopment Authority (URA)") == [("URA", "Urban Redevelopment Authority")]
    assert H.definitions("word " * 4000 + "Bus Rapid Transit (BRT)") == [("BRT", "Bus Rapid Transit")]


def test_paths_of_a_deep_tree(spark):
    rows = [(1, None), *((i, i - 1) for i in range(2, 14)), (50, 3), (60, 61), (61, 60), (70, 99)]
    got = {r["area"]: r["path"] for r in A.paths(spark.createDataFrame(rows, "area long, parent long")).collect()}
    want = {i: list(range(1, i + 1)) for i in range(1, 14)} | {50: [1, 2, 3, 50]}
    assert got == want  # a circle, and a parent that isn't there, have no top
