"""Names that are nearly alike, and mentions resolved to entities, against plain readings of the rules."""

from __future__ import annotations

import difflib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from marlspark.operators import resolution as R
from marlspark.sources import corpus as C


def exact(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def brute_pairs(names, least):
    by = {}
    for kind, name in names:
        if name:
            by.setdefault(kind, set()).add(name)
    return {(kind, a, b): exact(a, b) for kind, own in by.items() for a in own for b in own if a < b and exact(a, b) >= least}


def made_names(n, seed):
    r = random.Random(seed)
    syllables = ["an", "ber", "co", "dal", "é", "fin", "gra", "ho", " ", "ing", "aa", "1", "-"]
    out = []
    for _ in range(n):
        name = "".join(r.choice(syllables) for _ in range(r.randrange(1, 12)))
        out.append((r.choice("xy"), name))
        for _ in range(r.randrange(3)):
            i = r.randrange(len(name) + 1)
            out.append((r.choice("xy"), r.choice([name[:i] + name[i + 1 :], name[:i] + r.choice("abz ") + name[i:], name + name[-2:], name[::-1], name.upper()])))
    return out


@pytest.mark.parametrize("least", [0.6, 0.85, 0.97])
def test_no_similar_pair_is_lost(spark, least):
    names = made_names(160, int(least * 100)) + [("x", None), ("x", ""), (None, "anber"), ("x", "a"), ("x", "b"), ("x", "ab"), ("y", "aaaaaaaaaa"), ("y", "aaaaaaaaab"), ("y", "aaaaaaaaaa")]
    got = R.similar_names(spark.createDataFrame(names, "kind string, name string"), least).collect()
    want = {k: v for k, v in brute_pairs(names, least).items() if k[0] is not None}
    assert len(got) == len({tuple(r)[:3] for r in got}) and {tuple(r)[:3]: r["ratio"] for r in got} == want
    assert want or least == 1.0


def test_similar_names_of_parts(spark, sf_dir):
    """No pair is lost against all pairs of the table's distinct names."""
    parts = C.table(spark, sf_dir, "part").select(F.lit(1).alias("kind"), F.col("p_name").alias("name"))
    want = brute_pairs([tuple(r) for r in parts.collect()], 0.8)
    assert want and {tuple(r)[:3]: r["ratio"] for r in R.similar_names(parts, 0.8).collect()} == want


def test_the_joined_pairs_are_few(spark):
    """Long names share a rare pair of letters only if they are alike: the ratio is computed for a small part of all pairs."""
    r = random.Random(3)
    names = [(1, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))) for _ in range(1500)]
    names += [(1, n[:5] + "q" + n[6:]) for _, n in names[:40]]
    df = spark.createDataFrame(names, "kind int, name string")
    calls = []
    plain = R.ratio
    R.ratio = lambda a, b: calls.append(1) or plain(a, b)
    try:
        found = R.similar_names(df, 0.9)
    finally:
        R.ratio = plain
    assert {tuple(x)[1:3] for x in found.collect()} >= {tuple(sorted((n, n[:5] + "q" + n[6:]))) for _, n in names[:40] if n[5] != "q"}
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in joined and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_ratio_is_that_of_matching_blocks(spark):
    r = random.Random(1)
    pairs = [("".join(r.choice("abc ") for _ in range(r.randrange(300))), "".join(r.choice("abc ") for _ in range(r.randrange(300)))) for _ in range(60)] + [("", ""), (None, "a"), ("a", None), ("abcd", "bcde")]
    got = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a:string,b:string>").select("i", R.ratio(F.col("p.a"), F.col("p.b")).alias("r")).collect()
    assert {x["i"]: x["r"] for x in got} == {i: None if a is None or b is None else exact(a, b) for i, (a, b) in enumerate(pairs)}


# ---- mentions


def normal(name, table):
    flat = "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c))
    tokens = " ".join(table.get(t, t) for t in re.sub(r"[^\w\s]", " ", flat).split()).split()
    return [t for t in tokens if t not in R.NOISE] or tokens


def likeness(a, b):
    x, y = set(a), set(b)
    return 0.0 if not x or not y else 0.75 * len(x & y) / len(x | y) + 0.25 * exact(" ".join(a), " ".join(b))


def brute_resolve(mentions, entities, table, near, limit):
    out, new = {}, {}
    for m, name, kind, where, v in mentions:
        name = (name or "").strip()
        if not name:
            out[m] = (None, None, "refused", None, None)
            continue
        plain, long = normal(name, {}), normal(name, table)
        tokens = {t for t in plain + long if len(t) > 2}
        live = [e for e in entities if e[2] == kind and e[4] is None and e[1] and e[1].strip()]
        hits = [(e[1].strip().lower() != name.lower(), e[0]) for e in live if e[1].strip().lower() == name.lower() or tokens & set(normal(e[1], {}))]
        order = [i for _, i in sorted(hits)[:limit]]
        order += sorted(i for q, i in near if q == m and i not in order and any(e[0] == i for e in live))
        best = None
        for i in order:
            e = next(e for e in live if e[0] == i)
            if where and e[3] and where.lower() != e[3].lower():
                continue
            signals = [(likeness(long, normal(e[1], table)), 0.3)]
            if v and e[5] and len(v) == len(e[5]):
                signals.append((max(0.0, min(1.0, sum(a * b for a, b in zip(v, e[5])))), 0.3))
            score = sum(s * w for s, w in signals) / sum(w for _, w in signals)
            if best is None or score > best[0]:
                best = (score, i)
        kind_of = "separate" if best is None or best[0] < 0.55 else "merge" if best[0] >= 0.9 else "adjudicate"
        key = (name.lower(), kind, (where or "").lower())
        if kind_of != "merge":
            new[key] = min(m, new.get(key, m))
        out[m] = (best[1] if kind_of == "merge" else None, key if kind_of != "merge" else None, kind_of, best and best[0], best[1] if best and kind_of != "separate" else None)
    return {m: (e, new.get(k), b, s, c) for m, (e, k, b, s, c) in out.items()}


MENTION = "mention_id long, name string, kind string, jurisdiction string, v array<double>"
ENTITY = "entity_id long, name string, kind string, jurisdiction string, redirects_to long, v array<double>"


@pytest.mark.parametrize("limit", [3, 25])
def test_resolution(spark, limit):
    r = random.Random(limit)
    words = ["Land", "Transport", "Authority", "the", "of", "Éco", "City", "LTA", "HDB", "Board", "Bo", "Ltd", "Housing", "&"]
    name = lambda: r.choice(["", " "]) + " ".join(r.choice(words) for _ in range(r.randrange(1, 4))) + r.choice(["", ".", ", Ltd"])
    vec = lambda: r.choice([None, [1.0, 0.0], [0.6, 0.8], [1.0], [0.0, -1.0]])
    entities = [(i, name(), r.choice("ab"), r.choice([None, "", "SG", "gb"]), r.choice([None, None, None, 3]), vec()) for i in range(60)] + [(60, None, "a", None, None, None), (61, "", "a", None, None, None)]
    mentions = [(i, name(), r.choice("ab"), r.choice([None, "sg", "GB", ""]), vec()) for i in range(250)] + [(250, None, "a", None, None), (251, "  ", "a", None, None), (252, "nothing like it", "a", None, [1.0, 0.0]), (253, "Nothing Like it", "a", "", None), (254, "x", "c", None, None)]
    table = {"lta": "land transport authority", "hdb": "housing board"}
    near = [(r.randrange(255), r.randrange(60)) for _ in range(200)]
    got = R.resolved(
        spark.createDataFrame(mentions, MENTION), spark.createDataFrame(entities, ENTITY), spark.createDataFrame(list(table.items()), "short string, long string"),
        spark.createDataFrame(near, "mention_id long, entity_id long").distinct(), limit,
    ).collect()
    want = brute_resolve(mentions, entities, table, set(near), limit)
    assert len(got) == len(want)
    for x in got:
        e, key, kind, score, candidate = want[x["mention_id"]]
        assert (x["entity_id"], x["new_key"], x["band"], x["candidate_id"]) == (e, key, kind, candidate), (x, want[x["mention_id"]])
        assert (x["score"] is None) == (score is None) and (score is None or abs(x["score"] - score) < 1e-12)
    assert {x["band"] for x in got} == {"merge", "adjudicate", "separate", "refused"}
    plain = R.resolved(spark.createDataFrame(mentions, MENTION), spark.createDataFrame(entities, ENTITY), limit=limit).collect()
    assert {x["mention_id"]: x["band"] for x in plain} == {m: w[2] for m, w in brute_resolve(mentions, entities, {}, set(), limit).items()}
    none = spark.createDataFrame([], ENTITY)
    assert {x["band"] for x in R.resolved(spark.createDataFrame(mentions, MENTION), none).collect()} == {"separate", "refused"}
    assert R.resolved(spark.createDataFrame([], MENTION), spark.createDataFrame(entities, ENTITY)).collect() == []


def test_entities_take_mentions_in(spark):
    entities = spark.createDataFrame([(1, "Alpha", ["A"], [5, 7]), (2, "Beta", None, None), (3, "C", [], [1])], "entity_id long, name string, aliases array<string>, chunks array<long>")
    mentions = spark.createDataFrame([(10, "ALPHA", [7, 9]), (11, "Alfa", [2]), (12, "alfa", None), (13, "a", [4]), (14, " The Beta ", [8]), (15, "Gone", [6])], "mention_id long, name string, chunks array<long>")
    found = spark.createDataFrame([(10, 1, "merge"), (11, 1, "merge"), (12, 1, "merge"), (13, 1, "merge"), (14, 2, "merge"), (15, None, "separate")], "mention_id long, entity_id long, band string")
    got = {r["entity_id"]: (r["aliases"], r["chunks"]) for r in R.taken_in(entities, mentions, found).collect()}
    assert got == {1: (["A", "Alfa"], [2, 4, 5, 7, 9]), 2: (["The Beta"], [8]), 3: ([], [1])}


@pytest.mark.parametrize("with_near", [False, True])
def test_every_entity_that_shares_a_word_is_met(spark, with_near):
    r = random.Random(9)
    words = ["Land", "Transport", "Authority", "Éco", "City", "LTA", "Board", "Housing"]
    name = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 4))) + r.choice(["", ".", ", Ltd"])
    vec = lambda: r.choice([None, [1.0, 0.0], [0.6, 0.8], [1.0]])
    # the one that a mention names stands behind all others that share a word with it
    entities = [(i, name(), r.choice("ab"), r.choice([None, "SG", "gb"]), None, vec()) for i in range(300)] + [(900, "Housing & Land Board Nine", "a", None, None, None), (901, "Housing & Land Board Nine", "a", None, None, None)]
    mentions = [(i, name(), r.choice("ab"), r.choice([None, "sg", "GB"]), vec()) for i in range(150)] + [(500, "The Housing and Land Board, Nine", "a", None, None)]
    table = {"lta": "land transport authority"}
    near = {(r.randrange(150), r.randrange(300)) for _ in range(100)} if with_near else set()
    got = R.resolved(
        spark.createDataFrame(mentions, MENTION), spark.createDataFrame(entities, ENTITY), spark.createDataFrame(list(table.items()), "short string, long string"),
        spark.createDataFrame(list(near), "mention_id long, entity_id long") if near else None,
    )
    got = {x["mention_id"]: x for x in got.collect()}
    want = brute_resolve(mentions, entities, table, near, 10**6)
    assert {m: (x["entity_id"], x["new_key"], x["band"], x["candidate_id"]) for m, x in got.items()} == {m: (e, k, b, c) for m, (e, k, b, _, c) in want.items()}
    assert all(abs(x["score"] - want[m][3]) < 1e-12 for m, x in got.items() if x["score"] is not None) and got[500]["entity_id"] == 900
