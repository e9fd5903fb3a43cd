"""Searches over a written index and the answer out of their hits, against plain readings of the rules."""

from __future__ import annotations

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marlspark.operators import answer as A
from marlspark.operators import fulltext as X
from marlspark.operators.lexical import STOP_WORDS

WORDS = ["bus", "lane", "toll", "the", "of", "bridge", "été", "rail", "fare", "in"]
TOKEN = re.compile("[a-z0-9à-öø-ÿß]+")


def texts(n, seed):
    r = random.Random(seed)
    return [(i, i % 7, "".join(r.choice(WORDS) + r.choice([" ", " ", ", ", "-", ". "]) for _ in range(r.randrange(25)))) for i in range(n)] + [(n, 3, None), (n + 1, 3, ""), (n + 2, 4, "the of in")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    data = texts(400, 3)
    df = spark.createDataFrame(data, "chunk_id long, source_id long, text string")
    return data, df, X.write_index(df, str(tmp_path_factory.mktemp("index") / "postings"), folders=4)


def clauses(question):
    """(wanted, words) of every alternative, read straight off the text."""
    if question.count('"') % 2:
        i = question.rindex('"')
        question = question[:i] + " " + question[i + 1 :]
    out, rest = [[]], question
    while rest := rest.lstrip():
        m = re.match(r'(-?)"([^"]*)"', rest) or re.match(r"(-?)(\S+)", rest)
        rest = rest[m.end() :]
        if m[0].lower() == "or":
            out.append([])
            continue
        words = TOKEN.findall(m[2].lower())
        if any(w not in STOP_WORDS for w in words):
            out[-1].append((not m[1], words))
    return [c for c in out if any(w for w, _ in c)]


def spots(words, tokens):
    """Where a phrase stands; stop words in it stand for any word."""
    at = [i for i, w in enumerate(words) if w not in STOP_WORDS]
    words = [w if i in at else None for i, w in enumerate(words)][at[0] : at[-1] + 1]
    return [i for i in range(len(tokens) - len(words) + 1) if all(w is None or tokens[i + k] == w for k, w in enumerate(words))]


def answers(question, text):
    tokens = TOKEN.findall((text or "").lower())
    return any(all(bool(spots(words, tokens)) == wanted for wanted, words in c) for c in clauses(question))


QUESTIONS = [
    "bus", "bus lane", '"bus lane"', '"bus the lane" toll', "bus -toll", 'rail or "toll bridge"', 'bus lane or fare -"rail bus"', "été", "BUS-lane", "-bus", "the of", "or bus or", '"bus lane', "nothing",
    'fare or fare', '-"the" bus', "", '""', "bus or -rail", "lane lane bus",
]


@pytest.mark.parametrize("question", QUESTIONS)
def test_matching(spark, corpus, question):
    data, _, index = corpus
    got = sorted(r["id"] for r in X.matching(spark, index, X.parse(question)).collect())
    assert got == [i for i, _, t in data if answers(question, t)]


def test_parse():
    assert X.parse("a the") == () and X.parse('-bus') == ()
    assert X.parse('bus "toll of bridge" -x-y') == ((X.Term((("bus", 0),)), X.Term((("toll", 0), ("bridge", 2))), X.Term((("x", 0), ("y", 1)), False)),)
    assert X.parse("bus or rail") == ((X.Term((("bus", 0),)),), (X.Term((("rail", 0),)),))
    assert X.parse("'; drop \\ ((") == ((X.Term((("drop", 0),)),),)


def plain_covers(question, text):
    """Every stretch that answers and holds no smaller one that does."""
    tokens = TOKEN.findall((text or "").lower())
    asked = {w for c in clauses(question) for wanted, words in c if wanted for w in words if w not in STOP_WORDS}
    ends = [i for i, t in enumerate(tokens) if t in asked]

    def holds(a, b):
        part = [t if a <= i <= b else "\x00" for i, t in enumerate(tokens)]
        return any(all(spots(words, part) for wanted, words in c if wanted) for c in clauses(question))

    good = [(a, b) for a in ends for b in ends if a <= b and holds(a, b)]
    least = [(a, b) for a, b in good if not any((c, d) != (a, b) and a <= c and d <= b for c, d in good)]
    return [(a, b, sum(a <= i <= b for i in ends)) for a, b in least]


def density(question, text):
    return sum(0.1 / (1 + max(0, b - a + 1 - n)) for a, b, n in plain_covers(question, text))


@pytest.mark.parametrize("question", ["bus", "bus lane", '"bus lane" toll', 'rail fare or "toll bridge"', "bus -toll"])
def test_lexical_ranks_by_cover_density(spark, corpus, question):
    data, _, index = corpus
    got = [(r["id"], round(r["score"], 6)) for r in X.lexical(spark, index, X.parse(question), limit=500).orderBy("rank").collect()]
    want = sorted(((i, round(density(question, t), 6)) for i, _, t in data if answers(question, t)), key=lambda x: (-x[1], x[0]))
    assert got == want and want
    few = spark.createDataFrame([(1,), (4,)], "source_id long")
    assert {r["id"] for r in X.lexical(spark, index, X.parse(question), few, limit=500).collect()} == {i for i, s, t in data if s in (1, 4) and answers(question, t)}


def test_only_the_folders_of_the_words_are_read(spark, corpus):
    _, _, index = corpus
    read = X.read(spark, index, ["bus"])
    assert len(read.inputFiles()) >= 1 and read.select("folder").distinct().count() == 1
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "PushedFilters: [IsNotNull(word)" in plan


# ---- pages


def plain_page(arms, texts, source, limit, cap, floor, flagged, decay, fold=True):
    words, near = arms
    kept = [(i, s) for i, s in near if floor is None or s >= floor]
    score = {}
    for ids in (words, [i for i, _ in kept]):
        for n, i in enumerate(ids, 1):
            score[i] = score.get(i, 0) + 1 / (60 + n)
    order = sorted(score, key=lambda i: (-score[i], i))
    first = order[:limit]
    order = [i for i in order if i not in flagged] + [i for i in order if i in flagged]
    into = {}
    if fold:
        grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - 4)}
        done = []
        for i in order:
            own = grams(texts[i])
            others = {}
            for k in done:
                if source[k] != source[i] and len(grams(texts[k])) >= 12:
                    others.setdefault(source[k], []).append(k)
            share = {s: len(own & set().union(*(grams(texts[k]) for k in ks))) for s, ks in others.items()}
            best = max(share, key=lambda s: share[s], default=None)
            if len(own) >= 12 and best is not None and share[best] >= 0.5 * len(own):
                host = max(others[best], key=lambda k: (len(own & grams(texts[k])), -done.index(k)))
                into[host] = into.get(host, 0) + 1
            else:
                done.append(i)
        order = done
    held = 0
    if cap:
        taken, over = [], []
        for i in order:
            (taken if sum(source[k] == source[i] for k in taken) < cap else over).append(i)
            if len(taken) == limit:
                break
        held = len(set(over) & set(order[:limit]))
        order = (taken + over)[:limit]
    order = order[:limit]
    worth = {i: round(score[i] * decay.get(source[i], 1.0), 8) for i in order}
    shown = sorted(order, key=lambda i: (i in flagged, -worth[i]))
    return [(i, worth[i], into.get(i, 0)) for i in shown], (len(near) - len(kept), near[0][1] if near else None, len((flagged & set(first)) - set(order)), sum(into.get(i, 0) for i in order), held)


@pytest.mark.parametrize("cap, floor, today", [(None, 0.55, None), (2, 0.2, "2024-02-01"), (1, None, None)])
def test_page(spark, tmp_path, cap, floor, today):
    r = random.Random(5)
    long = [" ".join(r.choice(["bus", "lane", "fare", "rail", f"w{k}"]) for k in range(30)) for _ in range(12)]
    cites = "\n".join(f"[{k}] A. Author bus lane. Journal of Fares, vol. {k}, 2019, pp. 1-9. doi:10.1000/{k}" for k in range(6))
    data = []
    for i in range(160):
        text = r.choice([*long, *(t + " bus more" for t in long), "bus lane short", cites, f"bus lane of {i} " * 3, "rail " + r.choice(long)[:90]])
        data.append((i, r.randrange(9), text))
    passages = spark.createDataFrame(data, "chunk_id long, source_id long, text string")
    vecs = [(i, s, [r.random(), r.random() - 0.5], len(t)) for i, s, t in data if r.random() < 0.7]
    vectors = spark.createDataFrame(vecs, "chunk_id long, source_id long, v array<double>, n_chars int")
    tiers = ["government", "news", "informal", "peer_reviewed"]
    sources = [(s, tiers[s % 4], "en" if s != 8 else "xx", "kept" if s != 7 else "junk", "cleared", dt.date(2015 + s, 1, 1) if s % 3 else None, ["t1"], f"h{s}") for s in range(9)]
    src = spark.createDataFrame(sources, "source_id long, tier string, language string, retention string, trust string, published date, topics array<string>, host string")
    index = X.write_index(passages, str(tmp_path / "p"), folders=2)
    asked = [1.0, 0.1]
    got = X.page(spark, index, passages, vectors, src, "bus lane", asked, cap=cap, limit=15, floor=floor, today=today, candidates=40).orderBy("place").collect()
    ok = {s for s, *_ in sources if s != 7}
    text, source = {i: t for i, _, t in data}, {i: s for i, s, _ in data}
    words = sorted(((-round(density("bus lane", t), 9), i) for i, s, t in data if s in ok and answers("bus lane", t)))
    cosine = lambda v: round(sum(a * b for a, b in zip(v, asked)) / (math.hypot(*v) * math.hypot(*asked)), 6)
    near = sorted(((-cosine(v), i) for i, s, v, n in vecs if s in ok and n >= 40))[:40]
    from marlspark.functions.text import reference_list

    flagged = {x["chunk_id"] for x in passages.where(reference_list(F.col("text"))).collect()}
    decay = {}
    if today:
        life = {"government": 3650, "news": 365, "informal": 180}
        for s, tier, _, _, _, published, *_ in sources:
            if published and tier in life:
                decay[s] = max(0.25, 0.5 ** (max(0, (dt.date(2024, 2, 1) - published).days) / life[tier]))
    want, figures = plain_page(([i for _, i in words][:40], [(i, -s) for s, i in near]), text, source, 15, cap, floor, flagged, decay)
    assert [(x["chunk_id"], x["score"], x["copies"]) for x in got] == want
    assert (got[0]["below_floor"], got[0]["nearest"], got[0]["set_back"], got[0]["folded"], got[0]["held_back"]) == figures
    assert figures[3] > 0 and flagged and got[0]["lexical_candidates"] == 40


def test_pages_without_an_arm(spark, corpus):
    _, df, index = corpus
    src = df.select("source_id").distinct().select("source_id", *(F.lit(v).alias(c) for c, v in [("tier", "news"), ("language", "en"), ("retention", "kept"), ("trust", "cleared"), ("host", "h")]), F.lit(None).cast("date").alias("published"), F.array(F.lit("t")).alias("topics"))
    none = spark.createDataFrame([], "chunk_id long, source_id long, v array<double>")
    assert X.page(spark, index, df, none, src, " ", None).collect() == [] and X.page(spark, index, df, none, src, "zebra", [1.0]).collect() == []
    only = X.page(spark, index, df, none, src, "bus", None, limit=5).collect()
    assert len(only) == 5 and only[0]["nearest"] is None and all(x["vector_rank"] is None for x in only)


# ---- answers


def plain_answer(hits, sources, named, by, top):
    key = lambda h: (len(h[3].strip()) >= 120, h[2], -h[0])
    best, count = {}, {}
    for h in hits:
        count[h[1]] = count.get(h[1], 0) + 1
        if h[1] not in best or key(h) > key(best[h[1]]):
            best[h[1]] = h
    parts = {}
    if by == "none":
        parts["list", ""] = [(s, best[s]) for s in best]
    else:
        for s in best:
            codes = list(dict.fromkeys(c[:2].upper() for c in sources[s][3] or [] if c))
            if len(codes) == 1:
                parts.setdefault(("place", codes[0]), []).append((s, best[s]))
                continue
            there = [(c, [h for h in hits if h[1] == s and c in named.get(h[0], ())]) for c in codes]
            for c, own in there:
                if own:
                    parts.setdefault(("place", c), []).append((s, max(own, key=key)))
            if not any(own for _, own in there):
                parts.setdefault(("unplaced", ""), []).append((s, best[s]))
    out, order = [], []
    for (part, code), rows in parts.items():
        publishers = {sources[s][0] for s, _ in rows}
        strong = len(publishers) >= 3 and any(sources[s][1] in ("government", "peer_reviewed") for s, _ in rows)
        dates = [sources[s][2] for s, _ in rows if sources[s][2]]
        left, shown = list(rows), {}
        items = []
        most = max(top, 10) if part == "list" else top
        while left and len(items) < most:
            pick = max(left, key=lambda e: (e[1][2] * A.TIER_WEIGHT.get(sources[e[0]][1], 1.0) * 0.5 ** shown.get(sources[e[0]][0], 0), -e[0]))
            left.remove(pick)
            shown[sources[pick[0]][0]] = shown.get(sources[pick[0]][0], 0) + 1
            items.append(pick)
        order.append((part, not strong, -len(publishers), -len(rows), code))
        out += [(part, code, "strong" if strong else "thin", len(rows), len(publishers), sorted({sources[s][1] for s, _ in rows}), max(dates, default=None), n, s, h[0], h[2], count[s]) for n, (s, h) in enumerate(items, 1)]
    place = {(p, c): sum(1 for o in order if o[0] == p and o[1:] <= (a, b, n, c)) for p, a, b, n, c in order}
    return sorted((p, place[p, c], c, *rest) for p, c, *rest in out)


@pytest.mark.parametrize("by", ["place", "none"])
def test_answer(spark, by):
    r = random.Random(9)
    codes = ["SG", "FR", "FRPAR", "JP", "us"]
    sources = {s: (f"p{r.randrange(6)}", r.choice(["government", "peer_reviewed", "press", "news", "informal"]), r.choice([None, dt.date(2020, 1, 1 + s % 28)]), r.choice([None, [], r.sample(codes, 1), r.sample(codes, 2), r.sample(codes, 3)])) for s in range(60)}
    hits = [(i, r.randrange(60), r.random(), "w" * r.choice([10, 130]) + "  ") for i in range(200)]
    named = {i: {c[:2].upper() for c in r.sample(codes, r.randrange(3))} for i in range(200)}
    got = A.answer(
        spark.createDataFrame(hits, "chunk_id long, source_id long, score double, text string"),
        spark.createDataFrame([(s, *v) for s, v in sources.items()], "source_id long, publisher string, tier string, published date, places array<string>"),
        spark.createDataFrame([(i, c) for i, cs in named.items() for c in cs], "chunk_id long, code string"), by, 4,
    )
    assert sorted(tuple(x) for x in got.collect()) == plain_answer(hits, sources, named, by, 4)


def test_grouping(spark):
    from marlspark.operators import places as P

    vocab = P.vocabulary(spark.createDataFrame([("Spain", "ES", False), ("Paris", "FRPAR", False)], "surface string, code string, ambiguous boolean"))
    rows = [(1, "tolls in Spain and Paris", None), (2, "where are tolls", None), (3, "nowhere", ["SG"]), (4, "spain tolls", []), (5, "which country has tolls", None), (6, "the countryside", None), (7, "", None)]
    got = {x["question_id"]: (x["by"], x["why"], x["named"]) for x in A.grouping(spark.createDataFrame(rows, "question_id long, question string, filtered array<string>"), vocab).collect()}
    assert got == {1: ("place", "named", ["ES", "FR"]), 2: ("place", "asked", []), 3: ("place", "filtered", []), 4: ("none", "neither", []), 5: ("place", "asked", []), 6: ("none", "neither", []), 7: ("none", "neither", [])}
