"""Rules that SQL can't state, against plain Python."""

from __future__ import annotations

import random
import re
import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlspark.functions import pages as P
from marlspark.operators import claims, reports, search
from marlspark.plans import claim_queries


def shingles(text: str) -> set[str]:
    w = re.sub("[^a-z0-9à-öø-ÿß]+", " ", text.lower()).split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def folded(hits):
    kept, out = [], {}
    for key, source, rank, text in sorted(hits, key=lambda h: (h[2], h[0])):
        own, into, best = shingles(text), None, (0, 0)
        if len(own) >= 12:
            for other in {k[1] for k in kept} - {source}:
                members = [k for k in kept if k[1] == other]
                if len(own & set().union(*(m[3] for m in members))) >= 0.5 * len(own):
                    for m in members:
                        if (mark := (len(own & m[3]), -m[2])) > best:
                            best, into = mark, m[0]
        if into is None:
            kept.append((key, source, rank, own))
        out[key] = into
    return out


def test_copies_fold(spark, sf_dir):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    base = [" ".join(rng.choices(words, k=30)) for _ in range(4)]
    made = []
    for i in range(60):
        b = base[i % 4].split()
        text = " ".join(b[: rng.choice([10, 20, 30])] + rng.choices(words, k=rng.choice([0, 5, 15])))
        made.append((i, rng.randrange(6), i, text if i % 7 else "too short to fold"))
    df = spark.createDataFrame(made, "chunk_id long, source_id long, rank long, text string")
    want = folded(made)
    assert {r[0]: r[1] for r in search.fold_copies(df).collect()} == want and sum(v is not None for v in want.values()) > 10
    hits = claim_queries.ranked_copies(spark, sf_dir)
    rows = [tuple(r) for r in hits.select("chunk_id", "source_id", "rank", "text").collect()]
    assert {r[0]: r[1] for r in search.fold_copies(hits).collect()} == folded(rows)


def test_names_are_normal(spark):
    names = ["Société Générale", "ＦＵＬＬ width", "The the", "Straße-Bau Corp.", "Ångström_1", "", "Łódź"]
    out = claims.normal_names(spark.createDataFrame([(n,) for n in names], "name string"), ["the"], {"corp": "corporation"})

    def plain(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not "̀" <= c <= "ͯ").casefold()
        w = ["corporation" if x == "corp" else x for x in re.sub(r"[^\w\s]|_", " ", s).split()]
        return " ".join([x for x in w if x != "the"] or w)

    assert {r["name"]: r["normal"] for r in out.collect()} == {n: plain(n) for n in names}


def test_merges_must_not_chain(spark):
    ids = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(ValueError):
        claims.redirected(ids, spark.createDataFrame([("a", "b"), ("b", "c")], "id string, to string"), "id")


def test_pages_beyond_the_candidates_are_refused(spark):
    ranked = spark.createDataFrame([(i, float(i)) for i in range(5)], "chunk_id long, score double")
    assert [tuple(r) for r in search.page(ranked, 3, 2).collect()] == [(1, 4, False), (0, 5, False)]
    with pytest.raises(ValueError):
        search.page(ranked, 95, 10)


def test_backpressure_is_a_fold(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.uniform(0, 100)) for k in range(3) for i in range(200)]
    out = reports.paused(spark.createDataFrame(rows, "key long, ts long, depth double"), "key", "ts", "depth", 60.0).collect()
    want, state = {}, {}
    for k, i, x in rows:
        state[k] = True if x > 60 else False if x < 48 else state.get(k, False)
        want[k, i] = state[k]
    assert {(r["key"], r["ts"]): r["paused"] for r in out} == want


def test_words_are_taken_as_they_are_written(spark):
    df = spark.createDataFrame([(1, "c++ and a.b"), (2, "cc and axb"), (3, "C++ only")], "chunk_id long, text string")
    assert [r[0] for r in search.lexical_arm(df, ["c++"]).orderBy("chunk_id").collect()] == [1, 3]
    assert [r[0] for r in search.lexical_arm(df, ["a.b"]).collect()] == [1]


def test_texts_of_pages(spark):
    html = "<html lang='de-AT'><head><title> A &amp; B </title></head><body><!-- no --><script>var x = '<p>';</script><p>One  two</p><div>three<br/>four <b>five</b></div><a href='/x?a=1&amp;b=2#c'>l</a><a HREF=\"mailto:x\">m</a></body></html>"
    r = spark.createDataFrame([(html,)], "h string").select(P.html_title(F.col("h")).alias("t"), P.html_language(F.col("h")).alias("l"), P.html_text(F.col("h")).alias("x"), P.html_links(F.col("h")).alias("a")).first()
    assert (r["t"], r["l"], r["a"]) == ("A & B", "de", ["/x?a=1&b=2"]) and r["x"] == "One two\nthree\nfour five\nlm"


def test_limits_of_calls(spark):
    t0 = datetime(2024, 1, 1)
    calls = [(i, 1, t0 + timedelta(minutes=10 * i), i % 4 == 3) for i in range(20)]
    out = reports.over_limit(spark.createDataFrame(calls, "call_id long, token long, ts timestamp_ntz, refused boolean"), 4).collect()
    for r in out:
        t = calls[r["call_id"]][2]
        assert r["recent"] == sum(1 for _, _, u, bad in calls if not bad and timedelta(0) < t - u <= timedelta(hours=1)) and r["allowed"] == (r["recent"] < 4)


def test_longest_passages_of_several_sources(spark, tmp_path):
    line = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    docs = [(i, "\n".join([line(i, 300 + i), line(1000 + i % 7, 40 + i % 7), "twice here", "twice here"])) for i in range(30)] + [(30, line(5000, 500) + "\n" + line(5000, 500)), (31, line(1003, 43))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = claim_queries.ranked_copies(spark, str(tmp_path)).orderBy("rank").collect()
    want = [(i * 10000 + p, i, t) for i, text in docs for p, t in enumerate(text.split("\n")) if sum(t in x.split("\n") for _, x in docs) > 1]
    assert [(r["chunk_id"], r["source_id"], r["text"]) for r in got] == sorted(want, key=lambda h: (-len(h[2]), h[0])) and [r["rank"] for r in got] == list(range(1, len(want) + 1))
    out = {r[0]: r[1] for r in claim_queries.fold_copies(spark, str(tmp_path)).collect()}
    assert out == folded([(r["chunk_id"], r["source_id"], r["rank"], r["text"]) for r in got]) and sum(v is not None for v in out.values()) == 31 - 7


def test_long_lists_of_copies_fold_whole(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.choice([18, 30, 45]))) for _ in range(12)] + ["one two three four five six", "", "too short"]
    for i in range(12):  # cut at other boundaries, and run together
        b, c = base[i].split(), base[(i + 1) % 12].split()
        base += [" ".join(b[: len(b) // 2] + c[: len(c) // 2]), " ".join(b[3:])]
    made = [(i, rng.randrange(9), i + 1, rng.choice(base)) for i in range(1200)]
    rng.shuffle(made)
    want = folded(made)
    assert {r[0]: r[1] for r in search.fold_copies(spark.createDataFrame(made, "chunk_id long, source_id long, rank long, text string")).collect()} == want and len(want) == 1200
