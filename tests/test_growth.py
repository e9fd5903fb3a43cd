"""What grew faster than the input: each text read once, rows that copies don't multiply, what a task holds bounded."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspark.operators import dedupe as D
from marlspark.operators import fulltext as X
from marlspark.operators import gazetteer as G
from marlspark.operators import passages as T
from marlspark.operators import reports as P
from marlspark.operators import resolution as R
from marlspark.plans import graph_queries, standing_queries


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_made_without_a_shuffle_and_counted_from_what_was_written(spark, tmp_path):
    p = spark.createDataFrame([(1, 10, "der rote Ring der Ring"), (2, 10, "Ring"), (3, 11, ""), (4, 11, None)], "chunk_id long, source_id long, text string")
    rows = X.positions(p)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r["word"], r["chunk_id"]): (r["length"], list(r["places"])) for r in rows.collect()} == {("der", 1): (5, [0, 3]), ("rote", 1): (5, [1]), ("ring", 1): (5, [2, 4]), ("ring", 2): (1, [0])}
    index = X.write_index(p, str(tmp_path / "i"))
    assert {(r["word"], r["id"], r["held"]) for r in X.read(spark, index, ["ring", "rote"]).collect()} == {("ring", 1, 2), ("ring", 2, 2), ("rote", 1, 1)}


def test_mentions_alike_are_judged_once(spark):
    fields = "mention_id long, name string, kind string, jurisdiction string, v array<double>"
    rows = [(i, ["Red Bolt", " red bolt", None, "New Rod", "old thing"][i % 5], "k", [None, "DE"][i % 2], [None, [1.0, 0.0]][i % 3 == 0]) for i in range(60)]
    m = spark.createDataFrame(rows, fields)
    e = spark.createDataFrame([(1, "Red Bolt", "k", "DE", None, [1.0, 1.0]), (2, "New Red Rod", "k", None, None, None)], "entity_id long, name string, kind string, jurisdiction string, redirects_to long, v array<double>")
    one = R._resolved(m, e, None, None, 25, 8)
    assert sorted(map(str, R.resolved(m, e).collect())) == sorted(map(str, one.collect()))


TERMS = "term_id long, canonical string, aliases array<string>, entity_type string, approved boolean, ambiguous boolean, rejected boolean"


def test_context_matches_texts_once(spark):
    terms = spark.createDataFrame([(1, "Alpha Body", ["shared"], "agency", True, False, False), (2, "Beta Body", ["shared"], "agency", True, False, False)], TERMS)
    texts = spark.createDataFrame([(1, "Alpha Body and shared"), (2, "shared"), (3, "Alpha Body, Beta Body, shared")], "id long, text string")
    out = G.by_context(texts, terms, "id")
    assert plan(out).count("MapInArrow") == 1
    assert sorted((r["id"], r["term_id"] or 0, r["reason"] or "") for r in out.collect()) == [(1, 1, ""), (1, 1, "context"), (2, 0, "collision"), (3, 0, "collision"), (3, 1, ""), (3, 2, "")]


def test_many_matches_of_one_text(spark):
    n = G.FLUSHED + 5
    names = spark.createDataFrame([("ab", False)], "surface string, cased boolean")
    got = G.find(spark.createDataFrame([(1, "ab " * n), (2, "x ab"), (3, "")], "id long, text string"), names, "id")
    assert {(r["id"], r["n"], r["b"]) for r in got.groupBy("id").agg(F.count("*").alias("n"), F.count_if("beside").alias("b")).collect()} == {(1, n, n - 1), (2, 1, 0)}


def test_acronym_verdicts_read_texts_once(spark, sf_dir):
    out = standing_queries.acronym_verdicts(spark, sf_dir)
    assert "Arrow" not in plan(out) and out.count() > 0  # what was read is counted and written before it is asked twice


def test_brands_are_ranked_not_parts(spark, sf_dir):
    assert "dense_rank" not in plan(graph_queries.cited_bridges(spark, sf_dir))


def test_passages_of_a_text_beyond_what_is_handed_on_at_once(spark):
    text = "word. " * (T.CUT // 3)
    got = T.passages(spark.createDataFrame([(1, text), (2, None), (3, "One. Two.")], "id long, text string"), "id").orderBy("id", "place").collect()
    assert [(r["start"], r["start"] + len(r["text"])) for r in got if r["id"] == 1] == T.spans(text) and [r["id"] for r in got][-1] == 3


def test_repeated_cities_count_once_before_the_join(spark):
    items = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "a"), (3, 1.0, "z"), (4, 5.0, None)], "source_id long, score double, place string")
    out = P.by_country(items, spark.createDataFrame([("a", "A")] * 50, "city string, country string"))
    assert sorted(map(tuple, out.collect())) == [("A", 2, 3.0), ("unplaced", 1, 5.0), ("z", 1, 1.0)]
    assert "Aggregate [city" in plan(out)


def test_nearest_earlier_in_tiles(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(150, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 6)
    got = {r["chunk_id"]: r["earlier"] for r in D.nearest_earlier(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, v array<double>"), 0.3, tile=7).collect()}
    assert got == {i: int(sim[i, :i].argmax()) for i in range(1, 150) if sim[i, :i].max() > 0.3}


def test_nearest_earlier_shuffles_no_pairs(spark):
    import numpy as np

    x = np.random.default_rng(5).integers(-2, 3, size=(700, 3)).astype(float)  # many equal similarities
    x = x[np.linalg.norm(x, axis=1) > 0]
    ids = np.random.default_rng(6).permutation(len(x)) * 3 - 400
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 6)
    want = {}
    for i in range(len(x)):
        before = [(-sim[i, j], ids[j]) for j in range(len(x)) if ids[j] < ids[i]]
        if before and -min(before)[0] > 0.9:
            want[ids[i]] = (min(before)[1], -min(before)[0])
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "chunk_id long, v array<double>").repartition(5)
    for block, tile in ((40, 7), (8192, 512)):
        out = D.nearest_earlier(rows, 0.9, block=block, tile=tile)
        assert {r["chunk_id"]: (r["earlier"], r["similarity"]) for r in out.collect()} == want
        made = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in made and "SortMergeJoin" not in made and "Broadcast" not in made
