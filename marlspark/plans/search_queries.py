"""Fusion, caps, reranking and evaluation of searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, literal
from ..operators import search as S
from ..sources import corpus as C
from .corpus_queries import AGE, COS, PROBE, probe
from .registry import query

ARMS = """, a AS (SELECT chunk_id, row_number() OVER (ORDER BY v[1] DESC, chunk_id) AS rank FROM vectors QUALIFY rank <= 100), b AS (SELECT chunk_id, row_number() OVER (ORDER BY v[2] DESC, chunk_id) AS rank FROM vectors QUALIFY rank <= 100),
f AS (SELECT chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY chunk_id)"""


def arms(spark, d):
    v = C.vectors(spark, d)
    arm = lambda i: S._ranked(v.select("chunk_id", F.element_at("v", i).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(100), "chunk_id")
    return [arm(1), arm(2)]


@query("r6_reciprocal_rank_fusion", C.sql("vectors", ARMS + " SELECT chunk_id, round(score, 10) AS score FROM f"))
def fusion(spark, d):
    return S.fuse(arms(spark, d)).select("chunk_id", F.round("score", 10).alias("score"))


@query("r10_source_cap", C.sql("vectors", ARMS + ", o AS (SELECT chunk_id, source_id, round(score, 10) AS score FROM f JOIN vectors USING (chunk_id)), c AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, chunk_id) > 1 AS held_back FROM o) SELECT chunk_id, source_id, score, held_back FROM c ORDER BY held_back, score DESC, chunk_id LIMIT 60"))
def cap(spark, d):
    f = S.fuse(arms(spark, d)).select("chunk_id", F.round("score", 10).alias("score"))
    return S.cap_per_source(C.vectors(spark, d).select("chunk_id", "source_id").join(f, "chunk_id"), cap=1, limit=60)


@query("r11_age_weights", C.sql("sources", f"SELECT source_id, round({AGE}, 8) AS weight FROM sources"))
def age(spark, d):
    return C.sources(spark, d).select("source_id", F.round(S.age_weight(F.col("published"), F.col("tier"), "2024-02-01"), 8).alias("weight"))


@query("r17_rerank_head", C.sql("vectors", ARMS + ", r AS (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM f), n AS (SELECT r.*, round(v[3], 8) AS s FROM r JOIN vectors USING (chunk_id)) SELECT chunk_id, row_number() OVER (ORDER BY rank > 30, CASE WHEN rank <= 30 THEN -s END NULLS LAST, rank) AS rank FROM n"))
def rerank(spark, d):
    f = S.fuse(arms(spark, d)).select("chunk_id", F.round("score", 10).alias("score"))
    ranked = S._ranked(f, "chunk_id").select("chunk_id", "rank")
    return S.rerank(ranked, C.vectors(spark, d).select("chunk_id", F.round(F.element_at("v", 3), 8).alias("new_score")))


@query("r27_capped_count", C.sql("sources", "SELECT count(*) AS n FROM (SELECT source_id FROM sources WHERE created_at >= TIMESTAMP '2024-01-10' LIMIT 101)"))
def capped(spark, d):
    return C.sources(spark, d).where("created_at >= timestamp_ntz'2024-01-10 00:00:00'").select("source_id").limit(101).agg(F.count("*").alias("n"))


@query("r28_question_overlap", """WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM documents), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY ALL),
p AS (SELECT item_id, doc_id, count(*) AS k FROM q JOIN d USING (w) GROUP BY ALL) SELECT item_id, max_by(doc_id, (k, -doc_id)) AS best, max(k) AS shared, CASE WHEN max(k) / n >= 0.5 THEN 2 WHEN max(k) / n >= 0.25 THEN 1 ELSE 0 END AS grade FROM p JOIN n USING (item_id) GROUP BY item_id, n""")
def questions(spark, d):
    words = lambda t, i: C.table(spark, d, t).select(i, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)))).alias("w"))
    q = words("benchmark", "item_id")
    n = q.groupBy("item_id").agg(F.count("*").alias("n"))
    p = q.join(words("documents", "doc_id"), "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("k"))
    best = p.groupBy("item_id").agg(F.max_by("doc_id", F.struct("k", -F.col("doc_id"))).alias("best"), F.max("k").alias("shared")).join(n, "item_id")
    share = F.col("shared") / F.col("n")
    return best.select("item_id", "best", "shared", F.when(share >= 0.5, 2).when(share >= 0.25, 1).otherwise(0).alias("grade"))


@query("r29_arm_overlap", C.sql("vectors", ARMS + " SELECT count(*) FILTER (n = 2) AS both, count(*) FILTER (n = 1) AS one, round(count(*) FILTER (n = 2) / count(*), 6) AS share FROM (SELECT chunk_id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY chunk_id)"))
def arm_overlap(spark, d):
    x, y = arms(spark, d)
    n = x.select("chunk_id").unionByName(y.select("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") == 2).alias("both"), F.count_if(F.col("n") == 1).alias("one"), F.round(F.count_if(F.col("n") == 2) / F.count("*"), 6).alias("share"))


@query("g12_nearest_per_source", C.sql("vectors", f"SELECT source_id, max_by(chunk_id, (round({COS}, 6), -chunk_id)) AS chunk_id, max(round({COS}, 6)) AS similarity FROM vectors, (SELECT v AS q FROM vectors WHERE chunk_id = {PROBE}) GROUP BY source_id"))
def nearest_per_source(spark, d):
    v = C.vectors(spark, d).select("source_id", "chunk_id", F.round(cosine(F.col("v"), literal(probe(spark, d))), 6).alias("s"))
    return v.groupBy("source_id").agg(F.max_by("chunk_id", F.struct("s", -F.col("chunk_id"))).alias("chunk_id"), F.max("s").alias("similarity"))


@query("w2_recency_per_topic", C.sql("sources", "SELECT topic, source_id FROM (SELECT topic, source_id, row_number() OVER (PARTITION BY topic ORDER BY created_at DESC, source_id) AS r FROM (SELECT unnest(topics) AS topic, source_id, created_at FROM sources)) WHERE r <= 5"))
def recency(spark, d):
    t = C.sources(spark, d).select(F.explode("topics").alias("topic"), "source_id", "created_at")
    r = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("created_at"), "source_id"))
    return t.withColumn("r", r).where("r <= 5").select("topic", "source_id")
