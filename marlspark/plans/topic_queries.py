"""Topic labels, clusters and their names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import topics as T
from ..sources import corpus as C
from .registry import query

N2 = "sqrt(list_sum(list_transform({0}, lambda n: n * n)))"
UNIT = "list_transform({0}, lambda u: u / " + N2 + ")"
MEANS = """, d AS (SELECT *, unnest(range(1, 65)) AS i FROM vectors), c AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS x FROM d GROUP BY i)),
m AS (SELECT topic, list(x ORDER BY i) AS p FROM (SELECT topic, i, avg(v[i]) AS x FROM d GROUP BY ALL) GROUP BY topic)"""
SCORES = MEANS + """, pu AS (SELECT topic, list_transform(list_zip(p, c), lambda z: z[1] - z[2]) AS p FROM m, c), pn AS (SELECT topic, list_transform(p, lambda x: x / sqrt(list_sum(list_transform(p, lambda y: y * y)))) AS p FROM pu),
vu AS (SELECT chunk_id, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS u FROM vectors, c), vn AS (SELECT chunk_id, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) AS u FROM vu),
s AS (SELECT chunk_id, topic, round(list_sum(list_transform(list_zip(u, p), lambda z: z[1] * z[2])), 4) + 0.0 AS score FROM vn, pn)"""


def scores(spark, d):
    v = C.vectors(spark, d)
    return T.prototype_scores(v, T.means(v, ["topic"]), T.means(v.withColumn("one", F.lit(1)), ["one"]))


@query("v8_prototype_scores", C.sql("vectors", SCORES + " SELECT chunk_id, topic, score FROM s"))
def prototypes(spark, d):
    return scores(spark, d)


@query("v9_comparable_scores", C.sql("sources vectors", SCORES + " SELECT s.chunk_id, s.topic, round(CASE WHEN language <> 'en' THEN least(1.0, 0.2 + 1.2 * (score - 0.2)) ELSE score END, 6) AS score FROM s JOIN vectors v ON s.chunk_id = v.chunk_id JOIN sources o ON v.source_id = o.source_id"))
def comparable(spark, d):
    owner = C.vectors(spark, d).select("chunk_id", "source_id").join(C.sources(spark, d).select("source_id", "language"), "source_id")
    return scores(spark, d).join(owner, "chunk_id").select("chunk_id", "topic", F.round(T.comparable(F.col("score"), F.col("language")), 6).alias("score"))


@query("v10_labels", C.sql("vectors", SCORES + ", b AS (SELECT *, max(score) OVER (PARTITION BY chunk_id) AS best FROM s) SELECT chunk_id, list(topic ORDER BY score DESC, topic) AS topics FROM b WHERE score >= 0.2 AND score >= round(best - 0.04, 4) GROUP BY chunk_id"))
def label_decision(spark, d):
    return T.labels(scores(spark, d), floor=0.2)


@query("v11_off_topic", C.sql("vectors", SCORES + " SELECT chunk_id, max(score) AS best FROM s GROUP BY chunk_id HAVING max(score) < 0.30"))
def off_topic(spark, d):
    return scores(spark, d).groupBy("chunk_id").agg(F.max("score").alias("best")).where("best < 0.30")


@query("v16_nearest_leaf", C.sql("vectors", MEANS + ", x AS (SELECT chunk_id, leaf, round(list_sum(list_transform(list_zip(v, p), lambda z: z[1] * z[2])), 8) AS s FROM vectors, (SELECT topic AS leaf, p FROM m)) SELECT chunk_id, max_by(leaf, (s, -leaf)) AS leaf FROM x GROUP BY chunk_id"))
def leaf(spark, d):
    v = C.vectors(spark, d)
    return T.nearest_centroid(v, T.means(v, ["topic"]).withColumnRenamed("topic", "leaf"))


@query("v18_class_terms", """WITH w AS (SELECT lang AS cls, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents), tf AS (SELECT cls, term, count(*) AS tf FROM w GROUP BY ALL), k AS (SELECT term, count(*) AS f FROM w GROUP BY term HAVING count(DISTINCT doc_id) >= 2),
a AS (SELECT avg(n) AS a FROM (SELECT sum(tf) AS n FROM tf GROUP BY cls)), s AS (SELECT cls, term, round(tf * ln(1 + a / f), 4) AS score FROM tf JOIN k USING (term), a)
SELECT cls, term, score FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, term) AS r FROM s) WHERE r <= 12""")
def terms(spark, d):
    return T.class_tfidf(C.table(spark, d, "documents").select(F.col("lang").alias("cls"), F.col("doc_id").alias("source_id"), "text"))


@query("v12_fingerprints", C.sql("sources", "SELECT source_id, sha256(tier || '|' || language || '|' || n_chars) AS mark FROM sources"))
def fingerprints(spark, d):
    return C.sources(spark, d).select("source_id", F.sha2(F.concat_ws("|", "tier", "language", F.col("n_chars").cast("string")), 256).alias("mark"))


@query("v14_clusters")
def clusters(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = C.vectors(spark, d).select("chunk_id", array_to_vector("v").alias("features"))
    model = KMeans(k=10, seed=7, distanceMeasure="cosine", maxIter=25).fit(data)
    return model.transform(data).select("chunk_id", F.col("prediction").alias("cluster"))


@query("v21_projection")
def projection(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = C.vectors(spark, d).select("chunk_id", array_to_vector("v").alias("features"))
    p = PCA(k=3, inputCol="features", outputCol="p").fit(data).transform(data).select("chunk_id", vector_to_array("p").alias("p"))
    top = p.agg(*(F.max(F.abs(F.col("p")[i])).alias(f"m{i}") for i in range(3)))
    return p.join(F.broadcast(top)).select("chunk_id", *(F.round(F.col("p")[i] / F.col(f"m{i}"), 6).alias(x) for i, x in enumerate("xyz")))
