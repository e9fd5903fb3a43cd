"""Claims, redirects, rings, copies in a ranking and samples, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import Filters, conditions
from ..operators import claims as M
from ..operators import search as S
from ..sources import corpus as C
from .registry import query


@query("g2_neighbour_support", C.sql("edges", ", b AS (SELECT dst AS other, first_chunk AS c, confidence AS f FROM edges WHERE src = 'Brand#3' UNION ALL SELECT src, first_chunk, confidence FROM edges WHERE dst = 'Brand#3') SELECT other, count(DISTINCT c) AS support, coalesce(max(f), -1.0) AS confidence FROM b GROUP BY other"))
def support(spark, d):
    return M.neighbour_support(C.edges(spark, d).withColumn("cited", F.array("first_chunk")), "Brand#3")


@query("g5_contested_pairs", "WITH m AS (SELECT o_orderkey AS x, o_orderkey + 1 AS y, o_orderdate AS t FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderkey - 1, o_orderdate FROM orders WHERE o_orderkey % 6 = 1) SELECT least(x, y) AS a, greatest(x, y) AS b, max(t) AS newest FROM m GROUP BY ALL ORDER BY newest DESC, a, b LIMIT 50")
def contested(spark, d):
    k = F.col("o_orderkey")
    by = F.when(k % 3 == 0, F.array(k + 1)).when(k % 6 == 1, F.array(k - 1)).otherwise(F.array().cast("array<long>"))
    return M.contested_pairs(C.table(spark, d, "orders").select(k.alias("edge_id"), by.alias("contested_by"), F.col("o_orderdate").alias("created")), 50)


@query("g20_upserted_claims", C.sql("edges", """, a AS (SELECT src, dst, first_chunk AS c, length(relation) AS tier, relation AS j, 0 AS new FROM edges WHERE stance = 'supports' UNION ALL SELECT src, dst, first_chunk, length(relation), 'new ' || relation, 1 FROM edges WHERE stance = 'opposes')
SELECT src, dst, list_sort(list(DISTINCT c)) AS cited, max(tier)::INTEGER AS tier, max_by(j, (tier, -new, j)) AS judgement FROM a GROUP BY ALL"""))
def upserts(spark, d):
    e = C.edges(spark, d)
    side = lambda stance, name: e.where(F.col("stance") == stance).select("src", "dst", F.array("first_chunk").alias("cited"), F.char_length("relation").alias("tier"), F.concat(F.lit(name), "relation").alias("judgement"))
    return M.upserted(side("supports", ""), side("opposes", "new "), ["src", "dst"])


@query("g22_redirects", C.sql("edges", "SELECT src, CASE WHEN dst IN ('nation4', 'nation9') THEN 'nation0' ELSE dst END AS dst, support FROM edges"))
def redirects(spark, d):
    r = spark.createDataFrame([("nation4", "nation0"), ("nation9", "nation0")], "id string, to string")
    return M.redirected(C.edges(spark, d).select("src", "dst", "support"), r, "dst")


@query("p9_edge_filter", C.sql("edges", "SELECT src, dst, relation, stance FROM edges JOIN orders ON o_orderkey = first_chunk WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01'"))
def edge_filter(spark, d):
    e = C.edges(spark, d).select("*", F.concat_ws("|", "src", "dst", "relation", "stance").alias("edge_id"), F.array("first_chunk").alias("cited"), (F.col("stance") == "opposes").alias("contested"))
    o = C.table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_orderstatus", "o_orderdate")
    return M.edges_like(e, o, (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))).select("src", "dst", "relation", "stance")


COS = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x))))"


@query("j4_nearest_each", C.sql("vectors", f", f AS (SELECT * FROM vectors WHERE chunk_id < 20), p AS (SELECT a.chunk_id AS id, b.chunk_id AS other, round({COS}, 6) AS similarity FROM f a JOIN vectors b ON a.chunk_id <> b.chunk_id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS n FROM p WHERE similarity >= 0.2) SELECT id, other, similarity FROM r WHERE n <= 5"))
def nearest_each(spark, d):
    v = C.vectors(spark, d).select(F.col("chunk_id").alias("id"), "v")
    return M.nearest_each(v.where("id < 20"), v, least=0.2)


@query("g13_rings", C.sql("vectors", f""", c AS (SELECT chunk_id AS id, (chunk_id % 17)::DOUBLE AS value FROM vectors WHERE chunk_id % 5 = 1), s AS (SELECT b.chunk_id AS id, round({COS}, 6) AS value FROM vectors a JOIN vectors b ON a.chunk_id = 0 WHERE b.chunk_id % 5 <> 1 AND round({COS}, 6) >= 0.1)
SELECT * FROM (SELECT 'cited' AS ring, id, value, (SELECT count(*) FROM c) AS total FROM c ORDER BY value DESC, id LIMIT 12) UNION ALL SELECT * FROM (SELECT 'similar' AS ring, id, value, (SELECT count(*) FROM s) AS total FROM s ORDER BY value DESC, id LIMIT 10)"""))
def rings(spark, d):
    v = C.vectors(spark, d)
    i = F.col("chunk_id")
    q = v.where(i == 0).first()["v"]
    return M.rings(v.where(i % 5 == 1).select(i.alias("id"), (i % 17).alias("support")), v.select(i.alias("id"), "v"), q, least=0.1)


@query("v17_group_centroids", C.sql("vectors", """, l AS (SELECT chunk_id % 7 AS parent, chunk_id % 4 + 1 AS size, v FROM vectors), x AS (SELECT parent, size, unnest(v) AS x, unnest(range(len(v))) AS i FROM l), m AS (SELECT parent, i, round(sum(x * size) / sum(size), 6) AS x FROM x GROUP BY ALL)
, n AS (SELECT parent, sum(size)::BIGINT AS size FROM l GROUP BY parent) SELECT parent, n.size, row_number() OVER (ORDER BY parent) - 1 AS number, round(list_sum(list(abs(x))), 3) AS spread FROM n JOIN m USING (parent) GROUP BY parent, n.size"""))
def centroids(spark, d):
    i = F.col("chunk_id")
    c = M.weighted_centroids(C.vectors(spark, d).select((i % 7).alias("parent"), (i % 4 + 1).alias("size"), "v"))
    return c.select("parent", "size", "number", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + F.abs(x)), 3).alias("spread"))


@query("v22_map_sample", C.sql("sources", "SELECT source_id, length(text[1:160]) AS n FROM sources WHERE retention <> 'junk' AND trust = 'cleared' ORDER BY md5('map:' || source_id), source_id LIMIT 300"))
def map_sample(spark, d):
    s = C.sources(spark, d).where(conditions(Filters(cleared_only=True)))
    return s.orderBy(F.md5(F.concat(F.lit("map:"), F.col("source_id").cast("string"))), "source_id").limit(300).select("source_id", F.char_length(F.substring("text", 1, 160)).cast("long").alias("n"))


@query("v27_cited_places", "SELECT c_custkey AS source, count(DISTINCT s_nationkey) AS places FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_custkey")
def cited_places(spark, d):
    c, o, li, s = (C.table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier"))
    j = c.select("c_custkey").join(o.select("o_custkey", "o_orderkey"), c.c_custkey == o.o_custkey)
    j = j.join(li.select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_custkey").alias("source")).agg(F.count_distinct("s_nationkey").alias("places"))


@query("r8_set_back", C.sql("chunks", ", t AS (SELECT chunk_id, row_number() OVER (ORDER BY length(text) % 50 DESC, chunk_id) AS rank FROM chunks ORDER BY rank LIMIT 100) SELECT chunk_id, row_number() OVER (ORDER BY chunk_id % 4 = 0, rank) AS rank FROM t"))
def set_back(spark, d):
    top = C.chunks(spark, d).select("chunk_id", (F.char_length("text") % 50).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(100)
    return S.set_back(S._ranked(top, "chunk_id"), F.col("chunk_id") % 4 == 0)


def ranked_copies(spark, d):
    """The hundred longest passages that stand in more than one source, with copies of them, as a ranking."""
    mark = F.md5("text")
    c = C.chunks(spark, d).select("chunk_id", "source_id", "text", F.char_length("text").alias("score"))
    several = c.groupBy("score", mark.alias("mark")).agg(F.min("source_id").alias("one"), F.max("source_id").alias("two"), F.min("chunk_id").alias("first")).where("one <> two")
    top = several.orderBy(F.desc("score"), "first").limit(100).select("score", "mark")
    return S._ranked(c.withColumn("mark", mark).join(F.broadcast(top), ["score", "mark"]), "chunk_id").select("chunk_id", "source_id", "rank", "text")


@query("r9_fold_copies")
def fold_copies(spark, d):
    return S.fold_copies(ranked_copies(spark, d))


@query("r12_hydrated_hits", C.sql("sources chunks", "SELECT chunk_id, tier, length(text) AS n, label FROM (SELECT c.chunk_id, s.tier, c.text, v.label FROM chunks c JOIN sources s USING (source_id) LEFT JOIN (SELECT vec_id AS chunk_id, label FROM embeddings) v USING (chunk_id) WHERE c.chunk_id % 997 = 0)"))
def hydrated(spark, d):
    c = C.chunks(spark, d)
    ids = c.where("chunk_id % 997 = 0").select("chunk_id")
    t = C.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return S.hydrated(ids, c, C.sources(spark, d).select("source_id", "tier"), t).select("chunk_id", "tier", F.char_length("text").cast("long").alias("n"), "label")


@query("p6_safe_for_a_model", C.sql("sources", "SELECT source_id FROM sources WHERE retention <> 'junk' AND trust = 'cleared'"))
def safe(spark, d):
    return C.sources(spark, d).where(conditions(Filters(cleared_only=True))).select("source_id")


@query("g16_normal_names", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'creme ' || p_name WHEN p_partkey % 3 = 1 THEN p_name || ' corporation' ELSE 'the' END AS normal FROM part")
def normal_names(spark, d):
    i = F.col("p_partkey") % 3
    name = F.when(i == 0, F.concat(F.lit("The Crème-"), F.upper("p_name"))).when(i == 1, F.concat("p_name", F.lit(", Corp."))).otherwise("THE")
    return M.normal_names(C.table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name")), ["the"], {"corp": "corporation"}).select("id", "normal")


@query("s16_rebuilt_table", C.sql("sources", "SELECT host, count(*) AS n FROM sources GROUP BY host"))
def rebuilt(spark, d):
    from ..sinks import rebuilt_table

    return rebuilt_table(C.sources(spark, d).groupBy("host").agg(F.count("*").alias("n")), "host_counts")
