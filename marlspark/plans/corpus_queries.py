"""Scans, predicates and the flagship hybrid search over the corpus views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Filters, conditions, contains_all, cross_topic, embedding_tier, kept, long_enough, on_site, overlap
from ..operators import search
from ..sources import corpus as C
from .registry import query

#: The vector of chunk 0 is the query; words and floor fit the synthetic text and its nearly random vectors.
WORDS, PROBE, TEST_FLOOR = ["that", "with"], 0, 0.1


def probe(spark: SparkSession, d: str) -> list[float]:
    return C.vectors(spark, d).where(F.col("chunk_id") == PROBE).first()["v"]


COS = "CASE WHEN sqrt(list_sum(list_transform(v, lambda x: x * x))) > 0 THEN list_sum(list_transform(list_zip(v, q), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))) ELSE 0.0 END"
GOOD = "retention <> 'junk' AND trust = 'cleared' AND language IN ('en', 'de')"
LIFE = "CASE tier WHEN 'government' THEN 3650 WHEN 'institutional' THEN 1825 WHEN 'trade' THEN 1825 WHEN 'news' THEN 365 WHEN 'informal' THEN 180 END"
AGE = f"CASE WHEN published IS NULL OR {LIFE} IS NULL THEN 1.0 ELSE greatest(0.25, pow(0.5, greatest(DATE '2024-02-01' - published, 0) / {LIFE})) END"
_COUNTS = [f"len(regexp_extract_all(lower(text), '\\b{w}\\b'))" for w in WORDS]
LEX = f"""lex AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT chunk_id, {' + '.join(_COUNTS)} AS score FROM chunks WHERE source_id IN (SELECT source_id FROM good) AND {' AND '.join(c + ' > 0' for c in _COUNTS)} ORDER BY score DESC, chunk_id LIMIT 100))"""
VEC = f"""vec AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT chunk_id, round({COS}, 6) AS score FROM vectors, (SELECT v AS q FROM vectors WHERE chunk_id = {PROBE}) WHERE source_id IN (SELECT source_id FROM good) AND round({COS}, 6) >= {TEST_FLOOR} ORDER BY score DESC, chunk_id LIMIT 100))"""
HYBRID = C.sql("sources chunks vectors", f""", good AS (SELECT * FROM sources WHERE {GOOD}), {LEX}, {VEC},
fused AS (SELECT chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT chunk_id, rank FROM lex UNION ALL SELECT chunk_id, rank FROM vec) GROUP BY ALL),
owned AS (SELECT DISTINCT chunk_id, source_id, score FROM fused JOIN (SELECT chunk_id, source_id FROM chunks UNION ALL SELECT chunk_id, source_id FROM vectors) USING (chunk_id)),
aged AS (SELECT chunk_id, source_id, round(score * {AGE}, 8) AS score FROM owned JOIN good USING (source_id)),
capped AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, chunk_id) > 2 AS held_back FROM aged)
SELECT chunk_id, source_id, score, held_back FROM capped ORDER BY held_back, score DESC, chunk_id LIMIT 20""")


@query("r15_hybrid_search", HYBRID)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    f = Filters(languages=("en", "de"), cleared_only=True)
    return search.hybrid(C.chunks(spark, d), C.vectors(spark, d), C.sources(spark, d), WORDS, probe(spark, d), f, floor=TEST_FLOOR)


@query("r1_lexical_arm", C.sql("sources chunks", f", good AS (SELECT * FROM sources), {LEX} SELECT chunk_id, score, rank FROM lex"))
def lexical(spark, d):
    return search.lexical_arm(C.chunks(spark, d), WORDS)


@query("r4_vector_arm", C.sql("sources vectors", f", good AS (SELECT * FROM sources), {VEC} SELECT chunk_id, score, rank FROM vec WHERE rank <= 100"))
def vector(spark, d):
    v = C.vectors(spark, d)
    return search.vector_arm(v.join(C.sources(spark, d).select("source_id"), "source_id", "left_semi"), probe(spark, d), floor=TEST_FLOOR)


@query("r5_similarity_floor", C.sql("vectors", f"SELECT count(*) FILTER (s >= {TEST_FLOOR}) AS kept, count(*) FILTER (s < {TEST_FLOOR}) AS below, max(s) AS nearest FROM (SELECT round({COS}, 6) AS s FROM vectors, (SELECT v AS q FROM vectors WHERE chunk_id = {PROBE}) WHERE chunk_id <> {PROBE})"))
def floor(spark, d):
    from ..functions.vector import cosine, literal

    s = C.vectors(spark, d).where(F.col("chunk_id") != PROBE).select(F.round(cosine(F.col("v"), literal(probe(spark, d))), 6).alias("s"))
    return s.agg(F.count_if(F.col("s") >= TEST_FLOOR).alias("kept"), F.count_if(F.col("s") < TEST_FLOOR).alias("below"), F.max("s").alias("nearest"))


@query("s1_keyset_scan", C.sql("sources", "SELECT source_id, tier FROM sources WHERE source_id > 100 AND language = 'fr'"))
def keyset(spark, d):
    return C.sources(spark, d).where("source_id > 100 and language = 'fr'").select("source_id", "tier")


@query("s3_hash_sample", C.sql("sources", "SELECT source_id FROM sources ORDER BY md5('7:' || source_id), source_id LIMIT 50"))
def hash_sample(spark, d):
    return C.sources(spark, d).select("source_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("source_id").cast("string"))), "source_id").limit(50)


@query("s3_multiplicative_sample", "SELECT vec_id FROM embeddings ORDER BY (vec_id * 2654435761) % 4294967296, vec_id LIMIT 40")
def knuth_sample(spark, d):
    return C.table(spark, d, "embeddings").select("vec_id").orderBy(F.pmod(F.col("vec_id") * F.lit(2654435761), F.lit(4294967296)), "vec_id").limit(40)


@query("s12_checksums", "SELECT doc_id, 'sha256:' || sha256(text) AS checksum FROM documents")
def checksums(spark, d):
    return C.table(spark, d, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("checksum"))


@query("s13_bibtex", C.sql("sources", """SELECT source_id, '@' || CASE tier WHEN 'peer_reviewed' THEN 'article' WHEN 'government' THEN 'techreport' ELSE 'misc' END || '{' || publisher || coalesce(year(published)::VARCHAR, 'nd') || '_' || source_id || ',' || chr(10)
|| '  publisher = {' || publisher || '}' || CASE WHEN published IS NULL THEN '' ELSE ',' || chr(10) || '  year = {' || year(published) || '}' END || chr(10) || '}' AS entry FROM sources"""))
def bibtex(spark, d):
    from .text_queries import bibtex_entry

    return C.sources(spark, d).select("source_id", bibtex_entry().alias("entry"))


@query("s14_passages_by_source", C.sql("chunks", "SELECT source_id, '## ' || source_id || chr(10) || string_agg('- ' || text, chr(10) ORDER BY chunk_index) AS page FROM chunks GROUP BY source_id"))
def passages_page(spark, d):
    rows = C.chunks(spark, d).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("rows"))
    return rows.select("source_id", F.concat(F.lit("## "), F.col("source_id").cast("string"), F.lit("\n"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["text"])), "\n")).alias("page"))


@query("s15_snapshot_upsert", """
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'keep' WHEN o.v <> n.v THEN 'update' ELSE 'same' END AS action, coalesce(n.v, o.v) AS v
FROM (SELECT doc_id AS k, md5(text) AS v FROM documents WHERE doc_id % 3 <> 0) o FULL JOIN (SELECT doc_id AS k, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS v FROM documents WHERE doc_id % 4 <> 0) n ON o.k = n.k""")
def upsert(spark, d):
    from ..sinks import upsert_plan

    docs = C.table(spark, d, "documents")
    k = F.col("doc_id").alias("k")
    old = docs.where("doc_id % 3 <> 0").select(k, F.md5("text").alias("v"))
    new = docs.where("doc_id % 4 <> 0").select(k, F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("v"))
    return upsert_plan(old, new)


P1 = C.sql("sources", "SELECT source_id FROM sources WHERE retention <> 'junk' AND tier IN ('government', 'news', 'trade') AND coalesce(list_has_any(topics, ['t1', 't2']), false) AND published >= DATE '2019-01-01' AND published <= DATE '2023-12-31' AND trust = 'cleared'")


@query("p1_search_filter", P1)
def search_filter(spark, d):
    f = Filters(tiers=("government", "news", "trade"), any_topic=("t1", "t2"), since="2019-01-01", until="2023-12-31", cleared_only=True)
    return C.sources(spark, d).where(conditions(f)).select("source_id")


@query("p2_overlap", C.sql("sources", "SELECT source_id, coalesce(list_has_any(topics, ['t3']), false) AS hit FROM sources"))
def overlaps(spark, d):
    return C.sources(spark, d).select("source_id", overlap("topics", ["t3"]).alias("hit"))


@query("p3_contains_all", C.sql("sources", "SELECT source_id FROM sources WHERE coalesce(list_has_all(topics, ['t1', 't4']), false)"))
def containment(spark, d):
    return C.sources(spark, d).where(contains_all("topics", ["t1", "t4"])).select("source_id")


@query("p5_site_match", C.sql("sources", "SELECT source_id FROM sources WHERE host = 'src3' OR ends_with(host, '.src3') OR host = 'src7' OR ends_with(host, '.src7')"))
def site_match(spark, d):
    return C.sources(spark, d).where(on_site("host", ["https://www.SRC3/path", "src7", " "])).select("source_id")


@query("p7_kept_counts", C.sql("sources", "SELECT count(*) AS sources, count(*) FILTER (retention <> 'junk') AS kept, count(*) FILTER (retention <> 'junk' AND trust = 'cleared') AS readable FROM sources"))
def kept_counts(spark, d):
    return C.sources(spark, d).agg(F.count("*").alias("sources"), F.count_if(kept()).alias("kept"), F.count_if(kept() & (F.col("trust") == "cleared")).alias("readable"))


@query("p8_fragments", C.sql("chunks", "SELECT source_id, count(*) FILTER (length(text) >= 40) AS passages, count(*) FILTER (length(text) < 40) AS fragments FROM chunks GROUP BY ALL"))
def fragments(spark, d):
    return C.chunks(spark, d).groupBy("source_id").agg(F.count_if(long_enough()).alias("passages"), F.count_if(~long_enough()).alias("fragments"))


@query("p10_embedding_tiers", C.sql("chunks", "SELECT CASE WHEN chunk_index < 16 THEN 'first' WHEN chunk_index % 16 = 0 THEN 'then' ELSE 'last' END AS pass, count(*) AS n FROM chunks GROUP BY ALL"))
def tiers(spark, d):
    return C.chunks(spark, d).groupBy(embedding_tier().alias("pass")).agg(F.count("*").alias("n"))


@query("p11_claimable", C.sql("queue", "SELECT task_id FROM queue WHERE status = 'pending' AND topic <> 3 ORDER BY priority DESC, created_at, task_id LIMIT 20"))
def claimable(spark, d):
    return C.queue(spark, d).where("status = 'pending' and topic <> 3").orderBy(F.desc("priority"), "created_at", "task_id").limit(20).select("task_id")


@query("p13_citedness", C.sql("edges chunks", "SELECT chunk_id % 100 AS k, count(*) AS cited FROM (SELECT DISTINCT first_chunk FROM edges) e JOIN vectors2 ON vectors2.chunk_id = e.first_chunk % 500 GROUP BY ALL").replace("chunks AS (", "vectors2 AS (SELECT vec_id AS chunk_id FROM embeddings), chunks AS ("))
def cited(spark, d):
    e = C.edges(spark, d).select("first_chunk").distinct().select((F.col("first_chunk") % 500).alias("chunk_id"))
    v = C.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return e.join(v, "chunk_id").groupBy((F.col("chunk_id") % 100).alias("k")).agg(F.count("*").alias("cited"))


@query("p14_reclaimable", C.sql("vectors edges", "SELECT chunk_id FROM vectors WHERE chunk_id NOT IN (SELECT first_chunk % 400 FROM edges)"))
def reclaimable(spark, d):
    e = C.edges(spark, d).select((F.col("first_chunk") % 400).alias("chunk_id"))
    return C.vectors(spark, d).select("chunk_id").join(e, "chunk_id", "left_anti")


@query("p17_cross_topic", C.sql("sources", "SELECT a.source_id AS a, b.source_id AS b FROM sources a JOIN sources b ON b.source_id = a.source_id + 1 WHERE len(a.topics) > 0 AND len(b.topics) > 0 AND NOT list_has_any(a.topics, b.topics)"))
def crossing(spark, d):
    s = C.sources(spark, d)
    a, b = s.select(F.col("source_id").alias("a"), F.col("topics").alias("ta")), s.select(F.col("source_id").alias("b"), F.col("topics").alias("tb"))
    return a.join(b, F.col("b") == F.col("a") + 1).where(cross_topic("ta", "tb")).select("a", "b")
