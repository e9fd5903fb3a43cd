"""Reports on gaps, health, queues and proposals, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import search as S
from ..sources import corpus as C
from .registry import query

NOW = "2024-02-01"


@query("a2_novelty_health", "SELECT count(*) FILTER (e) AS judged, count(*) FILTER (e AND d) AS duplicates, count(*) FILTER (NOT e) AS pending, CASE WHEN count(*) FILTER (e) > 0 THEN round(count(*) FILTER (e AND NOT d) / count(*) FILTER (e), 4) END AS pass_rate FROM (SELECT doc_id % 4 <> 0 AS e, text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) AS d FROM documents)")
def novelty_health(spark, d):
    docs = C.table(spark, d, "documents")
    twins = docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("k")).where("k > 1").select("sha", F.lit(True).alias("twin"))
    judged = docs.select((F.col("doc_id") % 4 != 0).alias("examined"), F.sha2("text", 256).alias("sha")).join(twins, "sha", "left")
    return R.novelty_health(judged.select("examined", F.coalesce("twin", F.lit(False)).alias("duplicate")))


FIELDS = ", p AS (SELECT host AS field, source_id, coalesce(list_has_any(topics, ['t0', 't1', 't2', 't3']), false) AS on_topic, tier IN ('peer_reviewed', 'government') AS strong, published FROM chunks JOIN sources USING (source_id))"


@query("a18_field_gaps", C.sql("sources chunks", FIELDS + """, g AS (SELECT field, count(*) AS passages, count(DISTINCT source_id) AS n, count(*) FILTER (on_topic) / count(*) AS share, bool_or(strong) AS strong, max(published) AS newest FROM p GROUP BY field)
, h AS (SELECT field, passages, CASE WHEN n < 3 THEN 'thin' WHEN NOT strong THEN 'weak' WHEN coalesce(DATE '2024-02-01' - newest > 180, true) THEN 'stale' END AS gap FROM g WHERE share >= 0.5 AND passages >= 30) SELECT * FROM h WHERE gap IS NOT NULL"""))
def field_gaps(spark, d):
    s, on = C.sources(spark, d), F.coalesce(F.arrays_overlap("topics", F.array(*map(F.lit, ["t0", "t1", "t2", "t3"]))), F.lit(False))
    s = s.select("source_id", F.col("host").alias("field"), on.alias("on_topic"), F.col("tier").isin(*C.STRONG_TIERS).alias("strong"), "published")
    return R.field_gaps(C.chunks(spark, d).select("source_id").join(s, "source_id"), NOW)


@query("a20_off_topic_queries", C.sql("sources", "SELECT query, count(*) AS examined, count(*) FILTER (hit) AS on_topic FROM (SELECT source_id % 40 AS query, coalesce(list_contains(topics, 't' || (source_id % 40 % 7)), false) AS hit FROM sources) GROUP BY query HAVING count(*) >= 5 AND count(*) FILTER (hit) < 0.5 * count(*)"))
def off_topic(spark, d):
    q = F.col("source_id") % 40
    return R.off_topic_queries(C.sources(spark, d).select(q.alias("query"), F.concat(F.lit("t"), (q % 7).cast("string")).alias("topic"), "topics"))


@query("a22_question_gaps", "SELECT item_id AS item, CASE WHEN item_id % 3 = 0 THEN item_id % 5 ELSE length(text) % 4 END AS grade FROM benchmark WHERE CASE WHEN item_id % 3 = 0 THEN item_id % 5 ELSE length(text) % 4 END < 2")
def question_gaps(spark, d):
    i = F.col("item_id")
    return R.question_gaps(C.table(spark, d, "benchmark").select(i.alias("item"), F.when(i % 3 == 0, i % 5).alias("grade"), (F.char_length("text") % 4).cast("long").alias("proposed")))


@query("a33_far_nodes", C.sql("vectors", ", n AS (SELECT chunk_id AS node, CASE WHEN chunk_id % 9 = 0 THEN 0 ELSE 3 END AS degree, CASE WHEN chunk_id % 7 <> 0 THEN round(abs(v[1]), 3) END AS distance FROM vectors), r AS (SELECT distance, row_number() OVER (ORDER BY distance DESC) AS i, count(*) OVER () AS k FROM n WHERE distance IS NOT NULL) SELECT node FROM n WHERE degree <= 0 OR distance >= (SELECT distance FROM r WHERE i = ceil(k * 0.25))"))
def far(spark, d):
    i = F.col("chunk_id")
    return R.far_nodes(C.vectors(spark, d).select(i.alias("node"), F.when(i % 9 == 0, 0).otherwise(3).alias("degree"), F.when(i % 7 != 0, F.round(F.abs(F.col("v")[0]), 3)).alias("distance")))


@query("a35_area_history", C.sql("sources", ", a AS (SELECT source_id % 3 AS level, source_id % 60 AS area, count(DISTINCT publisher) AS n, min(DATE '2024-02-01' - published) AS age FROM sources GROUP BY ALL) SELECT level, count(*) AS areas, count(*) FILTER (n < 3) AS weak, count(*) FILTER (age > 180) AS stale FROM a GROUP BY level"))
def areas(spark, d):
    a = C.sources(spark, d).groupBy((F.col("source_id") % 3).alias("level"), (F.col("source_id") % 60).alias("area"))
    return R.area_history(a.agg(F.count_distinct("publisher").alias("sources"), F.min(F.datediff(F.lit(NOW).cast("date"), F.col("published"))).alias("age")))


@query("a39_dominant_topic", C.sql("sources chunks", ", n AS (SELECT host, topics[1] AS topic, count(*) AS n FROM chunks JOIN sources USING (source_id) WHERE len(topics) > 0 GROUP BY ALL), g AS (SELECT host, min_by(topic, (-n, topic)) AS topic, max(n) AS n, sum(n)::BIGINT AS total FROM n GROUP BY host) SELECT * FROM g WHERE n >= 0.25 * total"))
def dominant(spark, d):
    s = C.sources(spark, d).where("size(topics) > 0").select("source_id", "host", F.col("topics")[0].alias("topic"))
    return R.dominant(C.chunks(spark, d).select("source_id").join(s, "source_id"), "host", "topic", 0.25)


@query("a54_evidence_area", C.sql("edges", ", n AS (SELECT src, dst, sum(support)::BIGINT AS k, count(*) AS n FROM edges GROUP BY ALL), g AS (SELECT src, min_by(dst, (-n, dst)) AS dst, max(n) AS n, sum(n)::BIGINT AS total FROM n GROUP BY src) SELECT * FROM g"))
def evidence_area(spark, d):
    return R.dominant(C.edges(spark, d).select("src", "dst"), "src", "dst")


@query("a40_rate_limit", "SELECT event_id AS call_id, coalesce(count(*) FILTER (event_type <> 'error') OVER w, 0) AS recent, coalesce(count(*) FILTER (event_type <> 'error') OVER w, 0) < 2 AS allowed FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING)")
def rate_limit(spark, d):
    e = C.table(spark, d, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("token"), "ts", (F.col("event_type") == "error").alias("refused"))
    return R.over_limit(e, 2, 86_400)


@query("a44_link_priorities", C.sql("queue sources", "SELECT task_id, CASE WHEN list_contains(topics, 't1') THEN priority + 20 ELSE greatest(priority - 20, 0) END AS priority FROM queue JOIN sources ON source_id = domain WHERE status = 'pending' AND topics IS NOT NULL"))
def link_priorities(spark, d):
    p = C.sources(spark, d).where("topics is not null").select(F.col("source_id").alias("parent"), F.array_contains("topics", "t1").alias("on_topic"))
    return R.reprioritised(C.queue(spark, d).withColumnRenamed("domain", "parent"), p)


@query("j10_url_join", "SELECT task, page_id FROM (SELECT o_orderkey AS task, 'https://site' || (o_custkey % 50) || '.example/p' || o_orderkey AS url FROM orders) q JOIN (SELECT page_id, 'https://site' || (page_id % 50) || '.example/p' || page_id AS url FROM pages) p USING (url)")
def url_join(spark, d):
    address = lambda site, page: F.concat(F.lit("https://site"), (F.col(site) % 50).cast("string"), F.lit(".example/p"), F.col(page).cast("string"))
    q = C.table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), address("o_custkey", "o_orderkey").alias("url"))
    return q.join(C.table(spark, d, "pages").select("page_id", address("page_id", "page_id").alias("url")), "url").select("task", "page_id")


@query("a46_may_ask_again", "SELECT 'q' || user_id AS query, max(ts) AS last FROM events GROUP BY user_id HAVING bool_or(event_type = 'view') AND max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def may_ask(spark, d):
    e = C.table(spark, d, "events")
    asks = e.select(F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query"), (F.col("event_type") == "view").alias("news"), "ts")
    return R.may_ask(asks, str(e.agg(F.max("ts")).first()[0]), 1)


@query("a48_open_pairs", C.sql("sources", "SELECT a.source_id AS pair_id, a.created_at FROM sources a JOIN sources b ON b.source_id = a.source_id + 1 WHERE a.source_id % 5 <> 0 AND a.trust = 'cleared' AND b.trust = 'cleared' ORDER BY a.created_at DESC, pair_id LIMIT 25"))
def open_pairs(spark, d):
    s = C.sources(spark, d)
    pairs = s.select(F.col("source_id").alias("pair_id"), F.col("source_id").alias("a"), (F.col("source_id") + 1).alias("b"), (F.col("source_id") % 5 == 0).alias("decided"), "created_at")
    return R.open_pairs(pairs, s.where("trust = 'cleared'").select(F.col("source_id").alias("id")), 25)


@query("a49_touched_nodes", C.sql("edges", ", h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey < 40), e AS (SELECT *, src || '|' || dst || '|' || relation || '|' || stance AS id FROM edges), t AS (SELECT * FROM e WHERE first_chunk IN (SELECT * FROM h)), b AS (SELECT src AS node, id, stance FROM t UNION ALL SELECT dst, id, stance FROM t) SELECT node, count(*) AS edges, bool_or(stance = 'opposes') AS contested FROM b GROUP BY node ORDER BY edges DESC, node LIMIT 12"))
def touched(spark, d):
    e = C.edges(spark, d).select("src", "dst", "relation", F.array("first_chunk").alias("cited"), (F.col("stance") == "opposes").alias("contested"))
    hits = C.table(spark, d, "lineitem").where("l_orderkey < 40").select(F.col("l_orderkey").alias("chunk_id")).distinct()
    return R.touched_nodes(e, hits)


@query("a50_tokens_today", "SELECT coalesce(sum(length(text)), 0)::BIGINT AS tokens FROM conversations WHERE conv_id % 30 = 0")
def tokens_today(spark, d):
    return C.table(spark, d, "conversations").where("conv_id % 30 = 0").agg(F.coalesce(F.sum(F.char_length("text").cast("long")), F.lit(0)).alias("tokens"))


@query("a56_map_rollup", C.sql("sources", ", c AS (SELECT host AS parent, publisher AS child, tier AS key, count(*) AS n FROM sources GROUP BY ALL), s AS (SELECT parent, key, sum(n)::BIGINT AS n FROM c GROUP BY ALL) SELECT parent, string_agg(key || '=' || n, ',' ORDER BY key) AS counts FROM s GROUP BY parent"))
def map_rollup(spark, d):
    n = C.sources(spark, d).groupBy("host", "publisher", "tier").agg(F.count("*").alias("n"))
    leaf = n.groupBy(F.col("host").alias("parent"), "publisher").agg(F.map_from_entries(F.collect_list(F.struct("tier", "n"))).alias("counts"))
    up = R.rolled_up(leaf)
    return up.select("parent", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("a58_provenance", "SELECT agent, coalesce(sum(n) FILTER (k = 'nodes'), 0)::BIGINT AS nodes, coalesce(sum(n) FILTER (k = 'relations'), 0)::BIGINT AS relations FROM (SELECT p_brand AS agent, 'nodes' AS k, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT p_brand, 'relations', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY agent")
def provenance(spark, d):
    p = C.table(spark, d, "part").select(F.col("p_brand").alias("agent"), "p_partkey")
    li = C.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return R.provenance({"nodes": p.select("agent"), "relations": li.join(p, "p_partkey").select("agent")})


@query("w1_newest_numbered", C.sql("sources", "SELECT source_id, row_number() OVER (ORDER BY created_at DESC, source_id) AS nth FROM sources ORDER BY nth LIMIT 60"))
def newest(spark, d):
    return R.numbered_newest(C.sources(spark, d).select("source_id", "created_at"), "created_at", "source_id", 60).select("source_id", "nth")


@query("w7_table_heads", C.sql("chunks", """, p AS (SELECT chunk_id, source_id, chunk_index, chunk_id % 3 <> 0 AS is_table, CASE WHEN chunk_id % 7 = 1 AND chunk_id % 3 <> 0 THEN 'head ' || chunk_index END AS head FROM chunks), r AS (SELECT *, sum(CASE WHEN is_table THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY chunk_index) AS run FROM p)
, f AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY source_id, run ORDER BY chunk_index ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS found FROM r) SELECT chunk_id, found AS head FROM f WHERE is_table AND head IS NULL AND found IS NOT NULL"""))
def heads(spark, d):
    i = F.col("chunk_id")
    table = i % 3 != 0
    head = F.when((i % 7 == 1) & table, F.concat(F.lit("head "), F.col("chunk_index").cast("string")))
    return R.table_heads(C.chunks(spark, d).select("chunk_id", "source_id", "chunk_index", table.alias("is_table"), head.alias("head")))


@query("o2_name_search", "SELECT id, name, alias FROM (SELECT p_partkey AS id, p_name AS name, p_size AS degree, CASE WHEN contains(lower(p_type), 'st') THEN p_type END AS alias FROM part) WHERE contains(lower(name), 'st') OR alias IS NOT NULL ORDER BY lower(name) = 'st' DESC, starts_with(lower(name), 'st') DESC, degree DESC, name, id LIMIT 30")
def name_search(spark, d):
    p = C.table(spark, d, "part")
    return R.name_search(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("degree"), F.array("p_type").alias("aliases")), "ST", 30)


@query("o5_id_sets", "WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_partkey)) AS p, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY l_orderkey) SELECT k, list_sort(list_distinct(list_concat(p, s))) AS either, list_sort(list_filter(p, lambda x: NOT list_contains(s, x))) AS only_parts FROM s")
def id_sets(spark, d):
    s = C.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("p"), F.collect_set("l_suppkey").alias("s"))
    return s.select("k", F.sort_array(F.array_union("p", "s")).alias("either"), F.sort_array(F.array_except("p", "s")).alias("only_parts"))


PLAN = "WITH c AS (SELECT DISTINCT p_brand AS kind, p_name AS query FROM part), f AS (SELECT *, md5('11:' || query) AS mix FROM c WHERE query NOT IN (SELECT p_name FROM part WHERE p_size = 7)), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY mix, query) AS nth FROM f) SELECT kind, query FROM r WHERE nth <= 20 ORDER BY nth, mix, query, kind LIMIT 20"


@query("x18_latest_proposals", C.sql("queue", ", r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY created_at DESC, task_id DESC) AS r FROM queue) SELECT topic, task_id AS proposal_id, CASE WHEN priority = 5 THEN 'lapse' WHEN created_at <= TIMESTAMP '1998-07-01' - INTERVAL 1 DAY THEN 'apply' ELSE 'wait' END AS action FROM r WHERE r = 1"))
def proposals(spark, d):
    p = C.queue(spark, d).select("topic", F.col("task_id").alias("proposal_id"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), (F.col("priority") != 5).alias("holds"))
    return R.latest_proposals(p, "1998-07-01", 1)


BACK = "WITH a AS (SELECT user_id AS task_id, max_by(CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'ok' ELSE 'gone' END, (ts, event_id)) AS outcome, greatest(count(*) FILTER (event_type = 'error'), 1) AS failures FROM events GROUP BY user_id)"


@query("x12_backoff", BACK + " SELECT task_id, CASE WHEN outcome = 'ok' THEN 'done' WHEN outcome = 'gone' OR failures >= 5 THEN 'abandon' ELSE 'retry' END AS disposition, CASE WHEN outcome = 'error' AND failures < 5 THEN least(60 * pow(2, failures - 1), 86400)::BIGINT END AS wait FROM a")
def backoff(spark, d):
    e = C.table(spark, d, "events")
    what = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "ok").otherwise("gone")
    a = e.groupBy(F.col("user_id").alias("task_id")).agg(F.max_by(what, F.struct("ts", "event_id")).alias("outcome"), F.greatest(F.count_if(F.col("event_type") == "error"), F.lit(1)).alias("failures"))
    return R.backed_off(a)


@query("x11_backpressure", "WITH q AS (SELECT user_id, ts, event_id, round(value, 2) AS v FROM events), c AS (SELECT *, CASE WHEN v > 60 THEN true WHEN v < 48 THEN false END AS x FROM q) SELECT event_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS paused FROM c")
def backpressure(spark, d):
    e = C.table(spark, d, "events").select("user_id", "event_id", F.round("value", 2).alias("v"))
    return R.paused(e, "user_id", "event_id", "v", 60.0).select("event_id", "paused")


@query("x14_render_need", "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id, count(*) AS n FROM events JOIN l USING (user_id) WHERE event_type = 'error' AND ts > last - INTERVAL 7 DAY GROUP BY user_id HAVING count(*) >= 3")
def render_need(spark, d):
    return R.needs_rendering(C.table(spark, d, "events").select("user_id", "ts", (F.col("event_type") == "error").alias("bad")), "user_id", "ts", "bad")


@query("x20_new_since", C.sql("sources", "SELECT created_at::DATE AS day, count(*) AS n FROM sources WHERE created_at::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY day"))
def new_since(spark, d):
    return R.new_since(C.sources(spark, d), "2024-01-05", "2024-01-20")


@query("r21_by_country", "SELECT coalesce(n_name, place, 'unplaced') AS country, count(DISTINCT o_orderkey) AS sources, max(o_totalprice)::DOUBLE AS best FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_custkey % 4 = 0 THEN 'elsewhere' ELSE c_name END AS place, c_name AS cn, c_nationkey AS nk FROM orders JOIN customer ON o_custkey = c_custkey) LEFT JOIN nation ON place = cn AND nk = n_nationkey GROUP BY 1")
def by_country(spark, d):
    o, c, n = (C.table(spark, d, t) for t in ("orders", "customer", "nation"))
    place = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).when(F.col("o_custkey") % 4 == 0, "elsewhere").otherwise(F.col("c_name"))
    items = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("source_id"), F.col("o_totalprice").cast("double").alias("score"), place.alias("place"))
    cities = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("city"), F.col("n_name").alias("country"))
    return R.by_country(items, cities)


@query("r24_leading_topics", C.sql("sources", "SELECT topic, count(*) AS sources FROM (SELECT DISTINCT source_id, unnest(topics) AS topic FROM sources) GROUP BY topic ORDER BY sources DESC, topic LIMIT 3"))
def leading(spark, d):
    return R.leading_topics(C.sources(spark, d))


@query("r7_stable_rank", C.sql("chunks", "SELECT chunk_id, row_number() OVER (ORDER BY length(text) % 50 DESC, chunk_id) AS rank FROM chunks ORDER BY rank LIMIT 100"))
def stable(spark, d):
    top = C.chunks(spark, d).select("chunk_id", (F.char_length("text") % 50).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(100)
    return S._ranked(top, "chunk_id").select("chunk_id", "rank")


@query("r16_page_window", C.sql("chunks", ", t AS (SELECT chunk_id, row_number() OVER (ORDER BY length(text) % 50 DESC, chunk_id) AS rank FROM chunks) SELECT chunk_id, rank, (SELECT count(*) FROM t) > 30 AS has_more FROM t WHERE rank > 20 AND rank <= 30"))
def window(spark, d):
    ranked = C.chunks(spark, d).select("chunk_id", (F.char_length("text") % 50).cast("double").alias("score"))
    return S.page(ranked, offset=20, limit=10)


@query("o7_fresh_plan", PLAN)
def plan(spark, d):
    p = C.table(spark, d, "part")
    asked = p.where("p_size = 7").select(F.col("p_name").alias("query"))
    return R.fresh_plan(p.select(F.col("p_brand").alias("kind"), F.col("p_name").alias("query")), asked, 11, 20)
