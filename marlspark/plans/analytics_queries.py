"""Corpus reports over the adapter views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import dedupe as D
from ..sources import corpus as C
from .registry import query


@query("a1_corpus_stats", C.sql("sources", "SELECT count(*) AS sources, count(*) FILTER (retention = 'kept') AS kept, count(*) FILTER (retention = 'kept' AND trust = 'cleared') AS readable, count(DISTINCT host) AS hosts, count(*) FILTER (created_at >= TIMESTAMP '2024-01-25') AS recent, count(topics) AS examined FROM sources"))
def stats(spark, d):
    return C.sources(spark, d).agg(
        F.count("*").alias("sources"), F.count_if(F.col("retention") == "kept").alias("kept"), F.count_if((F.col("retention") == "kept") & (F.col("trust") == "cleared")).alias("readable"),
        F.count_distinct("host").alias("hosts"), F.count_if(F.col("created_at") >= F.expr("timestamp_ntz'2024-01-25 00:00:00'")).alias("recent"), F.count("topics").alias("examined"))


@query("a3_duplicate_share", C.sql("chunks", """, m AS (SELECT md5(text) AS k, min(chunk_id) AS first FROM chunks GROUP BY 1)
SELECT source_id, count(*) AS n, count(*) FILTER (chunk_id <> first) AS copies FROM chunks JOIN m ON md5(text) = k GROUP BY source_id HAVING count(*) FILTER (chunk_id <> first) >= 0.9 * count(*)"""))
def duplicate_share(spark, d):
    c = C.chunks(spark, d).select("source_id", "chunk_id", F.md5("text").alias("k"))
    first = c.groupBy("k").agg(F.min("chunk_id").alias("first"))
    s = c.join(first, "k").groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("chunk_id") != F.col("first")).alias("copies"))
    return s.where("copies >= 0.9 * n")


@query("a4_vector_means", C.sql("vectors", "SELECT source_id, i AS dim, round(avg(v[i + 1]), 6) AS mean FROM vectors, (SELECT unnest(range(64)) AS i) GROUP BY ALL"))
def vector_means(spark, d):
    e = C.vectors(spark, d).select("source_id", F.posexplode("v").alias("dim", "x"))
    return e.groupBy("source_id", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query("a5_boilerplate_lines", C.sql("sources chunks", """, x AS (SELECT DISTINCT host, c.source_id, md5(trim(c.text)) AS line FROM chunks c JOIN sources USING (source_id)), s AS (SELECT host, count(DISTINCT source_id) AS pages FROM x GROUP BY ALL)
SELECT host, line, n FROM (SELECT host, line, count(*) AS n FROM x GROUP BY ALL) JOIN s USING (host) WHERE n >= 3 AND n >= 0.05 * pages"""))
def boilerplate(spark, d):
    rows = C.chunks(spark, d).join(C.sources(spark, d).select("source_id", "host"), "source_id").select("host", F.col("source_id").alias("page_id"), F.md5(F.trim("text")).alias("line"))
    return D.boilerplate(rows, pages=3, share=0.05)


@query("a6_host_scores", C.sql("sources", "SELECT host, count(topics) AS examined, count(*) FILTER (list_has_any(topics, ['t1', 't2'])) AS on_topic, count(*) FILTER (topics IS NULL) AS pending, count(DISTINCT publisher) AS vouched FROM sources GROUP BY host"))
def host_scores(spark, d):
    hit = F.coalesce(F.arrays_overlap("topics", F.array(F.lit("t1"), F.lit("t2"))), F.lit(False))
    return C.sources(spark, d).groupBy("host").agg(F.count("topics").alias("examined"), F.count_if(hit).alias("on_topic"), F.count_if(F.col("topics").isNull()).alias("pending"), F.count_distinct("publisher").alias("vouched"))


@query("a7_site_counts", C.sql("sources", "SELECT host, count(*) AS n, max(published) AS newest FROM sources GROUP BY host ORDER BY n DESC, host LIMIT 10"))
def site_counts(spark, d):
    return C.sources(spark, d).groupBy("host").agg(F.count("*").alias("n"), F.max("published").alias("newest")).orderBy(F.desc("n"), "host").limit(10)


@query("a8_topic_sets", C.sql("sources", "SELECT list_sort(topics) AS topics, count(*) AS n FROM sources WHERE len(topics) > 0 GROUP BY list_sort(topics)"))
def topic_sets(spark, d):
    return C.sources(spark, d).where(F.size("topics") > 0).groupBy(F.sort_array("topics").alias("topics")).agg(F.count("*").alias("n"))


@query("a9_topic_cards", C.sql("sources", ", t AS (SELECT unnest(topics) AS topic, * EXCLUDE (topics) FROM sources) SELECT topic, count(*) AS n, max_by(source_id, (published, source_id)) FILTER (published <= DATE '2024-02-01') AS newest FROM t GROUP BY topic"))
def topic_cards(spark, d):
    t = C.sources(spark, d).select(F.explode("topics").alias("topic"), "source_id", "published")
    dated = F.when(F.col("published") <= F.lit("2024-02-01").cast("date"), F.struct("published", "source_id"))
    return t.groupBy("topic").agg(F.count("*").alias("n"), F.max_by("source_id", dated).alias("newest"))


@query("a10_growth_by_day", C.sql("sources", "SELECT CAST(d AS DATE) AS day, count(source_id) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY)) AS d) LEFT JOIN sources ON CAST(created_at + INTERVAL 8 HOUR AS DATE) = CAST(d AS DATE) GROUP BY ALL"))
def growth(spark, d):
    return A.daily(C.sources(spark, d), "created_at", "2024-01-01", 35, zone_hours=8)


@query("a10_new_hosts_by_day", C.sql("sources", "SELECT day, count(*) AS n FROM (SELECT host, CAST(min(created_at) AS DATE) AS day FROM sources GROUP BY host) GROUP BY day"))
def new_hosts(spark, d):
    first = C.sources(spark, d).groupBy("host").agg(F.to_date(F.min("created_at")).alias("day"))
    return first.groupBy("day").agg(F.count("*").alias("n"))


@query("a11_crawl_health", C.sql("attempts", """SELECT g.ago, g.outcome, count(a.attempt_id) AS n FROM (SELECT h AS ago, outcome FROM (SELECT unnest(range(24)) AS h), (SELECT DISTINCT outcome FROM attempts)) g
LEFT JOIN attempts a ON a.outcome = g.outcome AND CAST(floor((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(a.attempted_at)) / 3600000000) AS BIGINT) = g.ago AND a.attempted_at <= TIMESTAMP '2024-01-20' GROUP BY ALL"""))
def health(spark, d):
    return A.hour_buckets(C.attempts(spark, d), "attempted_at", "2024-01-20 00:00:00", "outcome")


@query("a12_success_rate", C.sql("attempts", "SELECT domain, count(*) AS n, round(count(*) FILTER (outcome <> 'error') / count(*), 4) AS rate FROM attempts GROUP BY domain"))
def success(spark, d):
    return C.attempts(spark, d).groupBy("domain").agg(F.count("*").alias("n"), A.rate(F.count_if(F.col("outcome") != "error"), F.count("*")).alias("rate"))


@query("a13_all_refused", C.sql("attempts", "SELECT domain * 1000 + attempt_id % 97 AS k, count(*) AS n FROM attempts GROUP BY 1 HAVING count(*) >= 3 AND bool_and(outcome <> 'purchase')"))
def refused(spark, d):
    a = C.attempts(spark, d).withColumn("k", F.col("domain") * 1000 + F.col("attempt_id") % 97)
    return A.all_refused(a, "k", F.col("outcome") != "purchase", least=3)


@query("a14_queue_depth", C.sql("queue", "SELECT status, topic, count(*) AS n, min(created_at) AS oldest FROM queue GROUP BY ALL"))
def depth(spark, d):
    return C.queue(spark, d).groupBy("status", "topic").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


GAPS = """, s AS (SELECT topic, count(*) AS n, count(*) FILTER (tier IN ('peer_reviewed', 'government')) AS s, max(published) AS newest FROM (SELECT unnest(topics) AS topic, tier, published FROM sources WHERE source_id % 9 = 0) GROUP BY topic)
SELECT topic, CASE WHEN n < 30 THEN 'thin' ELSE 'weak' END AS gap, round(CASE WHEN n < 30 THEN 0.6 + 0.4 * (1 - n / 30) ELSE 0.35 + 0.2 * (1 - s / 9) END, 6) AS severity FROM s WHERE n < 30 OR s < 9
UNION ALL SELECT topic, 'stale', 0.3 FROM s WHERE DATE '2028-01-01' - newest > 1095"""


@query("a15_coverage_gaps", C.sql("sources", GAPS.replace(" WHERE source_id % 9 = 0", "")))
def gaps(spark, d):
    return A.coverage_gaps(C.sources(spark, d), "2028-01-01", thin=30, strong=9)


@query("a16_on_topic_passages", C.sql("sources chunks", "SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic, chunk_id FROM sources JOIN chunks USING (source_id) UNION SELECT 't' || (chunk_id % 7), chunk_id FROM chunks) GROUP BY topic"))
def on_topic(spark, d):
    c = C.chunks(spark, d).select("chunk_id", "source_id")
    by_source = c.join(C.sources(spark, d).select("source_id", F.explode("topics").alias("topic")), "source_id").select("topic", "chunk_id")
    own = c.select(F.concat(F.lit("t"), (F.col("chunk_id") % 7).cast("string")).alias("topic"), "chunk_id")
    return by_source.union(own).distinct().groupBy("topic").agg(F.count("*").alias("n"))


@query("a17_topic_place_grid", C.sql("sources", ", t AS (SELECT unnest(topics) AS topic, language AS place, source_id FROM sources) SELECT a.topic, b.place, count(t.source_id) AS n FROM (SELECT DISTINCT topic FROM t) a CROSS JOIN (SELECT DISTINCT language AS place FROM sources) b LEFT JOIN t ON t.topic = a.topic AND t.place = b.place GROUP BY ALL"))
def grid(spark, d):
    s = C.sources(spark, d)
    t = s.select(F.explode("topics").alias("topic"), F.col("language").alias("place"))
    cells = t.groupBy("topic", "place").agg(F.count("*").alias("n"))
    # the grid is topics by places, both vocabularies
    dense = cells.select("topic").distinct().crossJoin(s.select(F.col("language").alias("place")).distinct())
    return dense.join(cells, ["topic", "place"], "left").select("topic", "place", F.coalesce("n", F.lit(0)).alias("n"))


@query("a19_search_yield", C.sql("queue", "SELECT topic, CASE WHEN priority = 1 THEN 'empty' WHEN priority = 2 THEN 'known' ELSE 'fresh' END AS yield, count(*) AS n FROM queue GROUP BY ALL"))
def yields(spark, d):
    return C.queue(spark, d).groupBy("topic", F.when(F.col("priority") == 1, "empty").when(F.col("priority") == 2, "known").otherwise("fresh").alias("yield")).agg(F.count("*").alias("n"))


@query("a23_gap_ranking", C.sql("sources", GAPS.replace(" WHERE source_id % 9 = 0", "") + " ORDER BY severity DESC, topic, gap LIMIT 8"))
def gap_ranking(spark, d):
    return A.coverage_gaps(C.sources(spark, d), "2028-01-01", thin=30, strong=9).orderBy(F.desc("severity"), "topic", "gap").limit(8)


@query("a24_area_rollup", "SELECT r_name, n_name, count(*) AS members, count(DISTINCT c_mktsegment) AS kinds, round(max(c_acctbal), 2) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def areas(spark, d):
    c, n, r = (C.table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("members"), F.count_distinct("c_mktsegment").alias("kinds"), F.round(F.max("c_acctbal"), 2).alias("top"))


@query("a25_wilson_audit", """WITH t AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS w FROM labels JOIN documents USING (doc_id) GROUP BY source),
x AS (SELECT *, c + w AS n, c / (c + w) AS p, 1.959963984540054 AS z FROM t)
SELECT source, c AS correct, w AS wrong, CASE WHEN n > 0 THEN round(p, 6) END AS precision, CASE WHEN n > 0 THEN round(least(1.0, greatest(0.0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n))), 6) END AS low,
CASE WHEN n > 0 THEN round(least(1.0, greatest(0.0, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n))), 6) END AS high FROM x""")
def audit(spark, d):
    t = C.table(spark, d, "labels").join(C.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    t = t.groupBy("source").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("correct"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("wrong"))
    p, low, high = A.wilson(F.col("correct"), F.col("wrong"))
    return t.select("source", "correct", "wrong", p.alias("precision"), low.alias("low"), high.alias("high"))


@query("a26_discrimination", """WITH c AS (SELECT p_brand, p_size, count(*) AS c FROM part GROUP BY ALL), t AS (SELECT p_brand, sum(c)::BIGINT AS n, count(*) AS k, sum(c * ln(c)) AS cl FROM c GROUP BY ALL), h AS (SELECT *, (ln(n) - cl / n) / ln(greatest(k, 2)) AS h FROM t)
SELECT p_brand, n, k, round(CASE WHEN n < 4 THEN NULL WHEN k = 1 THEN 0.0 WHEN 2 * k > n THEN h * 2 * (n - k) / n ELSE h END, 6) AS discrimination FROM h""")
def discrimination(spark, d):
    return A.entropy(C.table(spark, d, "part"), "p_brand", "p_size")


@query("a29_values_in_use", "SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE r <= 8")
def in_use(spark, d):
    v = C.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return A.top_per_group(v, ["p_brand"], [F.desc("n"), F.col("p_type")], 8)


@query("a30_month_to_date", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY ALL")
def monthly(spark, d):
    return C.table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("cost"))


@query("a31_degree_and_mix", C.sql("edges", "SELECT node, sum(deg)::BIGINT AS degree, sum(sup)::BIGINT AS supports FROM (SELECT src AS node, count(*) AS deg, count(*) FILTER (stance = 'supports') AS sup FROM edges GROUP BY 1 UNION ALL SELECT dst, count(*), count(*) FILTER (stance = 'supports') FROM edges GROUP BY 1) GROUP BY node"))
def degree(spark, d):
    e = C.edges(spark, d)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node"), (F.col("stance") == "supports").cast("long").alias("s"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("s").alias("supports"))


@query("a32_tier_imbalance", C.sql("sources", """, c AS (SELECT publisher, tier, count(*) AS n FROM sources GROUP BY ALL) SELECT publisher, max_by(tier, (n, tier)) AS dominant, sum(n)::BIGINT AS total, round(max(n) / sum(n), 6) AS share, count(*) AS tiers FROM c GROUP BY publisher HAVING sum(n) >= 3 AND max(n) >= 0.3 * sum(n)"""))
def imbalance(spark, d):
    c = C.sources(spark, d).groupBy("publisher", "tier").agg(F.count("*").alias("n"))
    s = c.groupBy("publisher").agg(F.max_by("tier", F.struct("n", "tier")).alias("dominant"), F.sum("n").alias("total"), F.round(F.max("n") / F.sum("n"), 6).alias("share"), F.count("*").alias("tiers"), F.max("n").alias("m"))
    return s.where("total >= 3 and m >= 0.3 * total").drop("m")


@query("a34_steering_measure", C.sql("queue attempts", ", f AS (SELECT domain % 7 AS topic, count(*) AS fetched, count(*) FILTER (outcome = 'purchase') AS got FROM attempts GROUP BY 1) SELECT topic, fetched, got, round(fetched / sum(fetched) OVER (), 6) AS share, CASE WHEN fetched < 0.9 * avg(fetched) OVER () THEN 'boost' WHEN got < 0.19 * fetched THEN 'lower' ELSE 'keep' END AS proposal FROM f"))
def steering(spark, d):
    f = C.attempts(spark, d).groupBy((F.col("domain") % 7).alias("topic")).agg(F.count("*").alias("fetched"), F.count_if(F.col("outcome") == "purchase").alias("got"))
    w = Window.partitionBy(F.lit(1))  # seven rows
    return f.select("topic", "fetched", "got", F.round(F.col("fetched") / F.sum("fetched").over(w), 6).alias("share"), F.when(F.col("fetched") < 0.9 * F.avg("fetched").over(w), "boost").when(F.col("got") < 0.19 * F.col("fetched"), "lower").otherwise("keep").alias("proposal"))


@query("a38_score_histogram", "SELECT CASE WHEN s < -0.2 THEN 'a' WHEN s < -0.05 THEN 'b' WHEN s < 0.05 THEN 'c' WHEN s < 0.2 THEN 'd' ELSE 'e' END AS bin, count(*) AS n FROM (SELECT CAST(embedding[1] AS DOUBLE) AS s FROM embeddings) GROUP BY ALL")
def histogram(spark, d):
    s = F.element_at("v", 1)
    return C.vectors(spark, d).groupBy(F.when(s < -0.2, "a").when(s < -0.05, "b").when(s < 0.05, "c").when(s < 0.2, "d").otherwise("e").alias("bin")).agg(F.count("*").alias("n"))


@query("a41_contested_leaders", C.sql("edges", """, p AS (SELECT a.src, a.dst, a.relation FROM edges a JOIN edges b ON a.src = b.src AND a.dst = b.dst AND a.relation = b.relation AND a.stance = 'supports' AND b.stance = 'opposes') SELECT src AS node, count(*) AS n FROM p GROUP BY src ORDER BY n DESC, node LIMIT 10"""))
def contested_leaders(spark, d):
    e = C.edges(spark, d).groupBy("src", "dst", "relation").agg(F.count_distinct("stance").alias("sides")).where("sides = 2")
    return e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(10)


@query("a42_json_explode", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def json_sum(spark, d):
    return C.table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count("*").alias("n"))


@query("a45_commonest_topic", C.sql("sources", ", t AS (SELECT host, topic, count(*) AS n FROM (SELECT host, unnest(topics) AS topic FROM sources) GROUP BY ALL) SELECT host, min_by(topic, (-n, topic)) AS topic FROM t GROUP BY host"))
def commonest(spark, d):
    t = C.sources(spark, d).select("host", F.explode("topics").alias("topic")).groupBy("host", "topic").agg(F.count("*").alias("n"))
    return t.groupBy("host").agg(F.min_by("topic", F.struct(-F.col("n"), F.col("topic"))).alias("topic"))


@query("a47_retention_cut", C.sql("attempts", "SELECT count(*) FILTER (attempted_at < TIMESTAMP '2024-01-10') AS pruned, count(*) FILTER (attempted_at >= TIMESTAMP '2024-01-10') AS kept FROM attempts"))
def pruning(spark, d):
    old = F.col("attempted_at") < F.expr("timestamp_ntz'2024-01-10 00:00:00'")
    return C.attempts(spark, d).agg(F.count_if(old).alias("pruned"), F.count_if(~old).alias("kept"))


@query("a51_due_watches", C.sql("attempts", "SELECT domain FROM attempts GROUP BY domain HAVING max(attempted_at) < TIMESTAMP '2024-01-30' - INTERVAL 12 HOUR"))
def due(spark, d):
    return C.attempts(spark, d).groupBy("domain").agg(F.max("attempted_at").alias("last")).where("last < timestamp_ntz'2024-01-29 12:00:00'").select("domain")


@query("a55_ordered_first_value", "SELECT o_custkey, min(o_orderkey) AS first, min_by(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS priority, max(o_orderdate) AS last FROM orders GROUP BY o_custkey")
def first_value(spark, d):
    return C.table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.min_by("o_orderpriority", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("priority"), F.max("o_orderdate").alias("last"))


@query("a57_recent_domains", C.sql("attempts", "SELECT domain, max(attempted_at) AS last FROM attempts GROUP BY domain ORDER BY last DESC, domain LIMIT 8"))
def recent(spark, d):
    return C.attempts(spark, d).groupBy("domain").agg(F.max("attempted_at").alias("last")).orderBy(F.desc("last"), "domain").limit(8)


@query("w3_rank_nulls_last", C.sql("sources", "SELECT source_id, row_number() OVER (PARTITION BY host ORDER BY published DESC NULLS LAST, source_id) AS r FROM sources QUALIFY r <= 4"))
def nulls_last(spark, d):
    s = C.sources(spark, d).select("source_id", "host", "published")
    return s.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc_nulls_last("published"), "source_id")).cast("long")).where("r <= 4").select("source_id", "r")


@query("w5_distinct_on", C.sql("edges", "SELECT DISTINCT ON (src) src, dst, support FROM edges WHERE stance = 'supports' AND relation = 'increases' ORDER BY src, support DESC, dst"))
def distinct_on(spark, d):
    e = C.edges(spark, d).where("stance = 'supports' and relation = 'increases'").select("src", "dst", "support")
    return A.top_per_group(e, ["src"], [F.desc("support"), F.col("dst")], 1)


@query("w9_gap_statistics", C.sql("chunks", "SELECT source_id, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS sd, median(g) AS med FROM (SELECT source_id, chunk_index - lag(chunk_index) OVER (PARTITION BY source_id ORDER BY chunk_index) AS g FROM chunks) WHERE g IS NOT NULL GROUP BY ALL"))
def gap_stats(spark, d):
    g = F.col("chunk_index") - F.lag("chunk_index").over(Window.partitionBy("source_id").orderBy("chunk_index"))
    c = C.chunks(spark, d).select("source_id", g.alias("g")).where("g is not null")
    return c.groupBy("source_id").agg(F.round(F.avg("g"), 6).alias("mean"), F.round(F.stddev_pop("g"), 6).alias("sd"), F.median("g").alias("med"))


@query("x13_failure_runs", C.sql("attempts", ", i AS (SELECT domain, outcome, sum(CASE WHEN outcome = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY domain ORDER BY attempted_at, attempt_id) AS island FROM attempts), r AS (SELECT domain, island, count(*) FILTER (outcome = 'error') AS n FROM i GROUP BY ALL) SELECT domain, max(n) AS longest, max_by(n, island) AS current FROM r GROUP BY domain"))
def runs(spark, d):
    return A.failure_runs(C.attempts(spark, d), "domain", "attempted_at", "attempt_id", F.col("outcome") == "error")


@query("x16_cooldown", C.sql("attempts", "SELECT attempt_id FROM (SELECT *, lag(attempted_at) OVER (PARTITION BY domain ORDER BY attempted_at, attempt_id) AS b FROM attempts) WHERE b IS NULL OR attempted_at - b >= INTERVAL 6 HOUR"))
def cooldown(spark, d):
    return A.cooled_down(C.attempts(spark, d), "domain", "attempted_at", "attempt_id", hours=6).select("attempt_id")


@query("x17_clamped_shares")
def shares(spark, d):
    w = C.table(spark, d, "part").groupBy(F.col("p_type").alias("topic")).agg(F.count("*").cast("double").alias("weight")).withColumns({"floor": F.lit(0.02), "ceiling": F.lit(0.2)})
    return A.clamp_shares(w)


@query("r19_best_passage_per_source", C.sql("chunks", "SELECT source_id, max_by(chunk_id, (length(text) >= 120, length(text) % 10, -chunk_id)) AS best, count(*) AS passages FROM chunks GROUP BY source_id"))
def best_passage(spark, d):
    from ..operators.search import best_per_source

    return best_per_source(C.chunks(spark, d).withColumn("score", F.char_length("text") % 10))


@query("r20_verdict", C.sql("sources", "SELECT host, count(DISTINCT publisher) AS publishers, CASE WHEN count(DISTINCT publisher) >= 3 AND bool_or(tier IN ('peer_reviewed', 'government')) THEN 'strong' ELSE 'thin' END AS verdict FROM sources GROUP BY host"))
def verdicts(spark, d):
    from ..operators.search import verdict

    return verdict(C.sources(spark, d), "host")


@query("r22_lead_items", C.sql("sources", ", s AS (SELECT *, (n_chars % 1000) / 1000.0 * CASE tier WHEN 'government' THEN 1.2 WHEN 'news' THEN 0.9 ELSE 1.0 END AS value FROM sources) SELECT source_id, round(value * pow(0.5, row_number() OVER (PARTITION BY publisher ORDER BY value DESC, source_id) - 1), 8) AS lead FROM s ORDER BY lead DESC, source_id LIMIT 12"))
def leads(spark, d):
    from ..operators.search import lead_items

    s = C.sources(spark, d).select("source_id", "publisher", "tier", ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    return lead_items(s, {"government": 1.2, "news": 0.9}, 12).select("source_id", "lead")


_DRAW = """WITH i AS (SELECT event_id, event_type AS stratum FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'), p AS (SELECT stratum, count(*) AS n FROM i GROUP BY stratum), s AS (SELECT least(101, sum(n)) AS size, sum(n) AS total FROM p)
, w AS (SELECT stratum, n, size, size * n // total AS whole, size * n % total AS rest FROM p, s), d AS (SELECT stratum, n, (whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= size - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS take FROM w)
, t AS (SELECT stratum, event_id, row_number() OVER (PARTITION BY stratum ORDER BY md5('2024w3:' || event_id), event_id) AS position FROM i), q AS (SELECT stratum, event_id, position, n, take FROM t JOIN d USING (stratum) WHERE position <= take)"""


@query("a52_audit_draw", _DRAW + " SELECT stratum, event_id, position, n, take FROM q")
def audit_draw(spark, d):
    from ..operators import audits as U

    return U.draw(C.table(spark, d, "events").withColumn("stratum", F.col("event_type")), "event_id", "stratum", 101, "2024w3", "ts", "2024-01-05", "2024-01-25")


@query("a52_audit_report", _DRAW + """, g AS (SELECT stratum, any_value(n) AS n, count(*) AS drawn, count(*) FILTER (value <= 150) AS graded, count(*) FILTER (value <= 100) AS "right" FROM q JOIN events USING (event_id) GROUP BY stratum)
SELECT stratum, n, drawn, graded, "right", round("right" / nullif(graded, 0), 6) AS share, CASE WHEN graded > 0 THEN round(greatest(0, "right" / graded + 1.96 * 1.96 / (2 * graded) - 1.96 * sqrt("right" / graded * (1 - "right" / graded) / graded + 1.96 * 1.96 / (4.0 * graded * graded))) / (1 + 1.96 * 1.96 / graded), 6) END AS low,
  CASE WHEN graded > 0 THEN round(("right" / graded + 1.96 * 1.96 / (2 * graded) + 1.96 * sqrt("right" / graded * (1 - "right" / graded) / graded + 1.96 * 1.96 / (4.0 * graded * graded))) / (1 + 1.96 * 1.96 / graded), 6) END AS high FROM g""")
def audit_report(spark, d):
    from ..operators import audits as U

    e = C.table(spark, d, "events")
    grades = e.select("event_id", F.when(F.col("value") <= 150, F.col("value") <= 100).alias("right"))
    return U.report(audit_draw(spark, d), grades, "event_id", "stratum")
