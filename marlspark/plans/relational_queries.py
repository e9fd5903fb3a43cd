"""The relational surface on the star schema: joins, aggregates, windows, set operations, pivots, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.corpus import table as T
from .registry import query


@query("rel_pricing_summary", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing(spark, d):
    li = T(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("rel_inner_join", """
SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def inner_join(spark, d):
    o, c, n, r = (T(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    per = o.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("t"))  # summed before it is joined
    j = per.join(c, per.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.sum("k").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("rel_left_join", "SELECT c_mktsegment, count(*) AS rows, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY ALL")
def left_join(spark, d):
    c, o = T(spark, d, "customer"), T(spark, d, "orders").where("o_totalprice > 200000")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_mktsegment").agg(F.count("*").alias("rows"), F.count("o_orderkey").alias("orders"))


@query("rel_full_outer_join", """
SELECT coalesce(a.k, b.k) AS k, a.n AS parts, b.n AS suppliers
FROM (SELECT p_size % 40 AS k, count(*) AS n FROM part GROUP BY ALL) a FULL JOIN (SELECT CAST(s_nationkey * 2 AS INTEGER) AS k, count(*) AS n FROM supplier GROUP BY ALL) b ON a.k = b.k""")
def full_join(spark, d):
    a = T(spark, d, "part").groupBy((F.col("p_size") % 40).alias("k")).agg(F.count("*").alias("parts"))
    b = T(spark, d, "supplier").groupBy((F.col("s_nationkey") * 2).alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@query("rel_semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(spark, d):
    o = T(spark, d, "orders").where("o_orderstatus = 'P'")
    c = T(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("rel_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)")
def anti_join(spark, d):
    p, li = T(spark, d, "part"), T(spark, d, "lineitem").where("l_quantity = 50")
    return p.join(li, p.p_partkey == li.l_partkey, "left_anti").select("p_partkey")


@query("rel_range_join", """
SELECT c_mktsegment, band, count(*) AS n FROM customer JOIN (VALUES (0, -1000.0, 0.0), (1, 0.0, 2500.0), (2, 2500.0, 7500.0), (3, 7500.0, 10000.0)) b(band, lo, hi) ON c_acctbal >= lo AND c_acctbal < hi GROUP BY ALL""")
def range_join(spark, d):
    bands = spark.createDataFrame([(0, -1000.0, 0.0), (1, 0.0, 2500.0), (2, 2500.0, 7500.0), (3, 7500.0, 10000.0)], "band int, lo double, hi double")
    return R.range_join(T(spark, d, "customer"), bands, "c_acctbal", "lo", "hi", width=2500.0).groupBy("c_mktsegment", "band").agg(F.count("*").alias("n"))


@query("rel_asof_join", """
SELECT e.event_id, max_by(p.event_id, (p.ts, p.event_id)) AS last_view
FROM (SELECT * FROM events WHERE event_type = 'purchase') e
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON p.user_id = e.user_id AND p.ts <= e.ts GROUP BY e.event_id""")
def asof(spark, d):
    e = T(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"))
    return R.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, by="user_id", on="ts", value="last_view").select("event_id", "last_view")


@query("rel_interval_join", """
SELECT a.user_id, count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click'
AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR GROUP BY ALL""")
def interval_join(spark, d):
    e = T(spark, d, "events").select("user_id", "ts", "event_type")
    a, b = e.where("event_type = 'error'"), e.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("ts").alias("t"))
    return R.interval_join(a, b, "user_id", "u", "ts", "t", seconds=3600).groupBy("user_id").agg(F.count("*").alias("pairs"))


@query("rel_cube", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return T(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("gid"), F.sum("l_quantity").alias("qty"))


@query("rel_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup(spark, d):
    c, n = T(spark, d, "customer"), T(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))


@query("rel_grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
def grouping_sets(spark, d):
    return T(spark, d, "part").groupingSets([["p_brand"], ["p_size"], []], "p_brand", "p_size").agg(F.count("*").alias("n"))


@query("rel_rank_functions", """
SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn,
       ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS quarter, round(cume_dist() OVER w, 9) AS cd
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def ranks(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    u = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return T(spark, d, "orders").select(
        "o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.row_number().over(u).cast("long").alias("rn"), F.ntile(4).over(u).cast("long").alias("quarter"), F.round(F.cume_dist().over(w), 9).alias("cd")
    )


@query("rel_lag_lead", """
SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, first_value(event_type) OVER w AS first, last_value(event_type) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return T(spark, d, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.first("event_type").over(w).alias("first"), F.last("event_type").over(whole).alias("last"))


@query("rel_rows_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS top FROM events")
def rows_frame(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return T(spark, d, "events").select("event_id", F.count("*").over(w).alias("n"), F.max("value").over(w).alias("top"))


@query("rel_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events")
def range_frame(spark, d):
    # frames by type would put a fifth of all rows into one task; by type and day they stay even, with the hour before carried over
    return R.trailing_count(T(spark, d, "events"), "event_id", "event_type", "ts", seconds=3600, alias="n")


@query("rel_intersect", "SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return T(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(T(spark, d, "supplier").select("s_nationkey"))


@query("rel_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, d):
    return T(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(T(spark, d, "supplier").select("s_nationkey"))


@query("rel_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09")
def except_(spark, d):
    return T(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(T(spark, d, "lineitem").where("l_discount > 0.09").select("l_partkey"))


@query("rel_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, d):
    return T(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(T(spark, d, "supplier").select("s_nationkey"))


@query("rel_pivot", """
SELECT n_name, coalesce(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END), 0)::BIGINT AS building, coalesce(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 END), 0)::BIGINT AS machinery
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def pivot(spark, d):
    c, n = T(spark, d, "customer"), T(spark, d, "nation")
    p = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return p.select("n_name", F.coalesce("BUILDING", F.lit(0)).cast("long").alias("building"), F.coalesce("MACHINERY", F.lit(0)).cast("long").alias("machinery"))


@query("rel_unpivot", """
SELECT l_orderkey, l_linenumber, 'discount' AS name, l_discount AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem""")
def unpivot(spark, d):
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return li.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "name", "v")


@query("rel_recursive_cte", """
WITH RECURSIVE t(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t""")
def recursive(spark, d):
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@query("rel_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def sessions(spark, d):
    e = T(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("rel_exact_quantiles", "SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS med, round(stddev_pop(p_retailprice), 4) AS sd FROM part GROUP BY ALL")
def quantiles(spark, d):
    return T(spark, d, "part").groupBy("p_brand").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY p_retailprice)").alias("med"), F.round(F.stddev_pop("p_retailprice"), 4).alias("sd"))


@query("rel_sketches")
def sketches(spark, d):
    li = T(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", [0.5, 0.9], 1000).alias("price"),
        F.expr("hll_sketch_estimate(hll_sketch_agg(l_orderkey))").alias("orders"), F.expr("transform(approx_top_k(l_quantity, 3), x -> x.item)").alias("commonest"))


@query("rel_salted_aggregate", "SELECT l_linestatus, count(DISTINCT l_partkey) AS parts, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL")
def salted(spark, d):
    return R.salted_distinct(T(spark, d, "lineitem"), "l_linestatus", "l_partkey", {"qty": "l_quantity"}).withColumnRenamed("n_distinct", "parts")
