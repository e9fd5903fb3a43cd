"""The corpus tables as views over the driver's tables, and the same views as SQL.

Every adapter is a projection, so filters and column choice reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source tiers from the strongest to the weakest (fixed values; the order has a meaning).
TIERS = ["peer_reviewed", "government", "institutional", "trade", "news", "informal"]
STRONG_TIERS = TIERS[:2]
TOPICS = [f"t{i}" for i in range(7)]
#: The moment that stands for "now" in every time-dependent query.
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, values: list[str]) -> Column:
    """The element of ``values`` at ``key`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    topics = F.when(i % 11 == 0, F.lit(None)).when(i % 11 == 1, F.array().cast("array<string>")).when(i % 3 == 0, F.array_distinct(F.array(pick(i, TOPICS[:5]), pick(i, TOPICS)))).otherwise(F.array(pick(i, TOPICS[:5])))
    return d.select(
        i.alias("source_id"), F.col("source").alias("host"), F.concat(F.lit("pub"), (i % 9).cast("string")).alias("publisher"), F.col("lang").alias("language"), pick(i, TIERS).alias("tier"),
        F.when(i % 13 == 0, F.lit(None)).otherwise(F.date_add(F.lit("2018-01-01").cast("date"), (i % 2500).cast("int"))).alias("published"),
        F.when(F.col("n_chars") < 40, "junk").otherwise("kept").alias("retention"), F.when(i % 17 == 0, "quarantined").otherwise("cleared").alias("trust"),
        topics.alias("topics"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 720 as int))").alias("created_at"),
        F.col("n_chars"), F.col("text"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines; chunk_id = doc_id * 10000 + place."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.where(F.trim("text") != "").select((F.col("source_id") * 10000 + F.col("pos")).alias("chunk_id"), "source_id", F.col("pos").alias("chunk_index"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 50).alias("source_id"), F.col("label").alias("topic"), F.col("embedding").cast("array<double>").alias("v"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims between part brands and supplier nations, with the orders that support them."""
    li, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    p = p.select("p_partkey", "p_brand")
    s = s.select("s_suppkey", "s_nationkey")
    rel = F.when(F.col("l_returnflag") == "A", "increases").when(F.col("l_returnflag") == "N", "reduces").otherwise("supports")
    stance = F.when(F.col("l_linestatus") == "F", "supports").otherwise("opposes")
    joined = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return joined.groupBy(F.col("p_brand").alias("src"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("dst"), rel.alias("relation"), stance.alias("stance")).agg(
        F.count_distinct("l_orderkey").alias("support"), F.max(F.round(1 - F.col("l_discount"), 2)).alias("confidence"), F.min("l_orderkey").alias("first_chunk")
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse graph: parts and suppliers of the line items of quantity 50, undirected."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity = 50")
    pair = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("support"))
    return pair


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("domain"), F.col("ts").alias("attempted_at"), F.col("event_type").alias("outcome"), F.col("value").alias("duration"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("leased")
    return o.select(F.col("o_orderkey").alias("task_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), status.alias("status"), (F.col("o_custkey") % 7).alias("topic"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("domain"))


WORD = r"[\p{L}\p{N}_]+"


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer out of the benchmark's passages: two words as the name, two more words and initials as aliases, flags and country by what the words are like."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w")).where("size(w) >= 6")
    size = F.char_length("text")
    return w.select(
        "term_id", F.expr("w[0] || ' ' || w[1]").alias("canonical"), F.expr("array(w[2], w[3], upper(left(w[0], 1) || left(w[1], 1) || left(w[2], 1)))").alias("aliases"),
        F.when(F.char_length(F.expr("w[0]")) > 4, "agency").otherwise("scheme").alias("entity_type"), (size > 120).alias("approved"), (size < 90).alias("rejected"),
        (F.char_length(F.expr("w[3]")) < 4).alias("ambiguous"), F.upper(F.left(F.expr("w[4]"), F.lit(2))).alias("jurisdiction"),
    )


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of made places out of the benchmark's passages: longer words are countries, pairs of words cities or phrases that are no place."""
    w = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))
    pair = w.where("size(w) >= 2").select(F.explode(F.expr("transform(sequence(0, size(w) - 2), i -> struct(w[i] as a, w[i + 1] as b))")).alias("p")).select("p.a", "p.b")
    single = w.select(F.explode("w").alias("surface")).where(F.char_length("surface") >= 5)
    code = lambda s, n: F.upper(F.left(s, F.lit(n)))
    countries = single.select("surface", code(F.col("surface"), 2).alias("code"), (F.char_length("surface") == 7).alias("ambiguous"))
    long = pair.where(F.char_length("a") + F.char_length("b") >= 8).where((F.char_length("a") >= 2) & (F.char_length("b") >= 3))
    named = F.concat_ws(" ", "a", "b").alias("surface")
    cities = long.select(named, F.when(F.char_length("b") != 6, F.concat(code(F.col("a"), 2), code(F.col("b"), 3))).alias("code"), F.lit(False).alias("ambiguous"))
    return countries.unionByName(cities).where(F.col("surface").rlike("^[A-Za-z ]+$")).distinct()


_TIER_SQL = "[" + ", ".join(f"'{t}'" for t in TIERS) + "]"
_TOPIC5, _TOPIC7 = ("[" + ", ".join(f"'{t}'" for t in TOPICS[:n]) + "]" for n in (5, 7))
VIEWS = {
    "sources": f"""sources AS (
        SELECT doc_id AS source_id, source AS host, 'pub' || (doc_id % 9) AS publisher, lang AS language, ({_TIER_SQL})[doc_id % 6 + 1] AS tier,
               CASE WHEN doc_id % 13 = 0 THEN NULL ELSE DATE '2018-01-01' + CAST(doc_id % 2500 AS INTEGER) END AS published,
               CASE WHEN n_chars < 40 THEN 'junk' ELSE 'kept' END AS retention, CASE WHEN doc_id % 17 = 0 THEN 'quarantined' ELSE 'cleared' END AS trust,
               CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN CAST([] AS VARCHAR[])
                    WHEN doc_id % 3 = 0 THEN (CASE WHEN doc_id % 5 = doc_id % 7 THEN [({_TOPIC5})[doc_id % 5 + 1]] ELSE [({_TOPIC5})[doc_id % 5 + 1], ({_TOPIC7})[doc_id % 7 + 1]] END)
                    ELSE [({_TOPIC5})[doc_id % 5 + 1]] END AS topics,
               TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS created_at, n_chars, text
        FROM documents)""",
    "chunks": """lines AS (
        SELECT doc_id AS source_id, string_split(text, chr(10)) AS parts FROM documents),
      chunks AS (
        SELECT source_id * 10000 + pos - 1 AS chunk_id, source_id, pos - 1 AS chunk_index, parts[pos] AS text
        FROM (SELECT source_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM lines) WHERE trim(parts[pos]) <> '')""",
    "vectors": """vectors AS (
        SELECT vec_id AS chunk_id, vec_id % 50 AS source_id, label AS topic, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
    "edges": """edges AS (
        SELECT p_brand AS src, 'nation' || s_nationkey AS dst,
               CASE l_returnflag WHEN 'A' THEN 'increases' WHEN 'N' THEN 'reduces' ELSE 'supports' END AS relation,
               CASE l_linestatus WHEN 'F' THEN 'supports' ELSE 'opposes' END AS stance,
               count(DISTINCT l_orderkey) AS support, max(round(1 - l_discount, 2)) AS confidence, min(l_orderkey) AS first_chunk
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)""",
    "links": """links AS (
        SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, count(*) AS support FROM lineitem WHERE l_quantity = 50 GROUP BY ALL)""",
    "terms": r"""terms AS (
        SELECT term_id, w[1] || ' ' || w[2] AS canonical, [w[3], w[4], upper(w[1][1:1] || w[2][1:1] || w[3][1:1])] AS aliases, CASE WHEN length(w[1]) > 4 THEN 'agency' ELSE 'scheme' END AS entity_type,
               length(text) > 120 AS approved, length(text) < 90 AS rejected, length(w[4]) < 4 AS ambiguous, upper(w[5][1:2]) AS jurisdiction
        FROM (SELECT item_id AS term_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark) WHERE len(w) >= 6)""",
    "place_names": r"""bench AS (SELECT regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark),
      pairs AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM bench)),
      place_names AS (SELECT * FROM (
        SELECT surface, upper(surface[1:2]) AS code, length(surface) = 7 AS ambiguous FROM (SELECT unnest(w) AS surface FROM bench) WHERE length(surface) >= 5
        UNION SELECT a || ' ' || b, CASE WHEN length(b) <> 6 THEN upper(a[1:2]) || upper(b[1:3]) END, false FROM pairs WHERE length(a) + length(b) >= 8 AND length(a) >= 2 AND length(b) >= 3) WHERE regexp_matches(surface, '^[A-Za-z ]+$'))""",
    "tokens": r"""tokens AS (
        SELECT doc_id, i, parts[i] AS w, parts[i + 1] AS next, gaps[i + 1] AS gap FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS parts, string_split_regex(text, '[\p{L}\p{N}_]+') AS gaps FROM documents)))""",
    "attempts": """attempts AS (
        SELECT event_id AS attempt_id, user_id AS domain, ts AS attempted_at, event_type AS outcome, value AS duration FROM events)""",
    "queue": """queue AS (
        SELECT o_orderkey AS task_id, CAST(o_orderpriority[1:1] AS INTEGER) AS priority,
               CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'leased' END AS status, o_custkey % 7 AS topic, o_orderdate AS created_at, o_custkey AS domain
        FROM orders)""",
}


def sql(views: str, body: str) -> str:
    """SQL over some of the views, named with spaces between."""
    return "WITH " + ",\n".join(VIEWS[v] for v in views.split()) + "\n" + body
