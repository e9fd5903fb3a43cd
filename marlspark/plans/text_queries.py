"""Queries of text and address functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import corpus as C
from .registry import query


def bibtex_entry() -> Column:
    kind = F.when(F.col("tier") == "peer_reviewed", "article").when(F.col("tier") == "government", "techreport").otherwise("misc")
    year = F.year("published").cast("string")
    key = F.concat(F.col("publisher"), F.coalesce(year, F.lit("nd")), F.lit("_"), F.col("source_id").cast("string"))
    fields = F.array_compact(F.array(F.concat(F.lit("  publisher = {"), F.col("publisher"), F.lit("}")), F.concat(F.lit("  year = {"), year, F.lit("}"))))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))


HOST = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '')"
PART = r"regexp_extract(url, '^([A-Za-z]+)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', {})"
KEPT = f"list_filter(string_split({PART.format(4)}, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({', '.join(repr(t) for t in X.TRACKING)}))"
NORMAL = f"CASE WHEN lower({PART.format(1)}) IN ('http', 'https') AND {PART.format(2)} <> '' THEN lower({PART.format(1)}) || '://' || regexp_replace(regexp_replace(lower({PART.format(2)}), ':80$', ''), ':443$', '') || CASE WHEN {PART.format(3)} = '' THEN '/' ELSE {PART.format(3)} END || CASE WHEN len({KEPT}) > 0 THEN '?' || array_to_string({KEPT}, '&') ELSE '' END END"


@query("t31_host_keys", f"SELECT page_id, {HOST} AS host, regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS site FROM pages")
def hosts(spark, d):
    h = X.host_key(F.col("url"))
    return C.table(spark, d, "pages").select("page_id", h.alias("host"), X.registrable(h).alias("site"))


@query("t32_normal_urls", f"SELECT page_id, {NORMAL} AS url FROM pages")
def normal(spark, d):
    return C.table(spark, d, "pages").select("page_id", X.normal_url(F.col("url")).alias("url"))


@query("t33_url_prefilter", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_matches(url, '^(http|https|HTTP|HTTPS)://') THEN 'scheme' WHEN regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/(login|signup|cart|privacy|terms)(/|$)') THEN 'furniture' WHEN regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '\\.(jpg|png|gif|zip|mp4|css|js)$') THEN 'extension' WHEN contains(url, '#') THEN 'fragment' END AS reason FROM pages) GROUP BY reason")
def prefilter(spark, d):
    return C.table(spark, d, "pages").groupBy(X.refusal(F.col("url")).alias("reason")).agg(F.count("*").alias("n"))


@query("t45_excerpts", "SELECT doc_id, CASE WHEN length(f) <= 240 THEN f ELSE CASE WHEN regexp_extract(f[1:239], '^(.*) ', 1) <> '' THEN regexp_extract(f[1:239], '^(.*) ', 1) ELSE f[1:239] END || '…' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def excerpts(spark, d):
    return C.table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


REF = r"(regexp_matches(r, '^\s*(\[[0-9]+\]|[0-9]+\.|[A-Z][a-z]+, [A-Z]\.)') OR regexp_matches(r, '\((19|20)[0-9]{2}\)') OR regexp_matches(r, 'doi\.org/|10\.[0-9]{4,}/'))"


@query("t12_reference_lists", f"SELECT doc_id, count(*) FILTER ({REF}) >= 3 AND coalesce(sum(length(r)) FILTER ({REF}), 0) >= 0.6 * sum(length(r)) AS is_list FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS r FROM documents) WHERE trim(r) <> '' GROUP BY doc_id")
def references(spark, d):
    return C.table(spark, d, "documents").where(F.regexp_replace("text", " |\n", "") != "").select("doc_id", X.reference_list(F.col("text")).alias("is_list"))


@query("t9_bare_text", r"SELECT doc_id, md5(CASE WHEN t = '' THEN text ELSE t END) AS bare FROM (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(text, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', '', 'g'), '[ \t]+', ' ', 'g')) AS t FROM documents)")
def bare(spark, d):
    return C.table(spark, d, "documents").select("doc_id", F.md5(X.bare_text(F.col("text"))).alias("bare"))


@query("t6_line_marks", C.sql("chunks", "SELECT md5(trim(text)) AS mark, count(DISTINCT source_id) AS sources, count(*) AS n FROM chunks WHERE length(trim(text)) BETWEEN 12 AND 200 GROUP BY 1 HAVING count(DISTINCT source_id) >= 2"))
def marks(spark, d):
    line = F.trim("text")
    c = C.chunks(spark, d).where(F.char_length(line).between(12, 200))
    return c.groupBy(F.md5(line).alias("mark")).agg(F.count_distinct("source_id").alias("sources"), F.count("*").alias("n")).where("sources >= 2")


@query("t13_unreadable_share", "SELECT doc_id, round(coalesce(sum(length(w)) FILTER (regexp_matches(w, '[\\x00-\\x1f\\x7f-\\x{9f}\\x{e000}-\\x{f8ff}\\x{fffd}]')), 0) / sum(length(w)), 6) AS share FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id")
def unreadable(spark, d):
    return C.table(spark, d, "documents").where(F.regexp_replace("text", r"\s", "") != "").select("doc_id", F.round(X.unreadable(F.col("text")), 6).alias("share"))


@query("t17_wide_pairs", "SELECT doc_id, 0::BIGINT AS pairs FROM documents WHERE NOT regexp_matches(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]')")
def wide(spark, d):
    t = C.table(spark, d, "documents")
    return t.select("doc_id", F.size(X.wide_pairs(F.col("text"))).cast("long").alias("pairs"))


@query("t29_source_tiers", f"SELECT page_id, CASE WHEN {HOST} = 'example.com' OR ends_with({HOST}, '.example.com') THEN 'news' WHEN {HOST} = 'example.net' OR ends_with({HOST}, '.example.net') THEN 'trade' WHEN {HOST} = 'org' OR ends_with({HOST}, '.org') THEN 'institutional' ELSE 'informal' END AS tier FROM pages")
def tiers(spark, d):
    return C.table(spark, d, "pages").select("page_id", X.source_tier(X.host_key(F.col("url")), [("org", "institutional"), ("example.com", "news"), ("example.net", "trade")]).alias("tier"))


@query("t36_identifiers", r"SELECT doc_id, len(regexp_extract_all(text, '10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+')) AS dois FROM documents")
def identifiers(spark, d):
    return C.table(spark, d, "documents").select("doc_id", F.size(F.filter(X.identifiers(F.col("text")), lambda x: x.startswith("doi:"))).cast("long").alias("dois"))


@query("t38_date_judgement", C.sql("sources", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN published IS NULL THEN 'missing' WHEN published > DATE '2022-06-01' THEN 'future' WHEN published = DATE '2022-06-01' THEN 'fetch day' WHEN year(published) < 1993 THEN 'before the web' WHEN month(published) = 1 AND day(published) = 1 THEN 'first of January' END AS reason FROM sources) GROUP BY reason"))
def dates(spark, d):
    reason = X.date_refusal(F.col("published"), F.lit("2022-06-01").cast("date"))
    return C.sources(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("t48_zone_times", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown FROM events")
def zones(spark, d):
    return C.table(spark, d, "events").select("event_id", X.zone_time(F.col("ts"), "Asia/Singapore").alias("shown"))


@query("t51_cited_references", "SELECT conv_id, turn, len(list_intersect(list_distinct(regexp_extract_all(text, '[0-9]+')), ['1', '2', '3'])) AS kept FROM conversations")
def cited(spark, d):
    found = F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))
    return C.table(spark, d, "conversations").select("conv_id", "turn", F.size(F.array_intersect(found, F.array(*map(F.lit, "123")))).cast("long").alias("kept"))


@query("f_string_functions", "SELECT doc_id, lower(source) AS lo, length(text) AS n, text[1:5] AS head, split_part(source, 'c', 2) AS part, coalesce(nullif(lang, 'en'), 'none') AS lang, md5(source) AS m FROM documents")
def strings(spark, d):
    return C.table(spark, d, "documents").select(
        "doc_id", F.lower("source").alias("lo"), F.char_length("text").cast("long").alias("n"), F.left("text", F.lit(5)).alias("head"), F.split_part("source", F.lit("c"), F.lit(2)).alias("part"), F.coalesce(F.nullif("lang", F.lit("en")), F.lit("none")).alias("lang"), F.md5("source").alias("m")
    )
