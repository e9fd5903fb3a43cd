"""Pages, lines and passages judged, with the SQL of each judgement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as X
from ..operators import claims as M
from ..sources import corpus as C
from .registry import query

#: Lines as the rules meet them: some with an invisible character, some with a link (made from the tables, alike in SQL).
LINES = """, l AS (SELECT chunk_id, source_id, chunk_index, CASE WHEN chunk_id % 5 = 0 THEN regexp_replace(text, '[^ ]{2,}', chr(8203), 'g') WHEN chunk_id % 5 = 1 THEN '[' || text[1:20] || '](http://x/' || chunk_id || ') ' || text[21:] WHEN chunk_id % 5 = 2 THEN text || repeat(chr(65533), CAST(chunk_id % 4 AS INTEGER)) ELSE text END AS line FROM (SELECT * REPLACE (regexp_replace(text, '[\\[\\]]', '', 'g') AS text) FROM chunks))"""
VISIBLE = r"length(regexp_replace({}, '[\s\p{{Cf}}\p{{Cc}}\p{{Co}}]', '', 'g'))"
LINK = r"'\[([^\]]*)\]\([^)]*\)'"


def lines(spark, d):
    i, t = F.col("chunk_id"), F.regexp_replace("text", r"[\[\]]", "")
    linked = F.concat(F.lit("["), F.substring(t, 1, 20), F.lit("](http://x/"), i.cast("string"), F.lit(") "), F.substring(t, F.lit(21), F.char_length(t)))
    broken = F.concat(t, F.repeat(F.lit("�"), (i % 4).cast("int")))
    line = F.when(i % 5 == 0, F.regexp_replace(t, "[^ ]{2,}", "​")).when(i % 5 == 1, linked).when(i % 5 == 2, broken).otherwise(t)
    return C.chunks(spark, d).select("chunk_id", "source_id", "chunk_index", line.alias("line"))


@query("t5_debris_lines", C.sql("chunks", LINES + rf" SELECT source_id, count(*) AS n FROM l WHERE regexp_matches(line, '[\p{{Cf}}\p{{Cc}}\p{{Co}}]') AND {VISIBLE.format('line')} < 3 GROUP BY source_id"))
def debris(spark, d):
    return lines(spark, d).where(P.debris(F.col("line"))).groupBy("source_id").agg(F.count("*").alias("n"))


_SEEN = VISIBLE.format(rf"regexp_replace(line, {LINK}, '\1', 'g')")
_LABELS = VISIBLE.format(rf"array_to_string(regexp_extract_all(line, {LINK}, 1), '')")


@query("t10_link_share", C.sql("chunks", LINES + f" SELECT chunk_id, round(CASE WHEN v > 0 THEN k / v ELSE 0 END, 6) AS share, CASE WHEN v > 0 THEN k / v ELSE 0 END > 0.5 AS listing FROM (SELECT chunk_id, {_SEEN} AS v, {_LABELS} AS k FROM l)"))
def link_share(spark, d):
    return lines(spark, d).select("chunk_id", F.round(P.link_share(F.col("line")), 6).alias("share"), P.listing(F.col("line")).alias("listing"))


@query("t14_garbled_share", C.sql("chunks", LINES + rf" SELECT chunk_id, round(CASE WHEN v > 0 THEN k / v ELSE 0 END, 6) AS share FROM (SELECT chunk_id, {VISIBLE.format('line')} AS v, length(line) - length(replace(line, chr(65533), '')) AS k FROM l)"))
def garbled(spark, d):
    return lines(spark, d).select("chunk_id", F.round(P.garbled_share(F.col("line")), 6).alias("share"))


PHRASES = {"red widget": "t1", "widget": "t2", "small ring": "t3", "blue": "t4", "steel": "t5", "large steel": "t6"}
_TOKENS = "' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query("t22_phrase_topics", "SELECT p_partkey AS id, " + "CASE " + " ".join(f"WHEN contains({_TOKENS}, ' {p} ') THEN '{t}'" for p, t in sorted(PHRASES.items(), key=lambda x: (-len(x[0]), x[0])) if len(p) >= 5) + " END AS topic FROM part")
def phrase_topics(spark, d):
    return C.table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.phrase_topic(F.col("p_name"), PHRASES).alias("topic"))


@query("t26_without_references", C.sql("chunks", """, t AS (SELECT source_id, list_transform(list(text ORDER BY chunk_index), lambda x, i: CASE WHEN i % 4 = 0 THEN '[' || i || '] ' || x WHEN i % 9 = 7 THEN '## References' ELSE x END) AS ls FROM chunks GROUP BY source_id)
, s AS (SELECT source_id, ls, coalesce(list_min(list_filter(list_transform(ls, lambda x, i: CASE WHEN x = '## References' AND i > 0.4 * len(ls) THEN i - 1 END), lambda x: x IS NOT NULL)), len(ls)) AS stop FROM t) SELECT source_id, md5(array_to_string(list_filter(ls[1:stop], lambda x: NOT regexp_matches(x, '^\\s*\\[[0-9]+\\] ')), chr(10))) AS mark FROM s"""))
def without_references(spark, d):
    rows = C.chunks(spark, d).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text")))["text"].alias("ls"))
    made = F.transform("ls", lambda x, i: F.when((i + 1) % 4 == 0, F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)).when((i + 1) % 9 == 7, "## References").otherwise(x))
    return rows.select("source_id", F.md5(P.without_references(F.array_join(made, "\n"))).alias("mark"))


_LIFE = "CASE tier WHEN 'government' THEN 3650 WHEN 'institutional' THEN 1825 WHEN 'trade' THEN 1825 WHEN 'news' THEN 365 WHEN 'informal' THEN 180 END"
_BASE = "CASE tier " + " ".join(f"WHEN '{t}' THEN {p}" for t, p in P.TIER_PRIORITY.items()) + " ELSE 0 END"


@query("t30_priority", C.sql("sources", f"SELECT source_id, ({_BASE} + coalesce(least(greatest(round_even(2920.0::DOUBLE / {_LIFE}, 0), 0), 8), 0))::INTEGER AS priority FROM sources"))
def priority(spark, d):
    from ..operators.search import HALF_LIFE

    life = F.create_map(*(x for t, n in HALF_LIFE.items() for x in (F.lit(t), F.lit(float(n)))))[F.col("tier")]
    return C.sources(spark, d).select("source_id", P.priority(F.col("tier"), life).alias("priority"))


@query("t34_admission", C.sql("sources", """, g AS (SELECT host, language, count(*) AS e, count(*) FILTER (coalesce(list_contains(topics, 't1'), false)) AS o, (sum(n_chars) % 60)::BIGINT AS p FROM sources GROUP BY ALL)
SELECT host, language, CASE WHEN e >= 5 AND o / e < 0.1 THEN 'refuse' WHEN e < 5 AND p >= 20 THEN 'wait' WHEN p >= 50 THEN 'wait' WHEN e < 5 THEN 'probe' ELSE 'queue' END AS verdict FROM g"""))
def admission(spark, d):
    on = F.coalesce(F.array_contains("topics", "t1"), F.lit(False))
    g = C.sources(spark, d).groupBy("host", "language").agg(F.count("*").alias("e"), F.count_if(on).alias("o"), (F.sum("n_chars") % 60).alias("p"))
    return g.select("host", "language", P.admission(F.col("e"), F.col("o"), F.col("p")).alias("verdict"))


@query("t42_error_pages", r"""SELECT page_id, regexp_matches(t, '(?i)\b(404|page not found|not found|page (does not|doesn''t) exist|no longer available)\b') AS missing FROM (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'Page Not Found' WHEN page_id % 6 = 1 THEN 'It is no longer available.' WHEN page_id % 6 = 2 THEN 'x404y' ELSE url END AS t FROM pages)""")
def error_pages(spark, d):
    i = F.col("page_id") % 6
    t = F.when(i == 0, "Page Not Found").when(i == 1, "It is no longer available.").when(i == 2, "x404y").otherwise(F.col("url"))
    return C.table(spark, d, "pages").select("page_id", P.error_page(t, F.lit("")).alias("missing"))


@query("f11_ilike", "SELECT count(*) FILTER (p_name ILIKE '%RED%') AS plain, count(*) FILTER (contains(lower(t), '1_0%')) AS literal FROM (SELECT p_name, CASE WHEN p_size % 2 = 0 THEN 'a1_0%B' ELSE 'a110xB' END AS t FROM part)")
def ilike(spark, d):
    p = C.table(spark, d, "part").select("p_name", F.when(F.col("p_size") % 2 == 0, "a1_0%B").otherwise("a110xB").alias("t"))
    return p.agg(F.count_if(F.col("p_name").ilike("%RED%")).alias("plain"), F.count_if(P.literal_like(F.col("t"), "1_0%")).alias("literal"))


@query("p16_no_stubs", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 1")
def no_stubs(spark, d):
    i = F.col("doc_id")
    extra = F.when(i % 3 == 0, F.lit(None)).when(i % 3 == 1, F.lit('{"stub": true}')).otherwise('{"other": 1}')
    return C.table(spark, d, "documents").select("doc_id", extra.alias("extra")).where(P.not_a_stub(F.col("extra"))).select("doc_id")


@query("r14_page_unit", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'page' ELSE 'offset' END AS unit FROM documents")
def unit(spark, d):
    i = F.col("doc_id")
    return C.table(spark, d, "documents").select("doc_id", P.page_unit(F.when(i % 3 == 0, "pdf").otherwise("html"), F.when(i % 4 != 0, i)).alias("unit"))


@query("r25_grouping_decision", "SELECT item_id, item_id % 2 = 0 OR item_id % 3 = 0 AS by_place FROM benchmark")
def decision(spark, d):
    i = F.col("item_id")
    q = F.when(i % 2 == 0, "Where is it made?").when(i % 3 == 0, "rules in Spain, please").otherwise("what does Spaintex cost")
    return C.table(spark, d, "benchmark").select("item_id", P.asks_for_places(q, ["Spain", "France"]).alias("by_place"))


_UN = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
# RE2 knows no back references, so the silent parts are taken off one name after another
_CUT = "coalesce(html, '')"
for _name in P.SILENT.split("|"):
    _CUT = rf"regexp_replace({_CUT}, '(?is)<{_name}\b[^>]*>.*?</{_name}>', ' ', 'g')"
_CUT = rf"regexp_replace(regexp_replace({_CUT}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?({P.BLOCKS})\b[^>]*>', chr(10), 'g')"
_TEXT = rf"trim(regexp_replace(regexp_replace({_UN.format(f'''regexp_replace({_CUT}, '(?s)<[^>]*>', '', 'g')''')}, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


@query("s6_html_pages", rf"""SELECT page_id, {_UN.format("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} AS title, nullif(lower(regexp_extract(html, '(?i)<html[^>]*\blang=["'']?([A-Za-z]+)', 1)), '') AS language, md5({_TEXT}) AS mark FROM pages""")
def html_pages(spark, d):
    h = F.col("html")
    return C.table(spark, d, "pages").select("page_id", P.html_title(h).alias("title"), P.html_language(h).alias("language"), F.md5(P.html_text(F.coalesce(h, F.lit("")))).alias("mark"))


@query("t35_links", rf"""SELECT page_id, list_count(list_distinct(ls))::INTEGER AS links, md5(array_to_string(list_sort(list_distinct(ls)), ' ')) AS mark FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?\bhref=["'']([^"''#]*)', 1), lambda x: {_UN.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(javascript|mailto|tel|data):')) AS ls FROM pages)""")
def page_links(spark, d):
    p = C.table(spark, d, "pages").select("page_id", P.html_links(F.col("html")).alias("ls"))
    return p.select("page_id", F.size("ls").alias("links"), F.md5(F.array_join(F.array_sort("ls"), " ")).alias("mark"))


PAGE_LINES = ", pl AS (SELECT source_id, chunk_index // 6 AS page, chunk_index AS i, CASE WHEN chunk_index % 6 = 0 THEN 'Report 20' || source_id || ' page ' || chunk_index ELSE text END AS text FROM chunks)"


@query("t7_running_headers", C.sql("chunks", PAGE_LINES + r""", e AS (SELECT *, row_number() OVER (PARTITION BY source_id, page ORDER BY i) <= 3 OR row_number() OVER (PARTITION BY source_id, page ORDER BY i DESC) <= 3 AS edge FROM pl)
, n AS (SELECT source_id, count(DISTINCT page) AS k FROM pl GROUP BY ALL), f AS (SELECT source_id, regexp_replace(trim(text), '[0-9]+', '#', 'g') AS line, count(DISTINCT page) AS pages FROM e WHERE edge GROUP BY ALL) SELECT source_id, line, pages FROM f JOIN n USING (source_id) WHERE pages >= 4 AND pages >= 0.5 * k"""))
def headers(spark, d):
    i = F.col("chunk_index")
    text = F.when(i % 6 == 0, F.concat(F.lit("Report 20"), F.col("source_id").cast("string"), F.lit(" page "), i.cast("string"))).otherwise(F.col("text"))
    return M.running_headers(C.chunks(spark, d).select("source_id", F.floor(i / 6).alias("page"), i.alias("i"), text.alias("text")))


@query("t4_menus", C.sql("chunks", """, l AS (SELECT source_id AS page_id, chunk_index AS i, CASE WHEN chunk_id % 11 = 0 THEN 9 ELSE 2 END AS words, chunk_id % 5 <> 0 AS linked FROM chunks), r AS (SELECT *, sum(CASE WHEN words <= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS run FROM l)
, g AS (SELECT page_id, run, count(*) AS lines, count(*) FILTER (linked) AS k, min(i) FILTER (linked) AS first, max(i) FILTER (linked) AS last FROM r WHERE words <= 4 GROUP BY ALL) SELECT page_id, first::INTEGER AS first, last::INTEGER AS last, lines FROM g WHERE lines >= 5 AND k >= 0.7 * lines"""))
def menu_blocks(spark, d):
    c = C.chunks(spark, d)
    return M.menus(c.select(F.col("source_id").alias("page_id"), F.col("chunk_index").alias("i"), F.when(F.col("chunk_id") % 11 == 0, 9).otherwise(2).alias("words"), (F.col("chunk_id") % 5 != 0).alias("linked")))


def _marked():
    """A page's text with its links as marks."""
    return P.html_text(F.regexp_replace("html", r'(?is)<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', "[$2]($1)"))


@query("t8_cleaned_pages")
def cleaned_pages(spark, d):
    """Pages' texts without their furniture; the guard keeps a page that would lose too much."""
    from ..operators import cleaning as K

    pages = C.table(spark, d, "pages").select("page_id", X.host_key(F.col("url")).alias("host"), _marked().alias("text"))
    return K.cleaned(pages, "page_id").select("page_id", F.md5("text").alias("mark"), "lines_removed", "removed_chars", "total_chars", "kept_original")


@query("t3_furniture_lines")
def furniture_lines(spark, d):
    from ..operators import cleaning as K

    pages = C.table(spark, d, "pages").select("page_id", X.host_key(F.col("url")).alias("host"), _marked().alias("text"))
    return K.judged(pages, "page_id").where("reason is not null").groupBy("page_id", "reason").agg(F.count("*").alias("lines"), F.sum("seen").alias("seen"))
