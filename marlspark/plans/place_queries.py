"""The gazetteer and the places of documents, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import gazetteer as G
from ..operators import places as P
from ..sources import corpus as C
from .registry import query

_CASED = "length(surface) <= 8 AND upper(surface) = surface AND NOT contains(surface, ' ')"
_FORMS = f""", every AS (SELECT term_id, entity_type, approved, ambiguous, position, surface, {_CASED} AS cased, CASE WHEN {_CASED} THEN '=' || surface ELSE '~' || lower(surface) END AS key
    FROM (SELECT *, unnest(range(1, len(list) + 1)) AS position, unnest(list) AS surface FROM (SELECT *, list_prepend(canonical, aliases) AS list FROM terms))),
  own AS (SELECT term_id, any_value(entity_type) AS entity_type, key, cased, min_by(surface, position) AS surface, min_by(ambiguous AND position > 1, position) AS flagged, bool_or(ambiguous AND position > 1) AS any_flag
          FROM every WHERE approved GROUP BY term_id, key, cased),
  keyed AS (SELECT key, CASE WHEN bool_or(any_flag) THEN 'ambiguous' WHEN count(*) > 1 THEN 'collision' END AS reason, list_sort(list(term_id)) AS terms, list_sort(list(term_id) FILTER (flagged)) AS flagged_terms FROM own GROUP BY key),
  forms AS (SELECT own.*, reason, terms, flagged_terms FROM own JOIN keyed USING (key))"""


@query("t21_verdicts", C.sql("terms", _FORMS + """, held AS (SELECT term_id, min_by(struct_pack(r := reason, o := list_filter(CASE WHEN reason = 'ambiguous' THEN flagged_terms ELSE terms END, lambda x: x <> term_id)), reason || key) AS lost
    FROM forms WHERE reason = 'collision' OR (reason = 'ambiguous' AND flagged) GROUP BY term_id), kept AS (SELECT DISTINCT term_id, true AS kept FROM forms WHERE reason IS NULL)
SELECT term_id, approved AND kept IS NOT NULL AS will_load, CASE WHEN NOT approved THEN CASE WHEN rejected THEN 'rejected' ELSE 'unapproved' END WHEN lost IS NOT NULL THEN lost.r WHEN kept IS NULL THEN 'no_patterns' END AS reason,
  CASE WHEN approved AND lost IS NOT NULL THEN lost.o ELSE [] END AS collides_with FROM terms LEFT JOIN kept USING (term_id) LEFT JOIN held USING (term_id)"""))
def verdicts(spark, d):
    return G.verdicts(C.terms(spark, d))


def _matched(cases: str) -> str:
    """SQL of the leftmost longest matches of forms of one or two words; ``cases`` joins a text to its form: of pairs that overlap the first, third and so on count."""
    return f""", two AS (SELECT t.doc_id, t.i, t.gap, f.* FROM tokens t JOIN form f ON t.gap = ' ' AND {cases.format("t.w || ' ' || t.next")} QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.i ORDER BY f.surface) = 1), runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM two),
  taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS r FROM runs) WHERE r % 2 = 1),
  one AS (SELECT t.doc_id, t.i, t.gap, f.* FROM tokens t JOIN form f ON {cases.format("t.w")} WHERE NOT EXISTS (SELECT 1 FROM taken k WHERE k.doc_id = t.doc_id AND k.i IN (t.i, t.i - 1)) QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.i ORDER BY f.surface) = 1)"""


_FOLD = "((f.cased AND f.surface = {0}) OR (NOT f.cased AND lower(f.surface) = lower({0})))"


@query("t21_term_mentions", C.sql("terms tokens", _FORMS + ", form AS (SELECT surface, cased, term_id, upper(entity_type) AS label FROM forms WHERE reason IS NULL)" + _matched(_FOLD) + """
, m AS (SELECT doc_id, term_id, label FROM taken UNION ALL SELECT doc_id, term_id, label FROM one) SELECT doc_id, term_id, label, count(*) AS n FROM m GROUP BY ALL"""))
def term_mentions(spark, d):
    found = G.mentions(C.table(spark, d, "documents"), C.terms(spark, d), "doc_id")
    return found.groupBy("doc_id", "term_id", "label").agg(F.count("*").alias("n"))


@query("t21_by_context", C.sql("terms tokens", _FORMS + ", form AS (SELECT min(surface) AS surface, cased, any_value(reason) AS reason, min(term_id) AS owner, any_value(terms) AS terms FROM forms GROUP BY key, cased)" + _matched(_FOLD) + """
, m AS (SELECT doc_id, i, reason, owner, terms FROM taken UNION ALL SELECT doc_id, i, reason, owner, terms FROM one), named AS (SELECT DISTINCT doc_id, owner FROM m WHERE reason IS NULL)
, j AS (SELECT doc_id, owner AS term_id, NULL AS reason FROM m WHERE reason IS NULL UNION ALL
  SELECT doc_id, CASE WHEN known = 1 THEN term END, CASE WHEN known = 1 THEN 'context' ELSE reason END FROM (
    SELECT m.doc_id, m.i, m.reason, len(list_filter(m.terms, lambda x: list_contains(coalesce(k.of, []), x))) AS known, list_filter(m.terms, lambda x: list_contains(coalesce(k.of, []), x))[1] AS term
    FROM m LEFT JOIN (SELECT doc_id, list(owner) AS of FROM named GROUP BY doc_id) k USING (doc_id) WHERE m.reason IS NOT NULL))
SELECT doc_id, term_id, reason, count(*) AS n FROM j GROUP BY ALL"""))
def terms_by_context(spark, d):
    found = G.by_context(C.table(spark, d, "documents"), C.terms(spark, d), "doc_id")
    return found.groupBy("doc_id", "term_id", "reason").agg(F.count("*").alias("n"))


_VOCAB = """, ranked AS (SELECT surface, code, CASE WHEN code IS NULL THEN 0 ELSE 1 END AS rank FROM place_names WHERE NOT ambiguous OR code IS NULL
    UNION ALL SELECT upper(surface), code, CASE WHEN code IS NULL THEN 0 ELSE 2 END FROM place_names WHERE NOT ambiguous OR code IS NULL),
  names AS (SELECT surface, (list(code ORDER BY rank, code))[1] AS code, false AS term FROM ranked GROUP BY surface),
  of_terms AS (SELECT surface, min_by(code, term_id) AS code, true AS term FROM (SELECT term_id, unnest(list_prepend(canonical, aliases)) AS surface, CASE jurisdiction WHEN 'UK' THEN 'GB' ELSE jurisdiction END AS code
    FROM terms WHERE approved AND NOT rejected AND NOT ambiguous AND length(jurisdiction) = 2) WHERE length(surface) >= 5 GROUP BY surface),
  form AS (SELECT * FROM names UNION ALL SELECT * FROM of_terms WHERE surface NOT IN (SELECT surface FROM names))"""
_CITED = P.CITED.replace("'", "''")
_BODY = rf"""bodies AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (length(x) <= {P.CITATION} AND regexp_matches(x, '{P.YEAR}') AND regexp_matches(x, '{_CITED}'))), chr(10)) AS text FROM documents)"""


def _counted(tokens: str) -> str:
    return C.sql("terms place_names", ", " + tokens + _VOCAB + _matched("f.surface = {0}") + """
, m AS (SELECT doc_id, i, i + 1 AS last, code, term FROM taken UNION ALL SELECT doc_id, i, i, code, term FROM one),
  o AS (SELECT m.*, lag(last) OVER w AS before, lag(code) OVER w AS city, lag(term) OVER w AS was FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  k AS (SELECT o.doc_id, code, term, coalesce(before = o.i - 1 AND regexp_matches(t.gap, '^\\s*[,(]?\\s*$') AND NOT term AND NOT was AND length(code) = 2 AND length(city) = 5 AND city[1:2] = code, false) AS again
        FROM o LEFT JOIN tokens t ON t.doc_id = o.doc_id AND t.i = o.i - 1)""")


_WHOLE = C.VIEWS["tokens"]
_MENTIONS = _counted(_WHOLE) + ", named AS (SELECT doc_id, code, term, count(*) AS n FROM k WHERE code IS NOT NULL AND NOT again GROUP BY ALL)"


def _vocabulary(spark, d):
    return P.vocabulary(C.place_names(spark, d), C.terms(spark, d))


@query("t23_place_mentions", _MENTIONS + " SELECT doc_id, code, term, n FROM named")
def place_mentions(spark, d):
    return P.counted(C.table(spark, d, "documents"), _vocabulary(spark, d), "doc_id")


LANGUAGE_COUNTRIES = [("de", "DE"), ("fr", "FR"), ("es", "ES")]
_DECIDED = _counted(", ".join([
    _BODY, "titled AS (SELECT doc_id * 2 AS doc_id, text FROM bodies UNION ALL SELECT doc_id * 2 + 1, string_split(text, chr(10))[1] FROM documents)", _WHOLE.replace("FROM documents", "FROM titled")])) + f"""
, named AS (SELECT doc_id // 2 AS doc_id, code, term, sum(CASE doc_id % 2 WHEN 1 THEN {P.TITLE_WEIGHT} ELSE 1 END) AS n FROM k WHERE code IS NOT NULL AND NOT again GROUP BY ALL)
, src AS (SELECT doc_id, length(b.text) AS chars, lang, CASE WHEN lang IN ('de', 'fr', 'es') THEN upper(lang) END AS home, length(source) = 4 AS state FROM bodies b JOIN documents USING (doc_id))
, cited AS (SELECT doc_id, 'LI' AS code FROM documents WHERE contains(text, 'GNU') UNION ALL SELECT doc_id, 'THOSE' FROM documents WHERE contains(text, 'Apache'))
, c AS (SELECT doc_id, code[1:2] AS code, n, NOT term AS by_name, term AS by_term, false AS cited, false AS home FROM named UNION ALL SELECT doc_id, code[1:2], 0, false, false, true, false FROM cited UNION ALL SELECT doc_id, home, 0, false, false, false, true FROM src WHERE home IS NOT NULL)
, g AS (SELECT doc_id, code, sum(n) AS n, bool_or(by_name) AS by_name, bool_or(by_term) AS by_term, bool_or(cited) AS cited, bool_or(home) AS home FROM c GROUP BY ALL)
, b AS (SELECT g.*, chars, lang, state, max(n) OVER (PARTITION BY doc_id) AS best, greatest({P.MIN_MENTIONS}, ceil(chars / {P.CHARS_PER_MENTION}.0)) AS floor FROM g JOIN src USING (doc_id))
, t AS (SELECT *, n >= floor AND n >= {P.SHARE_OF_BEST} * best AS by_text FROM b), u AS (SELECT *, bool_or(by_text OR cited) OVER (PARTITION BY doc_id) AS known, home AND NOT by_text AND NOT cited AND n >= CASE WHEN state THEN 1 ELSE 2 END AND n >= {P.SHARE_OF_BEST} * best AS near FROM t)
, v AS (SELECT *, home AND NOT known AND NOT near AND state AS by_state, home AND NOT known AND NOT near AND NOT state AND upper(lang) = code AS by_lang FROM u)
, countries AS (SELECT *, list_filter([CASE WHEN (by_text OR near) AND by_name THEN 'text' END, CASE WHEN (by_text OR near) AND by_term THEN 'gazetteer' END, CASE WHEN cited THEN 'entity' END, CASE WHEN home THEN 'domain' END, CASE WHEN by_lang THEN 'language' END], lambda x: x IS NOT NULL) AS signals
    FROM v WHERE by_text OR cited OR near OR by_state OR by_lang)
, towns AS (SELECT doc_id, code, max(n) AS n, bool_or(cited) AS cited FROM (SELECT doc_id, code, n, false AS cited FROM named WHERE length(code) = 5 AND NOT term UNION ALL SELECT doc_id, code, 0, true FROM cited WHERE length(code) = 5) GROUP BY ALL)
, inside AS (SELECT t.doc_id, t.code, t.n, t.n >= floor AND t.n >= {P.SHARE_OF_BEST} * best AS by_text, t.cited FROM towns t JOIN countries k ON t.doc_id = k.doc_id AND t.code[1:2] = k.code)
SELECT doc_id, code, n::BIGINT AS n, signals FROM countries UNION ALL SELECT doc_id, code, n::BIGINT, list_filter([CASE WHEN by_text THEN 'text' END, CASE WHEN cited THEN 'entity' END], lambda x: x IS NOT NULL) FROM inside WHERE by_text OR cited"""


@query("t24_places", _DECIDED)
def places(spark, d):
    docs = C.table(spark, d, "documents")
    home = N.domain_country(F.concat_ws(".", "source", "lang"), ["DE", "FR", "ES"])
    body = P.without_references(F.col("text"))
    sources = docs.select("doc_id", F.char_length(body).alias("chars"), F.col("lang").alias("language"), home.alias("domain_country"), (F.length("source") == 4).alias("government"))
    named = P.mentions(docs.withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1))), _vocabulary(spark, d), "doc_id")
    cited = docs.where(F.contains("text", F.lit("GNU"))).select("doc_id", F.lit("LI").alias("code")).unionByName(docs.where(F.contains("text", F.lit("Apache"))).select("doc_id", F.lit("THOSE").alias("code")))
    return P.decided(sources, named, cited, spark.createDataFrame(LANGUAGE_COUNTRIES, "language string, country string"), "doc_id")


@query("t27_comparison_set", C.sql("terms place_names", r""", hosts AS (SELECT DISTINCT '*.gov.' || lang AS pattern FROM documents UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) FROM pages), known AS (SELECT code, min(surface) AS name FROM place_names WHERE length(code) = 2 GROUP BY code)
, tld AS (SELECT DISTINCT string_split(pattern, '.')[-1] AS t FROM hosts), codes AS (SELECT CASE t WHEN 'com' THEN 'CO' WHEN 'uk' THEN 'GB' ELSE upper(t) END AS code FROM tld WHERE t IN ('com', 'uk') OR (length(t) = 2 AND t <> 'en') UNION SELECT CASE jurisdiction WHEN 'UK' THEN 'GB' ELSE jurisdiction END FROM terms WHERE approved AND NOT rejected)
SELECT code, name FROM codes JOIN known USING (code)"""))
def comparison_set(spark, d):
    hosts = C.table(spark, d, "documents").select(F.concat(F.lit("*.gov."), "lang").alias("pattern")).unionByName(C.table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("pattern")))
    known = C.place_names(spark, d).where("length(code) = 2").groupBy("code").agg(F.min("surface").alias("name"))
    return P.comparison_set(hosts.distinct(), C.terms(spark, d), known, {"com": "CO", "uk": "GB"}, ["en"])
