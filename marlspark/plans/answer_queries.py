"""Searches over a written index, the answer out of one search, names that are alike, mentions and nested areas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoints import checkpoint, shared_folder
from ..functions.predicates import Filters
from ..operators import answer as A
from ..operators import clusters as K
from ..operators import fulltext as X
from ..operators import gazetteer as G
from ..operators import places as P
from ..operators import resolution as R
from ..sources import corpus as C
from .corpus_queries import TEST_FLOOR
from .place_queries import _vocabulary
from .registry import query

_WRITTEN: dict[tuple[str, str], tuple] = {}


def index(spark, d):
    """(index, passages, vectors): written once a session and input, as a user would write them once."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
        chunks = C.chunks(spark, d)
        chunks.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.parquet(f"{path}/passages")
        passages = spark.read.schema(chunks.schema).parquet(f"{path}/passages")
        # a document's vector is taken for that of its first line
        v = C.vectors(spark, d).select((F.col("chunk_id") * 10000).alias("chunk_id"), F.col("chunk_id").alias("source_id"), "v")
        v = v.join(passages.select("chunk_id", F.char_length("text").alias("n_chars")), "chunk_id", "left")
        v.write.parquet(f"{path}/vectors")
        _WRITTEN[key] = (X.write_index(passages, f"{path}/postings"), passages, spark.read.schema(v.schema).parquet(f"{path}/vectors"))
    return _WRITTEN[key]


QUESTION = 'der "und der" -sich or les "de la" or that with -"of the"'
_PAD = "' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9à-öø-ÿß]+'), ' ') || ' '"


@query("r2_question", C.sql("chunks", f"""SELECT chunk_id FROM (SELECT chunk_id, {_PAD} AS p FROM chunks)
WHERE (contains(p, ' der ') AND contains(p, ' und der ') AND NOT contains(p, ' sich ')) OR (contains(p, ' les ') AND contains(p, ' de la '))"""))
def question(spark, d):
    i, _, _ = index(spark, d)
    # "that" and "with" are stop words: the third alternative wants nothing and is none
    return X.matching(spark, i, X.parse(QUESTION)).select(F.col("id").alias("chunk_id"))


@query("r1_cover_density")
def cover_density(spark, d):
    i, _, _ = index(spark, d)
    return X.lexical(spark, i, X.parse('der und or les "de la"')).select(F.col("id").alias("chunk_id"), F.col("source").alias("source_id"), "score", "rank")


def probe(vectors):
    return vectors.where("source_id = 1").first()["v"]


@query("r15_search_page")
def search_page(spark, d):
    i, passages, vectors = index(spark, d)
    f = Filters(languages=("en", "de", "fr"), cleared_only=True)
    return X.page(spark, i, passages, vectors, C.sources(spark, d), 'der und or les "de la"', probe(vectors), f, cap=2, floor=TEST_FLOOR, today="2024-02-01")


@query("r26_answer")
def answer(spark, d):
    i, passages, vectors = index(spark, d)
    src = C.sources(spark, d)
    hits = X.page(spark, i, passages, vectors, src, "der und or les", probe(vectors), limit=600, floor=TEST_FLOOR, candidates=300)
    vocab = _vocabulary(spark, d)
    ids = hits.select("source_id").distinct()
    near = src.join(ids, "source_id", "left_semi")
    found = P.ordered(P.counted(near.select("source_id", "text"), vocab, "source_id").where("n >= 4"), "source_id")
    near = near.join(found, "source_id", "left").select("source_id", "publisher", "tier", "published", F.coalesce("places", F.array().cast("array<string>")).alias("places"))
    named = P.counted(hits.where("text is not null").select("chunk_id", "text"), vocab, "chunk_id").select("chunk_id", P.country_of(F.col("code")).alias("code"))
    asked = spark.createDataFrame([(1, "which countries of them", None)], "question_id long, question string, filtered array<string>")
    by = A.grouping(asked, vocab).first()["by"]
    return A.answer(hits.select("chunk_id", "source_id", "score", F.coalesce("text", F.lit("")).alias("text")), near, named, by)


@query("r25_grouping", C.sql("place_names", r""", q AS (SELECT item_id AS question_id, text AS question FROM benchmark UNION ALL SELECT 100000 + conv_id * 100 + turn, text FROM conversations),
t AS (SELECT question_id, regexp_extract_all(question, '[\p{L}\p{N}_]+') AS w, question FROM q), names AS (SELECT surface, code FROM place_names WHERE (NOT ambiguous OR code IS NULL) AND NOT contains(surface, ' '))
SELECT question_id, CASE WHEN n THEN 'place' WHEN regexp_matches(question, '(?i)\b(?:countries|nations|cities|jurisdictions|worldwide|internationally|globally|around the world|(?:which|what|each|every|per|by|across|other|different) (?:country|city|jurisdiction))\b|^\s*where\b') THEN 'place' ELSE 'none' END AS by,
  CASE WHEN n THEN 'named' WHEN regexp_matches(question, '(?i)\b(?:countries|nations|cities|jurisdictions|worldwide|internationally|globally|around the world|(?:which|what|each|every|per|by|across|other|different) (?:country|city|jurisdiction))\b|^\s*where\b') THEN 'asked' ELSE 'neither' END AS why
FROM (SELECT question_id, question, list_has_any(w, known) AS n FROM t, (SELECT list(DISTINCT v) AS known FROM (SELECT surface AS v FROM names UNION ALL SELECT upper(surface) FROM names)))"""))
def grouping(spark, d):
    b, c = C.table(spark, d, "benchmark"), C.table(spark, d, "conversations")
    q = b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question")).unionByName(c.select((100000 + F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.col("text").alias("question")))
    vocab = P.vocabulary(C.place_names(spark, d).where(~F.contains("surface", F.lit(" "))))
    return A.grouping(q.withColumn("filtered", F.lit(None).cast("array<string>")), vocab).select("question_id", "by", "why")


@query("f23_similar_names")
def similar_names(spark, d):
    """Words of the corpus' questions that are nearly alike, kind by kind; the kind is the first letter."""
    words = C.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(C.WORD), F.lit(0))).alias("name")).where("length(name) > 5").distinct()
    return R.similar_names(words.withColumn("kind", F.left("name", F.lit(1))), 0.85)


@query("g17_mentions")
def mentions(spark, d):
    """What documents call the terms of the gazetteer, resolved to them."""
    t = C.terms(spark, d)
    entities = t.select(F.col("term_id").alias("entity_id"), F.col("canonical").alias("name"), F.col("entity_type").alias("kind"), "jurisdiction", F.when(F.col("rejected"), F.lit(0)).cast("long").alias("redirects_to"), F.lit(None).cast("array<double>").alias("v"))
    known = G.surfaces(t).select("surface", "cased", "entity_type").distinct()
    found = G.find(C.table(spark, d, "documents"), known.select("surface", "cased").distinct(), "doc_id").join(known, ["surface", "cased"])
    said = found.groupBy("doc_id", "surface", F.col("entity_type").alias("kind")).agg(F.min("start").alias("start"))
    m = said.select(F.xxhash64("doc_id", "surface", "kind").alias("mention_id"), F.col("surface").alias("name"), "kind", F.lit(None).cast("string").alias("jurisdiction"), F.lit(None).cast("array<double>").alias("v"))
    m = checkpoint(m)  # texts are matched once
    short = t.where("approved").select(F.explode("aliases").alias("short"), F.lower("canonical").alias("long")).where("not contains(short, ' ')").groupBy(F.lower("short").alias("short")).agg(F.min("long").alias("long"))
    return R.resolved(m, entities, short)


@query("v15_nested_areas")
def nested(spark, d):
    member, _ = K.nest(C.vectors(spark, d).select(F.col("chunk_id").alias("id"), "v"), checkpoint)
    return member
