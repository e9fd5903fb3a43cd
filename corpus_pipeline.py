"""From raw documents to training sequences: toxicity, exact copies, near copies, secrets, packing.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of ``docs``.  Each works on all rows that its
predecessor kept; a null doc_id is treated as the smallest one, and rows without text are clean documents of no words.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.llm import exact_dedup, packing, secrets, simhash, toxicity
from marlspark.llm.common import numbered, stored

SMALLEST = -(1 << 63)


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(SMALLEST))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model takes for toxic go; without labels of both classes all stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = numbered(docs)
    scored = toxicity.measured(plain, model, f"c{docs.columns.index('text')}", plain.columns)
    return scored.where("score < 0.5").select(*plain.columns).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, once; rows of one doc_id with other texts are judged by themselves."""
    plain = numbered(docs)
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    sha = F.sha2(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), 256)
    kept = exact_dedup.deduplicate(docs).where("kept").select(_key("keep_id").alias("key"), F.col("text_sha256").alias("sha"))
    out = plain.withColumns({"key": _key(doc_id), "sha": sha}).join(kept, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"])
    return out.select(*plain.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays; rows that share a doc_id stay or go together."""
    plain = numbered(docs)
    least = simhash.near_duplicates(docs).select(_key("component_id").alias("key")).distinct()
    out = plain.withColumn("key", _key(f"c{docs.columns.index('doc_id')}")).join(least, "key", "left_semi")
    return out.select(*plain.columns).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows; all rows stay."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence, with its ids."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: The language models can't be stated in SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
    return docs
