"""Topics from vectors and words: prototypes, labels, clusters, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot, unit


def means(vectors: DataFrame, by: list[str], vec: str = "v") -> DataFrame:
    """(by, mean): the mean vector of each group, summed by dimension so that nothing is collected."""
    e = vectors.select(*by, F.posexplode(vec).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg("x").alias("x"))
    return e.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))


def prototype_scores(vectors: DataFrame, prototypes: DataFrame, centre: DataFrame) -> DataFrame:
    """(chunk_id, topic, score): cosine with each topic's prototype after the centre (one row) is taken off; four digits.

    Topics are a vocabulary of a fixed size, so prototypes and the centre are sent to every task.
    """
    less = lambda a, b: unit(F.zip_with(a, b, lambda x, y: x - y))
    p = prototypes.select(F.col("topic"), F.col("mean").alias("p")).join(F.broadcast(centre.select(F.col("mean").alias("c"))))
    p = p.select("topic", less(F.col("p"), F.col("c")).alias("p"), "c")
    packed = p.agg(F.collect_list(F.struct("topic", "p")).alias("ps"), F.first("c").alias("c"))
    both = vectors.select("chunk_id", "v").join(F.broadcast(packed))
    scored = both.withColumn("u", less(F.col("v"), F.col("c"))).select("chunk_id", "u", F.explode("ps").alias("t"))
    return scored.select("chunk_id", "t.topic", (F.round(dot(F.col("u"), F.col("t.p")), 4) + 0.0).alias("score"))


def labels(scores: DataFrame, floor: float = 0.5, margin: float = 0.04) -> DataFrame:
    """(chunk_id, topics): topics at the floor or above and within the margin of the best, best first, ties by name."""
    best = F.max("score").over(Window.partitionBy("chunk_id"))
    ok = scores.withColumn("best", best).where((F.col("score") >= floor) & (F.col("score") >= F.round(F.col("best") - margin, 4)))
    rows = ok.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "topic"))).alias("r"))
    return rows.select("chunk_id", F.transform("r", lambda x: x["topic"]).alias("topics"))


def comparable(score: Column, language: Column) -> Column:
    """Scores of other languages than English stretched around 0.2."""
    return F.when(language != "en", F.least(F.lit(1.0), 0.2 + 1.2 * (score - 0.2))).otherwise(score)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(chunk_id, leaf): the centroid with the largest dot product, ties to the smaller leaf; centroids are a bounded set."""
    packed = centroids.agg(F.collect_list(F.struct("leaf", "mean")).alias("cs"))
    both = vectors.select("chunk_id", "v").join(F.broadcast(packed))
    scored = F.transform("cs", lambda c: F.struct(F.round(dot(F.col("v"), c["mean"]), 8).alias("s"), (-c["leaf"]).alias("l")))
    return both.select("chunk_id", (-F.array_max(scored)["l"]).alias("leaf"))


def class_tfidf(docs: DataFrame, top: int = 12, least: int = 2) -> DataFrame:
    """(cls, term, score): terms of each class by tf * ln(1 + A / f), of those in at least ``least`` sources.

    docs: cls, source_id, text.  A is the mean number of words a class, f a term's number over all classes.
    """
    words = docs.select("cls", "source_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("term"))
    tf = words.groupBy("cls", "term").agg(F.count("*").alias("tf"))
    spread = words.groupBy("term").agg(F.count("*").alias("f"), F.count_distinct("source_id").alias("k")).where(F.col("k") >= least)
    mean = tf.groupBy("cls").agg(F.sum("tf").alias("n")).agg(F.avg("n").alias("a"))
    scored = tf.join(spread, "term").join(F.broadcast(mean)).withColumn("score", F.round(F.col("tf") * F.log(1 + F.col("a") / F.col("f")), 4))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "term"))
    return scored.withColumn("r", rank).where(F.col("r") <= top).select("cls", "term", "score")
