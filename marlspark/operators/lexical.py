"""Lexical search over a table of postings: words that must, may and may not occur, phrases, scripts without spaces, ranking by BM25."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import wide_pairs

#: Words that no search is for (fixed values).
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: The constants of BM25 (fixed values): how soon repeats saturate, how much length counts.
SATURATION, LENGTH = 1.2, 0.75


@dataclass(frozen=True)
class Terms:
    """A search: all of ``words`` and ``phrases``, one of each of ``either``, none of ``without``; all in lower case."""

    words: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    either: tuple[tuple[str, ...], ...] = ()
    without: tuple[str, ...] = ()


def tokens(text: Column) -> Column:
    """Runs of Latin letters and digits, lower case; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9à-öø-ÿß]+)"), F.lit(1))


def matches(text: Column, terms: Terms) -> Column:
    """Whether a text answers a search: one condition over its padded words, so phrases need no places."""
    padded = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    has = lambda t: padded.contains(f" {t} ")
    out = F.lit(True)
    for t in (*terms.words, *terms.phrases):
        out = out & has(t)
    for group in terms.either:
        some = F.lit(False)
        for t in group:
            some = some | has(t)
        out = out & some
    for t in terms.without:
        out = out & ~has(t)
    return out


def postings(passages: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(word, id, tf, length): each word of each passage, how often it is there, and the passage's number of words; stop words are left out.

    Counts are summed up before the shuffle; write the table once, bucketed by word, and each search reads its words alone.
    """
    words = F.filter(tokens(F.col(text_col)), lambda t: ~t.isin(*STOP_WORDS))
    each = passages.select(id_col, words.alias("w")).select(id_col, F.size("w").alias("length"), F.explode("w").alias("word"))
    return each.groupBy("word", id_col, "length").agg(F.count("*").alias("tf")).select("word", id_col, "tf", "length")


def extent(passages: DataFrame, text_col: str = "text") -> tuple[int, float]:
    """(passages, mean length) of what ``postings`` holds: one aggregation beside it, without a shuffle of its rows."""
    n = F.size(F.filter(tokens(F.col(text_col)), lambda t: ~t.isin(*STOP_WORDS)))
    row = passages.select(n.alias("n")).where("n > 0").agg(F.count("*").alias("k"), F.avg("n").alias("mean")).first()
    return row["k"], row["mean"] or 1.0


def bm25(table: DataFrame, passages: int, mean_length: float, words: list[str], id_col: str = "chunk_id", limit: int = 100) -> DataFrame:
    """(id, score, rank): passages that hold every word, by BM25, ties to the smaller id.  table: of ``postings``; only the rows of ``words`` are read."""
    asked = sorted(set(words))
    hits = table.where(F.col("word").isin(*asked))
    held = hits.groupBy("word").agg(F.count("*").alias("df"))  # a row a word
    idf = F.log(1 + (passages - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = SATURATION * (1 - LENGTH + LENGTH * F.col("length") / mean_length)
    part = F.col("idf") * F.col("tf") * (SATURATION + 1) / (F.col("tf") + norm)
    scored = hits.join(F.broadcast(held.select("word", idf.alias("idf"))), "word").groupBy(id_col)
    scored = scored.agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("n")).where(F.col("n") == len(asked))
    top = scored.select(id_col, "score").orderBy(F.desc("score"), id_col).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def wide_arm(passages: DataFrame, asked: str, id_col: str = "chunk_id", text_col: str = "text", limit: int = 100) -> DataFrame:
    """(id, score): passages that hold every run of Chinese, Japanese or Korean characters of a query, by how many of their pairs are among the query's."""
    runs = [r for r in _runs(asked) if r]
    if not runs:
        return passages.select(id_col, F.lit(0).alias("score")).limit(0)
    hold = F.lit(True)
    for r in runs:  # a run whose pairs follow one another is the run itself
        hold = hold & F.col(text_col).contains(r)
    wanted = sorted({r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))})
    score = F.size(F.filter(wide_pairs(F.col(text_col)), lambda p: p.isin(*wanted)))
    return passages.where(hold).select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def _runs(text: str) -> list[str]:
    import re

    return re.findall("[぀-ヿ㐀-鿿가-힯]+", text)


def degraded(arms: DataFrame) -> DataFrame:
    """(arm, reason): why an arm of a search did not run.  arms: arm, wanted, available, candidates."""
    why = F.when(~F.col("wanted"), "not asked for").when(~F.col("available"), "not available").when(F.col("candidates") == 0, "nothing above its floor")
    return arms.select("arm", why.alias("reason")).where("reason is not null")


def one_list(hits: DataFrame, id_col: str = "chunk_id", least: int = 120) -> DataFrame:
    """(source_id, best, passages, place): all sources as one list, by their best passage (of the long ones where there are any), ties to the smaller id.

    hits: id, source_id, score, text: the bounded hits of one search.
    """
    key = F.struct(F.char_length("text") >= least, F.col("score"), -F.col(id_col))
    best = hits.groupBy("source_id").agg(F.max_by(F.col(id_col), key).alias("best"), F.max_by("score", key).alias("score"), F.count("*").alias("passages"))
    return best.select("source_id", "best", "passages", F.row_number().over(Window.orderBy(F.desc("score"), "best")).cast("long").alias("place"))
