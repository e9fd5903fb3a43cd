"""Hybrid search: a lexical and a vector arm over one filter, fused by reciprocal ranks, capped per source, aged."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import Filters, conditions, long_enough
from ..functions.vector import cosine, literal

#: Fusion constant, candidates an arm, similarity floor, least characters of a passage in the vector arm (fixed values).
RRF_K, CANDIDATES, FLOOR, LEAST_CHARS = 60, 100, 0.55, 40
#: Half-lives in days by tier and the least weight of an old source (fixed values).
HALF_LIFE, LEAST_WEIGHT = {"government": 3650, "institutional": 1825, "trade": 1825, "news": 365, "informal": 180}, 0.25


def lexical_arm(passages: DataFrame, words: list[str], id_col: str = "chunk_id", text_col: str = "text", limit: int = CANDIDATES) -> DataFrame:
    """(id, score, rank): passages that hold every word, by how often the words occur, ties to the smaller id.

    Occurrences are counted by a regular expression inside the scan's stage, so only the matching ids reach the top-k.
    """
    low = F.lower(F.col(text_col))
    count = lambda w: F.regexp_count(low, F.lit(rf"\b{re.escape(w)}\b" if w.isalnum() else re.escape(w)))
    hits = passages
    for w in words:
        hits = hits.where(low.contains(w))
    score = sum((count(w) for w in words[1:]), count(words[0])).cast("long")
    hits = hits.select(id_col, score.alias("score"), F.least(*(count(w) for w in words), F.lit(1)).alias("all") if words else F.lit(1).alias("all")).where("all > 0")
    return _ranked(hits.select(id_col, "score").orderBy(F.desc("score"), id_col).limit(limit), id_col)


def vector_arm(vectors: DataFrame, query: list[float], id_col: str = "chunk_id", vec_col: str = "v", limit: int = CANDIDATES, floor: float = FLOOR) -> DataFrame:
    """(id, score, rank): the nearest by cosine among those at or above the floor."""
    near = vectors.select(id_col, F.round(cosine(F.col(vec_col), literal(query)), 6).alias("score"))
    return _ranked(near.where(F.col("score") >= floor).orderBy(F.desc("score"), id_col).limit(limit), id_col)


def _ranked(top: DataFrame, id_col: str) -> DataFrame:
    """Ranks of at most a few hundred rows: they are one partition already."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def fuse(arms: list[DataFrame], id_col: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal rank fusion of any number of arms."""
    both = arms[0].select(id_col, "rank")
    for a in arms[1:]:
        both = both.unionByName(a.select(id_col, "rank"))
    return both.groupBy(id_col).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def cap_per_source(ranked: DataFrame, cap: int, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """The first ``limit`` of (id, source_id, score) with at most ``cap`` of a source; what was held back fills up the page.

    Equal to going down the list greedily: a passage is held back when its source has ``cap`` better ones.
    """
    order = [F.desc("score"), F.col(id_col)]
    w = Window.partitionBy("source_id").orderBy(*order)
    over = (F.row_number().over(w) > cap).alias("held_back")
    return ranked.select("*", over).orderBy("held_back", *order).limit(limit)


def age_weight(published: Column, tier: Column, today: str) -> Column:
    """Half the weight for each half-life, not below a quarter; undated and future sources count as new, peer-reviewed ones don't age."""
    life = F.create_map(*(x for t, n in HALF_LIFE.items() for x in (F.lit(t), F.lit(float(n)))))[tier]
    age = F.greatest(F.datediff(F.lit(today).cast("date"), published), F.lit(0))
    return F.when(published.isNull() | life.isNull(), 1.0).otherwise(F.greatest(F.lit(LEAST_WEIGHT), F.pow(F.lit(0.5), age / life)))


def hybrid(
    passages: DataFrame, vectors: DataFrame, sources: DataFrame, words: list[str], query: list[float], filters: Filters = Filters(),
    cap: int = 2, limit: int = 20, floor: float = FLOOR, today: str = "2024-02-01",
) -> DataFrame:
    """(chunk_id, source_id, score, held_back): one page of hits.

    passages: chunk_id, source_id, text; vectors: chunk_id, source_id, v.  Both arms read only sources that pass the filter; wide columns are not touched until
    the ids of the page are known.
    """
    good = sources.where(conditions(filters)).select("source_id", "tier", "published")
    only = good.select("source_id")
    lex = lexical_arm(passages.join(only, "source_id", "left_semi"), words)
    vec = vector_arm(vectors.join(only, "source_id", "left_semi"), query, floor=floor)
    fused = fuse([lex, vec])
    owner = passages.select("chunk_id", "source_id").unionByName(vectors.select("chunk_id", "source_id"))
    owned = owner.join(F.broadcast(fused), "chunk_id").distinct()  # at most two arms' candidates
    aged = owned.join(good, "source_id").withColumn("score", F.round(F.col("score") * age_weight(F.col("published"), F.col("tier"), today), 8))
    return cap_per_source(aged.select("chunk_id", "source_id", "score"), cap, limit)


def best_per_source(hits: DataFrame, id_col: str = "chunk_id", least: int = 120) -> DataFrame:
    """(source_id, best, passages): each source's best hit, long passages before short ones, then by score, then the smaller id."""
    key = F.struct(F.char_length("text") >= least, F.col("score"), -F.col(id_col))
    return hits.groupBy("source_id").agg(F.max_by(F.col(id_col), key).alias("best"), F.count("*").alias("passages"))


def lead_items(hits: DataFrame, weights: dict[str, float], limit: int) -> DataFrame:
    """Items by score * weight of tier, halved for each better item of the same publisher; the window form of going down greedily."""
    w = F.create_map(*(x for t, v in weights.items() for x in (F.lit(t), F.lit(v))))
    value = F.col("score") * F.coalesce(w[F.col("tier")], F.lit(1.0))
    nth = F.row_number().over(Window.partitionBy("publisher").orderBy(F.desc("value"), "source_id"))
    valued = hits.withColumn("value", value)
    return valued.withColumn("lead", F.round(F.col("value") * F.pow(F.lit(0.5), nth - 1), 8)).orderBy(F.desc("lead"), "source_id").limit(limit)


def verdict(sources: DataFrame, group: str) -> DataFrame:
    """(group, publishers, verdict): strong with three publishers and one strong tier among them, else thin."""
    strong = (F.count_distinct("publisher") >= 3) & F.bool_or(F.col("tier").isin("peer_reviewed", "government"))
    return sources.groupBy(group).agg(F.count_distinct("publisher").alias("publishers"), F.when(strong, "strong").otherwise("thin").alias("verdict"))


def rerank(ranked: DataFrame, scores: DataFrame, id_col: str = "chunk_id", head: int = 30) -> DataFrame:
    """The first ``head`` of (id, rank) in the order of another score, ties as before; the rest as it was."""
    s = ranked.join(scores, id_col, "left")
    order = F.row_number().over(Window.orderBy(F.col("rank") > head, F.when(F.col("rank") <= head, -F.col("new_score")).asc_nulls_last(), "rank"))
    return s.select(id_col, order.cast("long").alias("rank"))


#: Copy folding: words of a shingle, fewest shingles of a passage, share that makes it a copy (fixed values).
FOLD_WORDS, FOLD_LEAST, FOLD_SHARE = 5, 12, 0.5


def page(ranked: DataFrame, offset: int, limit: int, candidates: int = CANDIDATES, id_col: str = "chunk_id") -> DataFrame:
    """(id, rank, has_more) of one page of (id, score); pages beyond the candidates are refused, and one row more tells whether there is another page."""
    if offset < 0 or limit < 1 or offset + limit > candidates:
        raise ValueError(f"a page must lie within the first {candidates} hits")
    top = _ranked(ranked.orderBy(F.desc("score"), id_col).limit(offset + limit + 1), id_col)
    more = top.agg((F.max("rank") > offset + limit).alias("has_more"))
    return top.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).join(F.broadcast(more)).select(id_col, "rank", "has_more")


def set_back(hits: DataFrame, flagged: Column, id_col: str = "chunk_id") -> DataFrame:
    """(id, rank): flagged hits after all others, each part in its order.  hits: a bounded list of (id, rank, …)."""
    return hits.select(id_col, F.row_number().over(Window.orderBy(flagged, "rank")).cast("long").alias("rank"))


def shingles(text: Column, n: int = FOLD_WORDS) -> Column:
    """The distinct n-word shingles of a text's lower-case words."""
    w = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9à-öø-ÿß]+", " "), " "), lambda x: x != "")

    def of(w: Column) -> Column:
        last = F.size(w) - n + 1
        return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))

    # bound once: written out in the inner function, the words would be split again for every shingle
    return F.transform(F.array(w), of)[0]


def fold_copies(hits: DataFrame, id_col: str = "chunk_id", least: int = FOLD_LEAST, share: float = FOLD_SHARE) -> DataFrame:
    """(id, folded_into): down (id, source_id, rank, text), a hit folds into a kept one of another source.

    It folds when at least ``share`` of its shingles are among those of the kept hits of one other source; into the kept hit of that source which shares
    most, ties to the better rank.  Short passages never fold.  Equal texts are split once, into hashes of shingles; only the greedy walk, over an id, a source and a rank a hit, is one task's.
    A kept hit whose text its source has kept already changes nothing that follows, so a walk holds each text once a source, and looks again at a text only after another was kept.
    """
    import pandas as pd

    same = hits.groupBy("text").agg(F.collect_list(F.struct(F.col("rank"), F.col(id_col).alias("id"), F.col("source_id").alias("source"))).alias("hits"))
    texts = same.select("hits", F.transform(shingles(F.col("text")), lambda g: F.xxhash64(g)).alias("own"))

    def walk(table: pd.DataFrame) -> pd.DataFrame:
        own = [frozenset(o) for o in table["own"]]
        kept: list = []  # (source, rank, id)
        held: set = set()  # (source, text) of the kept
        holds: dict = {}  # of a shingle, the kept hits that have it
        seen: dict = {}  # of a text, the number of kept hits when it was last looked at, and what was found
        out = []

        def shared(t: int) -> tuple[dict, list]:
            """The shingles of a text that each source has kept, and the kept hits by what they share with it."""
            if seen.get(t, (-1,))[0] != len(kept):
                each, of = {}, {}
                for g in own[t]:
                    for k in holds.get(g, ()):
                        each[k] = each.get(k, 0) + 1
                    for source in {kept[k][0] for k in holds.get(g, ())}:
                        of[source] = of.get(source, 0) + 1
                seen[t] = len(kept), of, sorted(each, key=lambda k: (-each[k], kept[k][1]))
            return seen[t][1:]

        for rank, key, source, t in sorted((h["rank"], h["id"], h["source"], t) for t, hs in enumerate(table["hits"]) for h in hs):
            into = None
            if len(own[t]) >= least:
                of, nearest = shared(t)
                into = next((kept[k][2] for k in nearest if kept[k][0] != source and of[kept[k][0]] >= share * len(own[t])), None)
            if into is None and own[t] and (source, t) not in held:
                held.add((source, t))
                for g in own[t]:
                    holds.setdefault(g, []).append(len(kept))
                kept.append((source, rank, key))
            out.append((key, into))
        return pd.DataFrame(out, columns=[id_col, "folded_into"]).astype({"folded_into": "Int64"})

    kind = dict(hits.dtypes)[id_col]
    return texts.groupBy().applyInPandas(walk, f"{id_col} {kind}, folded_into {kind}")


def hydrated(ids: DataFrame, chunks: DataFrame, sources: DataFrame, topics: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The wide columns of some ids, joined late: passages, their sources, and their own topics where they have any; whether the ids are sent is the planner's choice."""
    wide = chunks.join(ids, id_col)
    return wide.join(sources, "source_id").join(topics, id_col, "left")
