"""The graph of cited claims: neighbourhoods, contradictions, routes, entity resolution, merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of relations that contradict each other (fixed values, each in both orders).
OPPOSITE = [("increases", "reduces")]
#: Candidates an entity is resolved against (fixed value).
MAX_CANDIDATES = 25


def both_ways(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Every edge from either end, as (node, other, …): a union, so that no join has an OR."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def neighbourhood(edges: DataFrame, node: str, limit: int) -> DataFrame:
    """(other, edges, support, confidence): the neighbours of a node, best supported first."""
    near = both_ways(edges).where(F.col("node") == node).groupBy("other")
    near = near.agg(F.count("*").alias("edges"), F.sum("support").alias("support"), F.coalesce(F.max("confidence"), F.lit(-1.0)).alias("confidence"))
    return near.orderBy(F.desc("support"), F.desc("confidence"), "other").limit(limit)


def contradictions(edges: DataFrame) -> DataFrame:
    """(a, b, reason) of edges with the same ends: one relation with opposite stances, or opposite relations that are both unopposed.

    edges: edge_id, src, dst, relation, stance.  The relation that could contradict is part of each join's key, so edges that can't contradict never meet.
    """
    e = edges.select("edge_id", "src", "dst", "relation", "stance")
    a, b = e.select(F.col("edge_id").alias("a"), "src", "dst", "relation", F.col("stance").alias("x")), e.select(F.col("edge_id").alias("b"), "src", "dst", "relation", F.col("stance").alias("y"))
    stance = a.join(b, ["src", "dst", "relation"]).where("x <> y and a < b").select("a", "b", F.lit("stance").alias("reason"))
    table = F.create_map(*(F.lit(x) for p, q in OPPOSITE for x in (p, q, q, p)))
    plain = F.col("stance") == "supports"
    left = e.where(plain).select(F.col("edge_id").alias("a"), "src", "dst", F.try_element_at(table, F.col("relation")).alias("relation")).where("relation is not null")
    right = e.where(plain).select(F.col("edge_id").alias("b"), "src", "dst", "relation")
    return stance.unionByName(left.join(right, ["src", "dst", "relation"]).where("a < b").select("a", "b", F.lit("relation").alias("reason")))


def distances(links: DataFrame, start: str, depth: int, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, hops, via): nodes within ``depth`` hops of ``start`` and the best supported edge that reaches each first, level by level.

    links: a, b, support.  A level joins only its frontier; each level is written.
    """
    steps = both_ways(links, "a", "b").select("node", "other", "support")
    seen = checkpoint(links.sparkSession.createDataFrame([(start, 0, None)], "node string, hops int, via string"))
    front = seen
    for hop in range(1, depth + 1):
        reach = front.select("node").join(steps, "node").join(seen.select(F.col("node").alias("other")), "other", "left_anti")
        best = reach.groupBy("other").agg(F.min_by("node", F.struct(-F.col("support"), F.col("node"))).alias("via"))
        front = checkpoint(best.select(F.col("other").alias("node"), F.lit(hop).alias("hops"), "via"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def route(links: DataFrame, start: str, goal: str, depth: int, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(step, node): the nodes of a shortest route, or nothing."""
    seen = distances(links, start, depth, checkpoint)
    steps, node = [], goal
    for _ in range(depth + 1):  # one row a step of a route of at most ``depth`` hops
        row = seen.where(F.col("node") == node).first()
        if row is None:
            return links.sparkSession.createDataFrame([], "step int, node string")
        steps.append((row["hops"], node))
        if row["via"] is None:
            break
        node = row["via"]
    return links.sparkSession.createDataFrame(sorted(steps), "step int, node string")


def name_tokens(name: Column) -> Column:
    """Words of more than two characters, lower case."""
    return F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " "), lambda t: F.char_length(t) > 2))


def blocking(entities: DataFrame, common: int | None = None) -> DataFrame:
    """(a, b, shared, same): every pair a < b of entities of a kind that share words, between representatives, and who is represented.

    Entities of one kind and the same words are a class, its smallest id stands for it.  ``same`` rows tell who is in a class (b is in that of a) with the number of its words; the others
    are pairs of representatives with the number of words that both classes share.  Two entities share a word if they are of one class or their representatives are a pair; no
    word is left out unless ``common`` is given, beyond which number of entities a word blocks nothing.

    entities: id, name, kind; id is unique.
    """
    t = entities.select("id", "kind", F.array_sort(name_tokens(F.col("name"))).alias("words"))
    if common is not None:
        each = t.select("id", "kind", F.explode("words").alias("word"))
        rare = each.groupBy("kind", "word").agg(F.count("*").alias("n")).where(F.col("n") <= common).select("kind", "word")
        t = each.join(rare, ["kind", "word"]).groupBy("id", "kind").agg(F.sort_array(F.collect_list("word")).alias("words"))
    t = t.where(F.size("words") > 0)
    heads = t.groupBy("kind", "words").agg(F.min("id").alias("a"))
    members = t.join(heads, ["kind", "words"]).where("id <> a").select("a", F.col("id").alias("b"), F.size("words").cast("long").alias("shared"), F.lit(True).alias("same"))
    each = heads.select("kind", "a", F.explode("words").alias("word"))
    met = each.join(each.withColumnRenamed("a", "b"), ["kind", "word"]).where("a < b")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared")).withColumn("same", F.lit(False))
    return members.unionByName(pairs)


def blocks(entities: DataFrame) -> DataFrame:
    """(kind, word, id, members): every word of every entity with the number of entities of its kind that hold it; a row a word of an entity, whatever its frequency.

    entities: id, name, kind.
    """
    t = entities.select("id", "kind", F.explode(name_tokens(F.col("name"))).alias("word")).distinct()
    return t.join(t.groupBy("kind", "word").agg(F.count("*").alias("members")), ["kind", "word"])


def candidates(entities: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """(id, others): the first ``limit`` other entities of a kind with the same name or a shared word, equal names (in any case) first, then by id; none gives an empty array.

    entities: id, name, kind; id is unique.  No pairs are made and no word is left out: what stands among the first ``limit`` of all that share
    something stands among the first ``limit`` + 1 of some word or of the name, so every word needs only its smallest ids.  Entities of one kind and
    name (in any case) see the same others but for themselves, so the first ``limit`` + 1 are found once a name, and each entity takes itself out.
    """
    keys = F.concat(F.array(F.struct(F.lit(True).alias("exact"), F.col("low").alias("word"))), F.transform(name_tokens(F.col("low")), lambda w: F.struct(F.lit(False).alias("exact"), w.alias("word"))))
    own = entities.select("id", "kind", F.lower(F.trim("name")).alias("low"))

    def smallest(t: DataFrame, by: list[str]) -> DataFrame:
        first = t.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= limit + 1)
        return first.groupBy(*by).agg(F.sort_array(F.collect_list("id")).alias("ids"))

    names = smallest(own.where("low <> ''"), ["kind", "low"]).withColumn("k", F.explode(keys)).select("kind", "low", "ids", "k.exact", "k.word").where("word <> ''")
    by = ["kind", "exact", "word"]
    heads = smallest(names.select(*by, F.explode("ids").alias("id")), by)
    met = names.drop("ids").join(heads, by).groupBy("kind", "low").agg(F.collect_list(F.struct("exact", "ids")).alias("met"))
    of = lambda exact: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("met", lambda m: m["exact"] == exact), lambda m: m["ids"]))))
    best = met.select("kind", "low", F.slice(F.concat(of(True), F.array_except(of(False), of(True))), 1, limit + 1).alias("first"))
    found = own.join(best, ["kind", "low"], "left")
    return found.select("id", F.coalesce(F.slice(F.filter("first", lambda x: x != F.col("id")), 1, limit), F.array().cast("array<long>")).alias("others"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean of the parts that are not null."""
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    return F.when(total > 0, value / total)


def band(score: Column, merge: float = 0.9, separate: float = 0.55) -> Column:
    return F.when(score >= merge, "merge").when(score < separate, "separate").otherwise("adjudicate")


def fold(edges: DataFrame, redirects: DataFrame) -> DataFrame:
    """Edges after merges: ends follow ``redirects`` (id, to) once, equal claims become one that unites their support.

    edges: edge_id, src, dst, relation, stance, support.
    """
    r = redirects.select("id", "to")
    s = edges.join(r.select(F.col("id").alias("src"), F.col("to").alias("_s")), "src", "left").join(r.select(F.col("id").alias("dst"), F.col("to").alias("_d")), "dst", "left")
    moved = s.select("edge_id", F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), "relation", "stance", "support")
    return moved.where("src <> dst").groupBy("src", "dst", "relation", "stance").agg(F.min("edge_id").alias("edge_id"), F.sum("support").alias("support"), F.count("*").alias("folded"))


def violations(edges: DataFrame, entities: DataFrame, relations: list[str]) -> DataFrame:
    """(edge_id, rule): the rules that edges break."""
    ids = entities.select("id")
    gone = lambda end: edges.join(ids, edges[end] == ids.id, "left_anti").select("edge_id", F.lit(f"{end} is unknown").alias("rule"))
    own = edges.select("edge_id", F.explode(F.array_compact(F.array(
        F.when(~F.col("relation").isin(*relations), "relation is unknown"), F.when(F.col("src") == F.col("dst"), "ends are one"), F.when(F.coalesce("support", F.lit(0)) == 0, "nothing supports it")))).alias("rule"))
    return gone("src").unionByName(gone("dst")).unionByName(own)


def top_hints(edges: DataFrame, per: int, limit: int) -> DataFrame:
    """At most ``per`` best supported edges of each neighbour, ``limit`` in all."""
    w = Window.partitionBy("other").orderBy(F.desc("support"), "edge_id")
    return edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per).drop("r").orderBy(F.desc("support"), "edge_id").limit(limit)
