"""Names that are nearly alike, and mentions resolved to entities.

``ratio`` is the matching-blocks ratio of two strings: twice the characters in matching blocks over all characters, of the first against the second.  Blocks stand
in one order in both strings, so a ratio r of strings of m and n characters leaves at most k = (1 - r)(m + n) characters unmatched.  From that ``similar_names`` bounds
lengths and the q-grams that two names must share, joins names by the rarest grams of each (a prefix of its grams by frequency), and computes the ratio of
what is left.  No pair is lost.
"""

from __future__ import annotations

import difflib
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import band, jaccard, weighted

#: Weights of shared words and of the ratio in the likeness of two names, and weights of the three signals (fixed values).
BY_WORDS, BY_RATIO = 0.75, 0.25
STRING, EMBEDDING, CONTEXT = 0.3, 0.3, 0.4
#: Words that tell no name from another (fixed values).
NOISE = ["the", "a", "an", "of", "and", "ltd", "limited", "inc", "plc", "pte"]


def ratio(a: Column, b: Column) -> Column:
    """The matching-blocks ratio; null if one is."""

    @F.pandas_udf("double")
    def compute(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return compute(a, b)


def string_similarity(a: Column, b: Column) -> Column:
    """Shared words and matching blocks of two normal names; 0 where one has no word."""
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(BY_WORDS * jaccard(x, y) + BY_RATIO * ratio(a, b))


def words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""))


# ---- names that are nearly alike


def unmatched(total: Column, least: float) -> Column:
    """The characters of two names of ``total`` characters that a ratio of ``least`` may leave unmatched."""
    return F.floor((1 - least) * total + 1e-9)


def least_pairs(least: float) -> int:
    """From so many characters on, any two names within the bound on lengths share a pair of letters."""
    shared = lambda m, n: max(m, n) - 1 - 2 * math.floor((1 - least) * (m + n) + 1e-9)
    within = lambda m: range(m, math.floor(m * (2 - least) / least + 1e-9) + 1)
    far = 400
    bad = [m for m in range(1, far) if any(shared(m, n) < 1 for n in within(m))]
    return max(bad, default=0) + 1


def similar_names(names: DataFrame, least: float = 0.85) -> DataFrame:
    """(kind, a, b, ratio): pairs of distinct names a < b of one kind with ratio(a, b) of at least ``least``.

    names: kind, name; rows that repeat count once, null and empty names not.  Copies of a name are one row here; membership is the table itself.

    A name gives its grams: its pairs of letters, numbered where they recur, and if it is short also its letters.  Two names share at least as many grams as the bound
    leaves, so they share one among the rarest of each, as many as that bound allows to miss, plus one.  Only those are joined.
    """
    if not 0.5 <= least <= 1:
        raise ValueError("least is between 0.5 and 1")
    long = least_pairs(least)
    if long >= 400:
        long = 1 << 30  # pairs of letters promise nothing at so low a ratio: letters alone
    short = math.floor(long * (2 - least) / least) if long < 1 << 30 else 1 << 30
    d = names.select("kind", "name").where("name is not null and name <> ''").distinct().withColumn("n", F.char_length("name"))

    def numbered(grams: Column) -> Column:
        # a gram with its number among equal ones before it, so that a bag becomes a set
        return F.transform(grams, lambda g, i: F.concat(g, F.lit("\x00"), F.size(F.filter(F.slice(grams, F.lit(1), i), lambda h: h == g)).cast("string")))

    letters = numbered(F.filter(F.split("name", ""), lambda c: c != ""))
    pairs = numbered(F.expr("transform(sequence(1, n - 1), i -> substring(name, i, 2))"))
    by_pairs = d.where((F.col("n") >= long) & (F.col("n") >= 2)).select("kind", "name", "n", F.lit(2).alias("q"), F.explode(pairs).alias("gram"))
    by_letters = d.where(F.col("n") <= short).select("kind", "name", "n", F.lit(1).alias("q"), F.explode(letters).alias("gram"))
    grams = by_pairs.unionByName(by_letters)
    often = grams.groupBy("kind", "q", "gram").agg(F.count("*").alias("f"))
    ranked = grams.join(often, ["kind", "q", "gram"]).withColumn("r", F.row_number().over(Window.partitionBy("kind", "q", "name").orderBy("f", "gram")))
    # the fewest grams shared with any partner in reach: letters at least least * n / (2 - least); pairs by the partner whose bound is smallest
    smallest = F.ceil(F.lit(least) * F.col("n") / (2 - least) - 1e-9)
    largest = F.floor(F.col("n") * (2 - least) / least + 1e-9)
    with_pairs = F.array_min(F.transform(F.sequence(smallest.cast("int"), largest.cast("int")), lambda m: F.greatest(m, F.col("n")) - 1 - 2 * unmatched(m + F.col("n"), least)))
    shared = F.when(F.col("q") == 1, F.ceil(F.lit(least) * (F.col("n") + smallest) / 2 - 1e-9)).otherwise(with_pairs)
    size = F.when(F.col("q") == 1, F.col("n")).otherwise(F.col("n") - 1)
    prefix = ranked.where(F.col("r") <= size - F.greatest(shared, F.lit(1)) + 1).select("kind", "q", "gram", "name", "n")
    left = prefix.select("kind", "q", "gram", F.col("name").alias("a"), F.col("n").alias("m"))
    right = prefix.select("kind", "q", "gram", F.col("name").alias("b"), "n")
    reach = (F.least("m", "n") >= least * F.greatest("m", "n") / (2 - least) - 1e-9) & F.when(F.col("q") == 2, F.least("m", "n") >= long).otherwise(F.least("m", "n") < long)
    met = left.join(right, ["kind", "q", "gram"]).where((F.col("a") < F.col("b")) & reach).select("kind", "a", "b").distinct()
    bag = lambda x, y: F.size(F.array_intersect(numbered(F.filter(F.split(x, ""), lambda c: c != "")), numbered(F.filter(F.split(y, ""), lambda c: c != ""))))
    few = met.where(2 * bag("a", "b") >= least * (F.char_length("a") + F.char_length("b")) - 1e-9)
    return few.withColumn("ratio", ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)


# ---- mentions


def folded(name: Column) -> Column:
    """Case folded, decomposed and without marks, signs as spaces."""

    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        flat = names.str.casefold().str.normalize("NFKD").map(lambda s: s if s is None else "".join(c for c in s if not unicodedata.combining(c)))
        return flat.str.replace(r"[^\w\s]", " ", regex=True).str.split().str.join(" ")

    return fold(name)


def spelled(named: DataFrame, key: str, name: str, expansions: DataFrame | None = None) -> DataFrame:
    """(key, plain, long): words of the name as written and with abbreviations (short, long) written out; NOISE goes unless nothing else is left."""
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    quiet = lambda words: F.when(F.size(F.array_except(words, F.array(*map(F.lit, NOISE)))) > 0, F.filter(words, lambda w: ~w.isin(*NOISE))).otherwise(words)
    plain = named.select(key, split(folded(F.col(name))).alias("w"))
    if expansions is None:
        return plain.select(key, quiet(F.col("w")).alias("plain"), quiet(F.col("w")).alias("long"))
    each = plain.select(key, F.posexplode("w").alias("i", "short")).join(expansions.select("short", "long").dropDuplicates(["short"]), "short", "left")
    long = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("long", "short").alias("w")))).alias("ws"))
    long = long.select(key, split(F.array_join(F.transform("ws", lambda x: x["w"]), " ")).alias("l"))
    return plain.join(long, key, "left").select(key, quiet(F.col("w")).alias("plain"), quiet(F.coalesce("l", "w")).alias("long"))


def resolved(mentions: DataFrame, entities: DataFrame, expansions: DataFrame | None = None, near: DataFrame | None = None, limit: int | None = None, salts: int = 8) -> DataFrame:
    """(mention_id, entity_id, new_key, band, score, candidate_id, via): which entity each mention is, or that it is a new one.

    mentions: mention_id (unique), name, kind, jurisdiction, v (null without a vector).  entities: entity_id, name, kind, jurisdiction, redirects_to, v.
    ``expansions`` (short, long) are abbreviations, both folded; ``near`` (mention_id, entity_id) are the nearest entities by vector.

    A mention meets entities of its kind that don't redirect: those of the same name in any case, then, by id, those that share a word of more than two letters with the name as
    written or expanded, all of them unless a ``limit`` is given; then the nearest.  Different stated jurisdictions keep a pair apart.  The score is the weighted mean of the
    likeness of the expanded names and, where both have a vector, their cosine.  The best score counts; a tie goes to the first in that order.

    band: ``merge`` (entity_id is the entity), ``adjudicate`` (a new one; candidate_id is to be looked at), ``separate`` (a new one), ``refused`` (a blank name).
    All mentions are held against the entities as they were; new entities of one name in any case, kind and jurisdiction are one, whose ``new_key`` is the smallest mention id.
    Without ``near``, mentions that agree in name, kind, jurisdiction and vector are judged once, by the smallest of their ids.
    """
    if near is not None:
        return _resolved(mentions, entities, expansions, near, limit, salts)
    like = ["name", "kind", "jurisdiction", "v"]
    plain = mentions.withColumn("name", F.trim("name")).select("mention_id", *like)
    classes = plain.groupBy(*like).agg(F.min("mention_id").alias("mention_id"))
    judged = _resolved(classes, entities, expansions, None, limit, salts)
    each = classes.select(F.col("mention_id").alias("of"), *(F.col(c).alias(f"of_{c}") for c in like)).join(judged.withColumnRenamed("mention_id", "of"), "of")
    same = F.lit(True)
    for c in like:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return plain.join(each, same).select(*judged.columns)


def _resolved(mentions: DataFrame, entities: DataFrame, expansions: DataFrame | None, near: DataFrame | None, limit: int | None, salts: int) -> DataFrame:
    named = mentions.select("mention_id", "kind", "jurisdiction", F.col("v").alias("mv"), F.trim("name").alias("name"))
    real = named.where("name <> ''")
    live = entities.where("redirects_to is null and trim(name) <> ''").select("entity_id", "kind", F.col("jurisdiction").alias("ej"), F.col("v").alias("ev"), F.trim("name").alias("entity"))
    asked, known = real.join(spelled(real, "mention_id", "name", expansions), "mention_id"), live.join(spelled(live, "entity_id", "entity", expansions), "entity_id")
    salt = F.pmod(F.xxhash64("mention_id"), F.lit(salts)).cast("int").alias("salt")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def keys(name: str, words: Column) -> Column:
        """By what a name is met: itself in any case, its words of more than two letters."""
        return F.concat(F.array(F.concat(F.lit("="), F.lower(name))), F.transform(F.array_distinct(F.filter(words, lambda w: F.char_length(w) > 2)), lambda w: F.concat(F.lit(" "), w)))

    asked = asked.withColumn("m_keys", keys("name", F.concat("plain", "long"))).select("mention_id", "kind", "name", "jurisdiction", "mv", F.col("long").alias("m_long"), "m_keys")
    known = known.withColumn("e_keys", keys("entity", F.col("plain"))).select("entity_id", "kind", "entity", "ej", "ev", F.col("long").alias("e_long"), "e_keys")
    compared = ["mention_id", "jurisdiction", "mv", "m_long", "entity_id", "ej", "ev", "e_long", "place", "via"]
    told = lambda pairs: pairs.join(asked, "mention_id").join(known.withColumnRenamed("kind", "e_kind"), "entity_id").where("kind = e_kind").select(*compared)
    if limit is None:
        # entities that agree in all that is asked are met as the one of the smallest id, which a tie goes to
        once = known.join(live.groupBy("kind", "entity", "ej", "ev").agg(F.min("entity_id").alias("entity_id")).select("entity_id"), "entity_id", "left_semi")
        met = asked.select("*", F.explode("m_keys").alias("k"), salt).join(salted(once.withColumn("k", F.explode("e_keys"))), ["kind", "k", "salt"])
        # a pair counts at one of the keys that it shares, so that pairs need not be made distinct
        met = met.where(F.array_min(F.array_intersect("m_keys", "e_keys")) == F.col("k"))
        exact = F.lower("name") == F.lower("entity")
        both = met.withColumns({"place": F.when(exact, 0).otherwise(1), "via": F.when(exact, "name").otherwise("word")}).select(*compared)
        if near is not None:
            both = both.unionByName(told(near.select("mention_id", "entity_id", F.lit(2).alias("place"), F.lit("vector").alias("via"))))
    else:
        # what stands among the first ``limit`` of all that share something stands among the first of some key, so a key needs only its smallest ids
        heads = known.select("entity_id", "kind", F.explode("e_keys").alias("k"))
        first = heads.withColumn("r", F.row_number().over(Window.partitionBy("kind", "k").orderBy("entity_id"))).where(F.col("r") <= limit).groupBy("kind", "k").agg(F.collect_list("entity_id").alias("ids"))
        met = asked.select("mention_id", "kind", F.explode("m_keys").alias("k"), salt).join(salted(first), ["kind", "k", "salt"])
        by_name = met.select("mention_id", F.startswith("k", F.lit("=")).alias("exact"), F.explode("ids").alias("entity_id")).groupBy("mention_id", "entity_id").agg(F.max("exact").alias("exact"))
        place = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("exact"), "entity_id"))
        found = by_name.withColumn("place", place).where(F.col("place") <= limit).select("mention_id", "entity_id", "place", F.when(F.col("exact"), "name").otherwise("word").alias("via"))
        if near is not None:
            found = found.unionByName(near.select("mention_id", "entity_id", F.lit(limit + 1).alias("place"), F.lit("vector").alias("via")))
        both = told(found.groupBy("mention_id", "entity_id").agg(F.min("place").alias("place"), F.min_by("via", "place").alias("via")))
    unsaid = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    both = both.where(unsaid("jurisdiction") | unsaid("ej") | (F.lower("jurisdiction") == F.lower("ej")))
    cosine = F.when((F.size("mv") > 0) & (F.size("mv") == F.size("ev")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("mv", "ev", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))))
    alike = string_similarity(F.array_join("m_long", " "), F.array_join("e_long", " "))
    scored = both.withColumn("string", alike).withColumn("score", weighted([(F.col("string"), STRING), (cosine, EMBEDDING)]))
    # of equal scores the first in order; a task sums up its own pairs, so that not all of them meet
    first = F.max_by(F.struct("entity_id", "score", "via"), F.struct("score", -F.col("place"), -F.col("entity_id"))).alias("best")
    best = scored.groupBy("mention_id").agg(first).select("mention_id", F.col("best.entity_id").alias("candidate_id"), "best.score", "best.via")
    verdict = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "refused").when(F.col("score").isNull(), "separate").otherwise(band(F.col("score")))
    out = named.join(best, "mention_id", "left").withColumns({"band": verdict, "low": F.lower("name"), "place": F.lower(F.coalesce("jurisdiction", F.lit("")))})
    new = F.col("band").isin("adjudicate", "separate")
    one = out.where(new).groupBy("low", "kind", "place").agg(F.min("mention_id").alias("new_key"))
    out = out.join(one, ["low", "kind", "place"], "left")
    return out.select("mention_id", F.when(F.col("band") == "merge", F.col("candidate_id")).alias("entity_id"), F.when(new, F.col("new_key")).alias("new_key"), "band", "score", F.when(F.col("band") != "separate", F.col("candidate_id")).alias("candidate_id"), "via")


def taken_in(entities: DataFrame, mentions: DataFrame, found: DataFrame) -> DataFrame:
    """(entity_id, aliases, chunks): the entities after the mentions that merged: names of mentions that differ join the aliases, their passages the passages.

    entities: entity_id, name, aliases, chunks; mentions: mention_id, name, chunks.
    """
    m = found.where("band = 'merge'").select("mention_id", "entity_id").join(mentions.select("mention_id", F.trim("name").alias("name"), F.col("chunks").alias("more")), "mention_id")
    names = m.select("entity_id", "name", F.lower("name").alias("low"), "mention_id")
    # one spelling in any case: that of the smallest mention
    spelling = names.groupBy("entity_id", "low").agg(F.min_by("name", "mention_id").alias("name"), F.min("mention_id").alias("at"))
    known = entities.select("entity_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("entity_id", F.lower("n").alias("low")).distinct()
    added = spelling.join(known, ["entity_id", "low"], "left_anti").groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("added"))
    cited = m.select("entity_id", F.explode("more").alias("c")).unionByName(entities.select("entity_id", F.explode("chunks").alias("c"))).groupBy("entity_id").agg(F.sort_array(F.collect_set("c")).alias("chunks"))
    none = F.array().cast("array<string>")
    out = entities.select("entity_id", "aliases").join(added, "entity_id", "left").join(cited, "entity_id", "left")
    return out.select("entity_id", F.concat(F.coalesce("aliases", none), F.coalesce("added", none)).alias("aliases"), F.coalesce("chunks", F.array().cast("array<long>")).alias("chunks"))
