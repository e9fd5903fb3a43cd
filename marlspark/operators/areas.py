"""Areas of a corpus map: topics of headlines, names, fields of work, places kept from build to build, paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..functions.vector import dot, unit

#: A headline's floor against a prototype, with and without a centroid, and the lead that its centroid must have (fixed values).
FLOOR, FLOOR_ALONE, LEAD = 0.30, 0.34, 0.01
#: A label's floor, the level at which it fits however close its rivals, and its lead over the third (fixed values).
LABEL_FLOOR, LABEL_SURE, LABEL_LEAD = 0.25, 0.33, 0.03
#: Similarity at which an area is taken for one of the build before; terms looked at for a name and for telling areas apart (fixed values).
SAME_AREA, NAME_TERMS, OWN_TERMS = 0.9, 3, 8


#: Most rows of a list that goes to every task (topics, labels).
MOST_LISTED = 5000


def _listed(t: DataFrame) -> DataFrame:
    """A list that goes to every task, if its size allows."""
    if (n := t.limit(MOST_LISTED + 1).count()) > MOST_LISTED:
        raise ValueError(f"a list of topics or labels may have {MOST_LISTED} rows, this has {n} or more")
    return F.broadcast(t)


def headline_topics(headlines: DataFrame, topics: DataFrame, floor: float = FLOOR, alone: float = FLOOR_ALONE, lead: float = LEAD) -> DataFrame:
    """(id, topic, score, place): the topics that a headline is about, best prototype first.

    headlines: id, v; topics (a few rows): topic, prototype, centroid (null: judged by the prototype alone), away (the centroid of off-topic passages, or null).
    """
    t = topics.select("topic", unit(F.col("prototype")).alias("p"), unit(F.col("centroid")).alias("c"), unit(F.col("away")).alias("o"))
    s = headlines.select("id", unit(F.col("v")).alias("u")).join(_listed(t), how="cross")
    s = s.select("id", "topic", F.round(dot(F.col("u"), F.col("p")), 6).alias("score"), F.round(dot(F.col("u"), F.col("c")) - dot(F.col("u"), F.col("o")), 6).alias("gain"))
    passed = s.where(F.when(F.col("gain").isNull(), F.col("score") >= alone).otherwise((F.col("score") >= floor) & (F.col("gain") >= lead)))
    return passed.select("id", "topic", "score", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "topic")).cast("long").alias("place"))


def fitting_labels(centroids: DataFrame, labels: DataFrame, floor: float = LABEL_FLOOR, sure: float = LABEL_SURE, lead: float = LABEL_LEAD) -> DataFrame:
    """(area, label, similarity): an area's nearest label after each side's mean is taken off, where it fits.

    It fits when it is sure, or above the floor and clear of the third nearest.  centroids: area, v; labels: label, v, a fixed list of some hundreds.
    """

    def centred(t: DataFrame, key: str) -> DataFrame:
        mean = t.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("m"))
        return t.join(F.broadcast(mean)).select(key, unit(F.zip_with("v", "m", lambda x, m: x - m)).alias("u"))

    near = centred(centroids, "area").join(_listed(centred(labels, "label").withColumnRenamed("u", "w")), how="cross")
    near = near.select("area", "label", F.round(dot(F.col("u"), F.col("w")), 6).alias("s"))
    best = near.groupBy("area").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "label"))), 1, 3).alias("top"))
    first, third = -F.col("top")[0]["s"], -F.element_at("top", -1)["s"]
    fits = (first >= max(floor, sure)) | ((first >= floor) & (first - third >= lead))
    return best.where(fits).select("area", F.col("top")[0]["label"].alias("label"), first.alias("similarity"))


def capital(name: Column) -> Column:
    return F.concat(F.upper(F.left(name, F.lit(1))), F.right(name, F.char_length(name) - 1))


def area_names(areas: DataFrame) -> DataFrame:
    """(shown, area, name): the field, or else the first phrase among the first terms, or else the first term; null without any.

    Areas shown together (``shown``, some dozens at most) whose names from terms are alike carry, in order of id, a term of their own: the first that the
    name does not hold and that none before has taken.  areas: shown, area, field, terms.
    """
    head = F.slice("terms", 1, NAME_TERMS)
    phrase = F.coalesce(F.get(F.filter(head, lambda t: t.contains(" ")), F.lit(0)), F.get("terms", F.lit(0)))
    named = areas.select("shown", F.col("field").isNull().alias("by_terms"), F.coalesce("field", capital(phrase)).alias("name"), "area", F.slice("terms", 1, OWN_TERMS).alias("own"))
    alike = named.groupBy("shown", "by_terms", "name").agg(F.array_sort(F.collect_list(F.struct("area", "own"))).alias("rows"))

    def take(taken: Column, row: Column) -> Column:
        free = F.filter(row["own"], lambda t: ~F.contains(F.lower("name"), F.lower(t)) & ~F.array_contains(F.coalesce(taken, F.array().cast("array<string>")), t))
        return F.concat(taken, F.array(F.coalesce(F.get(free, F.lit(0)), F.lit(""))))

    own = F.when(F.col("by_terms") & (F.size("rows") > 1), F.aggregate("rows", F.array().cast("array<string>"), take)).otherwise(F.transform("rows", lambda r: F.lit("")))
    each = alike.select("shown", "name", F.inline(F.arrays_zip(F.col("rows")["area"].alias("area"), own.alias("own"))))
    return each.select("shown", "area", F.when(F.col("own") == "", F.col("name")).otherwise(F.concat("name", F.lit(" ("), "own", F.lit(")"))).alias("name"))


def matched(pairs: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], least: float = SAME_AREA) -> DataFrame:
    """(new, old, similarity): best pairs first, each area once.  pairs: new, old, similarity.

    Going down the sorted list takes just the pairs that are the best of both their ends once the ends already taken are out; so each round takes all of
    these at once, without an order over the whole.
    """
    left = checkpoint(pairs.where(F.col("similarity") >= least).select("new", "old", "similarity"))
    found = left.limit(0)
    order = [F.desc("similarity"), "new", "old"]
    while not left.isEmpty():
        ranked = left.select("*", F.row_number().over(Window.partitionBy("new").orderBy(*order)).alias("i"), F.row_number().over(Window.partitionBy("old").orderBy(*order)).alias("j"))
        took = checkpoint(ranked.where("i = 1 and j = 1").drop("i", "j"))
        found = found.unionByName(took)
        left = checkpoint(left.join(took.select("new"), "new", "left_anti").join(took.select("old"), "old", "left_anti"))
    return found


def paths(areas: DataFrame) -> DataFrame:
    """(area, path): the areas from the top down to each, of a tree of any depth.  areas: area, parent.

    Every round doubles the stretch of each path that is known, so a tree of n levels takes about log2(n) rounds.  An area whose parents never end at a top has no path.
    """
    done = areas.where("parent is null").select("area", F.array("area").alias("path"))
    open_ = areas.where("parent is not null").select("area", F.array("area").alias("tail"), F.col("parent").alias("up"))
    shared_folder(areas.sparkSession)
    left = -1
    while True:
        open_ = open_.checkpoint()
        now = open_.count()
        if not now or now == left:
            return done
        left = now
        # what hangs below a finished path is finished; the others go on by the stretch of the one above
        below = open_.join(done.select(F.col("area").alias("up"), "path"), "up").select("area", F.concat("path", "tail").alias("path"))
        rest = open_.join(below.select("area"), "area", "left_anti")
        above = rest.select(F.col("area").alias("up"), F.col("tail").alias("more"), F.col("up").alias("next"))
        done = done.unionByName(below).checkpoint()
        longer = rest.join(above, "up", "left").select("area", F.when(F.col("next").isNull(), F.col("tail")).otherwise(F.concat("more", "tail")).alias("tail"), F.coalesce("next", "up").alias("up"))
        open_ = longer.where(~F.array_contains("tail", F.col("up")))  # a circle has no top
