"""Greedy one-to-one pairs by nearness on a line, without making all pairs."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from decimal import Decimal
from heapq import heapify, heappop, heappush
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .areas import SAME_AREA, matched

#: Rows that a tile is cut at; rows of one cell stay together.
TILE_ROWS = 50_000


def similarity(a: Column, b: Column, span: float, digits: int) -> Column:
    return F.round(1 - F.abs(a - b) / span, digits)


def levels(digits: int, least: float) -> list[float]:
    """For k = 0, 1, ...: minus the smallest likeness that rounds to 1 - k / 10^digits (halves go up), while that is at least ``least``; ascending."""
    far, step = [], Decimal(1).scaleb(-digits)
    while (value := 1 - len(far) * step) > 0 and float(value) >= least:
        far.append(-float(value - step / 2))
    return far


class _Smallest:
    """The smallest value in a stretch of places, as places are set."""

    def __init__(self, values: list[int], none: int):
        self.n, self.none = len(values), none
        self.tree = [none] * self.n + values
        for i in range(self.n - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def put(self, i: int, value: int) -> None:
        i += self.n
        self.tree[i] = value
        while i > 1:
            i >>= 1
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def of(self, a: int, b: int) -> int:
        least, a, b = self.none, a + self.n, b + self.n
        while a < b:
            if a & 1:
                least, a = min(least, self.tree[a]), a + 1
            if b & 1:
                b -= 1
                least = min(least, self.tree[b])
            a, b = a >> 1, b >> 1
        return least


def _skip(to: list[int], i: int) -> int:
    while to[i] != i:
        to[i] = i = to[to[i]]
    return i


def walk(tile: pd.DataFrame, far: list[float], span: float) -> pd.DataFrame:
    """(new, old, x, y): the pairs of a tile that hold whatever lies outside, and the new ones that stay open (``old`` null).

    Goes down the pairs by level, new, old; a level's olds of a new one are a stretch of the line.  An old one that a new one of another tile may take first is
    unsure.  A new one is open if an unsure one, or one outside, may come before its first sure one; it takes nothing after that, so just that one gets unsure.
    """
    olds, news = tile[~tile["is_new"]].sort_values("at"), tile[tile["is_new"]]
    at, old_ids, n, end = olds["at"].tolist(), olds["id"].tolist(), len(olds), len(far)
    by_id = sorted(range(n), key=old_ids.__getitem__)
    rank = [0] * n
    for r, i in enumerate(by_id):
        rank[i] = r
    sure, unsure = _Smallest(rank, n), _Smallest([n] * n, n)
    up, down = list(range(n + 1)), list(range(n + 1))  # the next place not taken, upwards, and downwards from the place before
    edge = {c: tile[c].iloc[0] for c in ("new_below", "new_above", "old_below", "old_above")}
    level = lambda a, b: bisect_left(far, abs(a - b) / span - 1)
    outside = lambda a, kind: min([level(a, e) for e in (edge[f"{kind}_below"], edge[f"{kind}_above"]) if abs(e) < inf], default=end)

    def ahead(x: float, a: int, b: int) -> int:
        a, b = _skip(down, a) - 1, _skip(up, b)
        return min(level(x, at[a]) if a >= 0 else end, level(x, at[b]) if b < n else end)

    out, heap = [], []
    for new, x in zip(news["id"].tolist(), news["at"].tolist()):
        p, beyond = bisect_left(at, x), outside(x, "old")
        if (k := min(ahead(x, p, p), beyond)) < end:
            heap.append((k, new, x, p, beyond, False))
    heapify(heap)
    while heap:
        k, new, x, p, beyond, is_open = heappop(heap)
        a = bisect_left(at, True, 0, p, key=lambda y: (x - y) / span - 1 <= far[k])
        b = bisect_left(at, True, p, n, key=lambda y: (y - x) / span - 1 > far[k])
        while (r := sure.of(a, b)) < n and outside(at[by_id[r]], "new") <= k:
            sure.put(by_id[r], n)
            unsure.put(by_id[r], r)
        is_open = is_open or beyond <= k or unsure.of(a, b) < r
        if r < n:
            i = by_id[r]
            sure.put(i, n)
            if is_open:
                unsure.put(i, r)
                out.append((new, None, x, None))
            else:
                up[i], down[i + 1] = i + 1, i
                out.append((new, old_ids[i], x, at[i]))
        elif (k := min(ahead(x, a, b), beyond if beyond > k else end)) < end:
            heappush(heap, (k, new, x, p, beyond, is_open))
        elif is_open:
            out.append((new, None, x, None))
    return pd.DataFrame({"new": pd.Series([o[0] for o in out], dtype="int64"), "old": pd.Series([o[1] for o in out], dtype="Int64"), "x": pd.Series([o[2] for o in out], dtype="float64"), "y": pd.Series([o[3] for o in out], dtype="float64")})


def tiled(live: DataFrame, width: float, rows: int, shift: int) -> DataFrame:
    """The rows with the tile of their part that they lie in, cut about every ``rows`` rows along the line, and how near new and old ones of other tiles come.

    live: part, at, id, is_new.  Rows of one cell of ``width`` are not parted.
    """
    ends = [f(F.when(F.col("is_new") == new, F.col("at"))).alias(f"{kind}_{name}") for kind, new in (("new", True), ("old", False)) for name, f in (("low", F.min), ("high", F.max))]
    cells = live.groupBy("part", F.floor(F.col("at") / width).alias("cell")).agg(F.count("*").alias("n"), *ends)
    before = F.sum("n").over(Window.partitionBy("part").orderBy("cell")) - F.col("n")
    cells = cells.withColumn("tile", F.floor((before + shift) / rows))
    whole = cells.groupBy("part", "tile").agg(*(f(c).alias(c) for c, f in (("new_low", F.min), ("new_high", F.max), ("old_low", F.min), ("old_high", F.max))))
    w = Window.partitionBy("part").orderBy("tile")
    below, above = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    near = [F.coalesce(F.max(f"{k}_high").over(below), F.lit(-inf)).alias(f"{k}_below") for k in ("new", "old")] + [F.coalesce(F.min(f"{k}_low").over(above), F.lit(inf)).alias(f"{k}_above") for k in ("new", "old")]
    places = cells.select("part", "cell", "tile").join(whole.select("part", "tile", *near), ["part", "tile"])
    return live.withColumn("cell", F.floor(F.col("at") / width)).join(places, ["part", "cell"]).drop("cell")


def nearest_matched(new: DataFrame, old: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], span: float, digits: int = 4, least: float = SAME_AREA, rows: int = TILE_ROWS) -> DataFrame:
    """(new, old, similarity): what ``matched`` gives for all pairs of a part, likened by 1 - distance / span rounded to ``digits`` places; the pairs are never made.

    Each part's line is cut into tiles of bounded rows, and a task goes down its tile's pairs; what hangs on other tiles stays open for the next round, whose
    cuts lie elsewhere.  Tiles double when a round leaves more than half of the open ones.

    new: new, part, at; old: old, part, at, of whole numbers as ids.  Null places take no part.  A likeness that is not a number counts as above all, so the few
    places that are not finite are paired first, by ``matched``.
    """
    nodes = new.select("part", F.col("at").cast("double").alias("at"), F.col("new").cast("long").alias("id"), F.lit(True).alias("is_new"))
    nodes = nodes.unionByName(old.select("part", F.col("at").cast("double").alias("at"), F.col("old").cast("long").alias("id"), F.lit(False).alias("is_new")))
    live = checkpoint(nodes.where("part is not null and at is not null and id is not null").distinct())
    near = similarity(F.col("x"), F.col("y"), span, digits)

    def pairs(news: DataFrame, olds: DataFrame) -> DataFrame:
        a, b = news.where("is_new").select("part", F.col("id").alias("new"), F.col("at").alias("x")), olds.where("not is_new").select("part", F.col("id").alias("old"), F.col("at").alias("y"))
        return a.join(b, "part").select("new", "old", near.alias("similarity"))

    if not live.groupBy("is_new", "id").count().where("count > 1").isEmpty():  # an id in several places ties tiles and parts together
        return matched(pairs(live, live), checkpoint, least)
    plain, first = F.abs("at") < inf, None
    odd = live.where(~plain)
    if not odd.isEmpty():
        first = matched(pairs(odd, live).unionByName(pairs(live.where(plain), odd)).where(F.isnan("similarity")), checkpoint, least)
        gone = first.select(F.col("new").alias("id"), F.lit(True).alias("is_new")).unionByName(first.select(F.col("old").alias("id"), F.lit(False).alias("is_new")))
        live = checkpoint(live.where(plain).join(gone, ["id", "is_new"], "left_anti"))
    far, width, spread = levels(digits, least), span / 10**digits, int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, left, shift = None, None, 0
    while True:
        tiles = tiled(live, width, rows, shift).repartition(spread, "part", "tile")  # by number: few bytes, but work for all cores
        judged = checkpoint(tiles.groupBy("part", "tile").applyInPandas(lambda t: walk(t, far, span), "new long, old long, x double, y double"))
        took = judged.where("old is not null")
        found = took if found is None else found.unionByName(took)
        open_ = judged.where("old is null").select(F.col("new").alias("id"))
        now = open_.count()
        if not now:
            found = found.select("new", "old", near.alias("similarity"))
            return found if first is None else found.unionByName(first)
        if left is not None and now * 2 > left:
            rows *= 2
        left, shift = now, 0 if shift else rows // 2
        still = live.where("is_new").join(open_, "id", "left_semi")
        free = live.where("not is_new").join(took.select(F.col("old").alias("id")), "id", "left_anti").join(still.select("part").distinct(), "part", "left_semi")
        live = checkpoint(still.unionByName(free.select(*still.columns)))
