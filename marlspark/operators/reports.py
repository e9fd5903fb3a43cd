"""Reports on the corpus, its queues and its models: each from DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares, counts and ages of the reports (fixed values).
FIELD_SHARE, FIELD_PASSAGES, THIN_SOURCES, STALE_DAYS, FAR_SHARE, HEAD_BACK = 0.5, 30, 3, 180, 0.25, 40


def share(part: Column, whole: Column, places: int = 4) -> Column:
    """Null before anything has been judged."""
    return F.when(whole > 0, F.round(part / whole, places))


def novelty_health(judged: DataFrame) -> DataFrame:
    """judged: duplicate_of and examined (booleans or null)."""
    seen, twin = F.count_if(F.col("examined")), F.count_if(F.col("examined") & F.col("duplicate"))
    return judged.agg(seen.alias("judged"), twin.alias("duplicates"), F.count_if(~F.coalesce("examined", F.lit(False))).alias("pending"), share(seen - twin, seen).alias("pass_rate"))


def field_gaps(passages: DataFrame, now: str) -> DataFrame:
    """(field, passages, gap) of fields that are mostly on topic: thin with few sources, weak without a strong one, else stale.

    passages: field, source_id, on_topic, strong, published.
    """
    g = passages.groupBy("field").agg(
        F.count("*").alias("passages"), F.count_distinct("source_id").alias("sources"), (F.count_if("on_topic") / F.count("*")).alias("share"),
        F.bool_or("strong").alias("strong"), F.max("published").alias("newest"))
    age = F.datediff(F.lit(now).cast("date"), F.col("newest"))
    gap = F.when(F.col("sources") < THIN_SOURCES, "thin").when(~F.col("strong"), "weak").when(F.coalesce(age > STALE_DAYS, F.lit(True)), "stale")
    return g.where((F.col("share") >= FIELD_SHARE) & (F.col("passages") >= FIELD_PASSAGES)).withColumn("gap", gap).where("gap is not null").select("field", "passages", "gap")


def off_topic_queries(results: DataFrame, least: int = 5, most: float = 0.5) -> DataFrame:
    """(query, examined, on_topic) of queries few of whose examined results are on their topic.  results: query, topic, topics."""
    hit = F.coalesce(F.array_contains("topics", F.col("topic")), F.lit(False))
    g = results.groupBy("query").agg(F.count("*").alias("examined"), F.count_if(hit).alias("on_topic"))
    return g.where((F.col("examined") >= least) & (F.col("on_topic") < most * F.col("examined")))


def question_gaps(items: DataFrame, below: int = 2) -> DataFrame:
    """(item, grade) of items graded low; what a person says outranks what is proposed.  items: item, grade, proposed."""
    return items.select("item", F.coalesce("grade", "proposed").alias("grade")).where(F.col("grade") < below)


def area_history(areas: DataFrame) -> DataFrame:
    """(level, areas, weak, stale).  areas: level, sources, age."""
    return areas.groupBy("level").agg(F.count("*").alias("areas"), F.count_if(F.col("sources") < THIN_SOURCES).alias("weak"), F.count_if(F.col("age") > STALE_DAYS).alias("stale"))


def far_nodes(nodes: DataFrame, top: float = FAR_SHARE) -> DataFrame:
    """(node) without edges, or among the far ones: at or beyond the distance that ``top`` of all measured nodes reach, ties included.  nodes: node, degree, distance.

    The cut is an order statistic: counts by distance are few, and a running sum over them finds it, so no node is ranked in one task.
    """
    by = nodes.where("distance is not null").groupBy("distance").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    upto = by.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("distance")))).join(F.broadcast(total))  # a row a distinct distance
    cut = upto.where(F.col("upto") >= F.ceil(F.col("total") * top)).agg(F.max("distance").alias("cut"))
    return nodes.join(F.broadcast(cut)).where((F.col("degree") <= 0) | (F.col("distance") >= F.col("cut"))).select("node")


def dominant(rows: DataFrame, group: str, label: str, least: float = 0.0) -> DataFrame:
    """(group, label, n, total): the commonest label, ties to the smaller, where it has at least ``least`` of the rows."""
    n = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    g = n.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label), F.max("n").alias("n"), F.sum("n").alias("total"))
    return g.where(F.col("n") >= least * F.col("total"))


def over_limit(calls: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """(call_id, recent, allowed): a call is allowed while fewer than ``limit`` of its token came in the time before.  calls: call_id, token, ts, refused."""
    at = F.col("ts").cast("timestamp").cast("long")
    w = Window.partitionBy("token").orderBy("_at").rangeBetween(-seconds, -1)
    recent = F.coalesce(F.count_if(~F.col("refused")).over(w), F.lit(0))
    return calls.withColumn("_at", at).select("call_id", recent.alias("recent"), (recent < limit).alias("allowed"))


def reprioritised(links: DataFrame, parents: DataFrame, raise_by: int = 20, drop_by: int = 20) -> DataFrame:
    """(task_id, priority) of pending links whose parent says more about them.  links: task_id, parent, priority, status; parents: parent, on_topic."""
    moved = F.when(F.col("on_topic"), F.col("priority") + raise_by).otherwise(F.greatest(F.col("priority") - drop_by, F.lit(0)))
    return links.where("status = 'pending'").join(parents, "parent").select("task_id", moved.alias("priority"))


def may_ask(asks: DataFrame, now: str, days: int = 1) -> DataFrame:
    """(query, last): queries asked before that may be asked again: news that is older than ``days``.  asks: query, news, ts."""
    last = asks.groupBy("query").agg(F.max("ts").alias("last"), F.bool_or("news").alias("news"))
    return last.where(F.col("news") & (F.col("last") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))).select("query", "last")


def open_pairs(pairs: DataFrame, live: DataFrame, limit: int) -> DataFrame:
    """(pair_id) of undecided pairs with both sides alive, newest first.  pairs: pair_id, a, b, decided, created_at; live: id."""
    both = pairs.where(~F.col("decided")).join(live.select(F.col("id").alias("a")), "a", "left_semi").join(live.select(F.col("id").alias("b")), "b", "left_semi")
    return both.orderBy(F.desc("created_at"), "pair_id").limit(limit).select("pair_id", "created_at")


def touched_nodes(edges: DataFrame, hits: DataFrame, limit: int = 12) -> DataFrame:
    """(node, edges, contested) of edges that cite a hit.  edges: src, dst, cited (array), contested; hits: chunk_id."""
    cites = edges.withColumn("chunk_id", F.explode("cited")).join(hits, "chunk_id", "left_semi").drop("chunk_id").distinct()
    ends = cites.select(F.explode(F.array("src", "dst")).alias("node"), "contested")
    return ends.groupBy("node").agg(F.count("*").alias("edges"), F.bool_or("contested").alias("contested")).orderBy(F.desc("edges"), "node").limit(limit)


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(parent, counts): the maps of children summed by key into their parent.  nodes: parent, counts (map of string to long)."""
    each = nodes.select("parent", F.explode("counts").alias("key", "n")).groupBy("parent", "key").agg(F.sum("n").alias("n"))
    return each.groupBy("parent").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("counts"))


def provenance(kinds: dict[str, DataFrame]) -> DataFrame:
    """(agent, and a count a kind): who made what.  Each table has the column agent."""
    parts = [df.groupBy("agent").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, df in kinds.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("agent").pivot("kind", list(kinds)).agg(F.sum("n")).na.fill(0)


def numbered_newest(rows: DataFrame, ts: str, key: str, limit: int) -> DataFrame:
    """The newest ``limit`` rows with their number; only they reach the one task that numbers them."""
    top = rows.orderBy(F.desc(ts), key).limit(limit)
    return top.withColumn("nth", F.row_number().over(Window.orderBy(F.desc(ts), key)).cast("long"))


def table_heads(passages: DataFrame, back: int = HEAD_BACK) -> DataFrame:
    """(chunk_id, head): for each row passage the head that was last seen in its source, at most ``back`` passages before and in the same run of table passages.

    passages: chunk_id, source_id, chunk_index, is_table, head (or null).
    """
    by = Window.partitionBy("source_id").orderBy("chunk_index")
    run = F.sum((~F.col("is_table")).cast("int")).over(by)
    near = Window.partitionBy("source_id", "run").orderBy("chunk_index").rowsBetween(-back, -1)
    found = passages.withColumn("run", run).withColumn("found", F.last("head", ignorenulls=True).over(near))
    return found.where(F.col("is_table") & F.col("head").isNull() & F.col("found").isNotNull()).select("chunk_id", F.col("found").alias("head"))


def name_search(entities: DataFrame, words: str, limit: int) -> DataFrame:
    """(id, name, alias): exact before prefix before other hits, then by degree, name and id; the shortest alias that matched is shown.

    entities: id, name, degree, aliases.
    """
    low, q = F.lower("name"), words.lower()
    hits = F.array_sort(F.transform(F.filter("aliases", lambda a: F.lower(a).contains(q)), lambda a: F.struct(F.char_length(a).alias("n"), a.alias("alias"))))
    e = entities.withColumn("hits", hits).where(low.contains(q) | (F.size("hits") > 0))
    order = [F.desc(low == q), F.desc(low.startswith(q)), F.desc("degree"), F.col("name"), F.col("id")]
    return e.orderBy(*order).limit(limit).select("id", "name", F.try_element_at("hits", F.lit(1))["alias"].alias("alias"))


def fresh_plan(candidates: DataFrame, asked: DataFrame, seed: int, limit: int) -> DataFrame:
    """(kind, query): queries never asked before, one of each kind first, in an order that the seed shuffles.  candidates: kind, query; asked: query."""
    mix = F.md5(F.concat(F.lit(f"{seed}:"), F.col("query")))
    new = candidates.join(asked, "query", "left_anti").distinct().withColumn("mix", mix)
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("mix", "query"))
    return new.withColumn("nth", nth).where(F.col("nth") <= limit).orderBy("nth", "mix", "query", "kind").limit(limit).select("kind", "query")


def latest_proposals(proposals: DataFrame, now: str, days: int) -> DataFrame:
    """(topic, proposal_id, action): of each topic the latest proposal; it is applied when it has waited ``days`` and its basis still holds, else waits or lapses."""
    w = Window.partitionBy("topic").orderBy(F.desc("created_at"), F.desc("proposal_id"))
    top = proposals.withColumn("r", F.row_number().over(w)).where("r = 1")
    due = F.col("created_at") <= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return top.select("topic", "proposal_id", F.when(~F.col("holds"), "lapse").when(due, "apply").otherwise("wait").alias("action"))


def backed_off(attempts: DataFrame, base: int = 60, most: int = 86_400, tries: int = 5) -> DataFrame:
    """(task_id, disposition, wait): what follows from a task's last outcome and number of failures; waits are the bounds of full jitter.

    attempts: task_id, outcome ('ok', 'error' or 'gone'), failures.
    """
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), F.col("failures") - 1), F.lit(float(most))).cast("long")
    what = F.when(F.col("outcome") == "ok", "done").when((F.col("outcome") == "gone") | (F.col("failures") >= tries), "abandon").otherwise("retry")
    return attempts.select("task_id", what.alias("disposition"), F.when(what == "retry", wait).alias("wait"))


def paused(depths: DataFrame, key: str, ts: str, depth: str, ceiling: float, resume: float = 0.8) -> DataFrame:
    """(key, ts, paused): paused from above the ceiling until below ``resume`` of it; in between the last crossing decides.

    The state is that of the last row outside the band, so a window does what a fold would.
    """
    crossing = F.when(F.col(depth) > ceiling, True).when(F.col(depth) < resume * ceiling, False)
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return depths.select(key, ts, F.coalesce(F.last(crossing, ignorenulls=True).over(w), F.lit(False)).alias("paused"))


def needs_rendering(attempts: DataFrame, key: str, ts: str, escalated: str, times: int = 3, days: int = 7) -> DataFrame:
    """(key): hosts that took ``times`` escalations within ``days`` before their last attempt; what is older is forgotten."""
    last = attempts.groupBy(key).agg(F.max(ts).alias("_last"))
    near = attempts.join(last, key).where(F.col(escalated) & (F.col(ts) > F.col("_last") - F.make_dt_interval(F.lit(days))))
    return near.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= times).select(key, "n")


def new_since(sources: DataFrame, since: str, until: str, days: str = "created_at", most_days: int = 366) -> DataFrame:
    """(day, n) of what was added in a window, which is cut to its last ``most_days`` days."""
    a, b = F.lit(since).cast("date"), F.lit(until).cast("date")
    day = F.to_date(days)
    return sources.where((day >= F.greatest(a, F.date_sub(b, most_days - 1))) & (day <= b)).groupBy(day.alias("day")).agg(F.count("*").alias("n"))


def by_country(items: DataFrame, cities: DataFrame) -> DataFrame:
    """(country, sources, best): cities count for their country, sources without any place are ``unplaced``.  items: source_id, score, place; cities: city, country."""
    # a city that is listed twice for a country would multiply the items
    placed = items.join(cities.select("city", "country").distinct(), F.col("place") == F.col("city"), "left").withColumn("country", F.coalesce("country", "place", F.lit("unplaced")))
    g = placed.groupBy("country").agg(F.count_distinct("source_id").alias("sources"), F.max("score").alias("best"))
    return g


def leading_topics(sources: DataFrame, top: int = 3) -> DataFrame:
    """(topic, sources): each topic once a source; ties by name.  sources: source_id, topics."""
    each = sources.select("source_id", F.explode("topics").alias("topic")).distinct()
    return each.groupBy("topic").agg(F.count("*").alias("sources")).orderBy(F.desc("sources"), "topic").limit(top)
