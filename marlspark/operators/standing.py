"""What domains, attributes and papers are worth: trust by fetches, audits of attributes, priorities, alerts, fair samples, guarded SQL, mixed routes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Clean fetches that clear a domain (fixed value).
CLEAN_FETCHES = 5
#: Least discrimination of an attribute, weight of its use in comparisons (fixed values).
DISCRIMINATION, COMPARED = 0.5, 2.0
#: Success below which, and attempts from which, an alert goes out; hours for which its kind is then silent (fixed values).
SUCCESS, ATTEMPTS, SILENT = 0.5, 20, 6
#: Priorities of a paper: on a host or page that is off topic, on a page not judged yet (fixed values).
OFF_TOPIC, UNJUDGED = 3, 20
#: Rows of a free question, unless asked for more, and at most (fixed values).
ROWS, MOST_ROWS = 200, 1000
#: Functions that run code of their caller's choice or read files (fixed values), and the expressions that hold a query.
RUNS_CODE = {"java_method", "reflect", "try_reflect", "read_files", "python_worker_logs"}
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}


def trust(fetches: DataFrame, rejected: DataFrame, clean: int = CLEAN_FETCHES) -> DataFrame:
    """(domain, state, clean_fetches): a domain's standing after all its fetches, in order of ``at``.

    It is cleared by ``clean`` clean fetches, or by one with a mapped tier, if no flagged fetch comes before; by a flagged one it is quarantined; once
    cleared it stays so; what a person rejected stays rejected, its fetches uncounted.  Two aggregations, so a domain with very many fetches is summed up in
    parts.  fetches: domain, at (unique in a domain), flagged, mapped; rejected: domain.
    """
    ends = fetches.groupBy("domain").agg(F.min(F.when(F.col("flagged"), F.col("at"))).alias("first"), F.max(F.when(F.col("flagged"), F.col("at"))).alias("last"))
    before = F.col("first").isNull() | (F.col("at") < F.col("first"))
    after = F.col("last").isNull() | (F.col("at") > F.col("last"))
    n = fetches.join(ends, "domain").groupBy("domain").agg(
        F.count_if(before).alias("opening"), F.bool_or(before & F.col("mapped")).alias("mapped"), F.count_if(after).alias("clean_fetches"), F.bool_or("flagged").alias("flagged"))
    s = n.join(rejected.select("domain", F.lit(True).alias("gone")).distinct(), "domain", "left")
    state = F.when(F.col("gone"), "rejected").when(F.col("mapped") | (F.col("opening") >= clean), "cleared").when(F.col("flagged"), "quarantined").otherwise("unscreened")
    return s.select("domain", state.alias("state"), F.when(F.col("gone"), F.lit(0)).otherwise(F.col("clean_fetches")).alias("clean_fetches"))


def attribute_signals(values: DataFrame, sources: DataFrame, since: str) -> DataFrame:
    """(attribute, entities, sources, used, coverage): what an attribute is measured on; copies of a source are one voice.

    values: attribute, topic (null: everywhere), entity, source_id, tagged_at; sources: source_id, duplicate_of.  Coverage is of the entities that carry
    any attribute of the topic or of none.
    """
    voice = sources.select("source_id", F.coalesce("duplicate_of", "source_id").alias("voice"))
    own = values.join(voice, "source_id", "left").groupBy("attribute", "topic").agg(
        F.count_distinct("entity").alias("entities"), F.count_distinct("voice").alias("sources"), F.count_if(F.col("tagged_at") >= F.lit(since)).alias("used"))
    everywhere = values.where("topic is null").select("entity").distinct()
    local = values.where("topic is not null").select("topic", "entity").distinct()
    add = local.join(everywhere, "entity", "left_anti").groupBy("topic").agg(F.count("*").alias("more"))
    base = everywhere.agg(F.count("*").alias("base"))
    s = own.join(add, "topic", "left").join(F.broadcast(base))
    return s.select("attribute", "topic", "entities", "sources", "used", F.round(F.col("entities") / (F.col("base") + F.coalesce("more", F.lit(0))), 4).alias("coverage"))


def utility(discrimination: Column, entities: Column, coverage: Column, compared: Column) -> Column:
    """One number by which attributes are ranked."""
    return F.round(F.coalesce(discrimination, F.lit(0.0)) * F.log1p(entities) + coverage + COMPARED * F.log1p(compared), 4)


def audit(in_grace: Column, compared: Column, discrimination: Column, used: Column, any_tagged: Column) -> Column:
    """Why an attribute passes (``+``) or fails (``-``) an audit."""
    return (
        F.when(in_grace, "+ new").when(compared > 0, "+ compared").when(discrimination < DISCRIMINATION, "- does not split")
        .when((used == 0) & any_tagged, "- unused").when(used == 0, "+ nothing was tagged").otherwise("+ used")
    )


def paper_priorities(citations: DataFrame, on_topic: int) -> DataFrame:
    """(paper, priority): the highest that any citing page gives.  citations: paper, labels (null: not judged), off_topic_host."""
    p = F.when(F.col("off_topic_host"), OFF_TOPIC).when(F.col("labels").isNull(), UNJUDGED).when(F.size("labels") == 0, OFF_TOPIC).otherwise(max(on_topic, UNJUDGED + 1))
    return citations.groupBy("paper").agg(F.max(p).alias("priority"))


def success_alerts(attempts: DataFrame, sent: DataFrame, hours: int, success: str = "ok") -> DataFrame:
    """(at, attempts, rate): checks, one every ``hours``, that find too little success and no alert of the kind sent in the hours before.

    attempts: at, outcome; sent: at.
    """
    # checks are far fewer than attempts: one row a span of time, so the look-back is a join of small tables on the spans that it can reach
    span = hours * 3600
    end = (F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / span) + 1) * span
    low = attempts.groupBy(end.alias("at")).agg(F.count("*").alias("attempts"), F.round(F.count_if(F.col("outcome") == success) / F.count("*"), 4).alias("rate"))
    low = low.where((F.col("attempts") >= ATTEMPTS) & (F.col("rate") < SUCCESS))
    said = sent.select(F.unix_seconds(F.col("at").cast("timestamp")).alias("said"))
    hour = F.floor(F.col("said") / 3600)
    silent = said.select(F.explode(F.sequence(hour, hour + SILENT)).alias("hour"), "said")
    quiet = low.withColumn("hour", F.floor(F.col("at") / 3600)).join(silent, "hour").where((F.col("said") < F.col("at")) & (F.col("said") >= F.col("at") - SILENT * 3600))
    return low.join(quiet.select("at").distinct(), "at", "left_anti")


def day_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """(day, kind, n): a digest of tables that each have a time ``at``, one count a day and kind."""
    union = None
    for kind, t in parts.items():
        part = t.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n")).select("day", F.lit(kind).alias("kind"), "n")
        union = part if union is None else union.unionByName(part)
    return union


def draw(key: Column, seed: int) -> Column:
    """A number below 2**32 that looks random and is the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def share_sample(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """About ``share`` of the rows, in one pass, with no shuffle."""
    return rows.where(draw(F.col(key), seed) < int(share * 2**32))


def fair_examples(rows: DataFrame, by: str, key: str, most: int, seed: int) -> DataFrame:
    """A fair draw of at most ``most`` rows of each group; only the candidates of each partition are shuffled."""
    w = Window.partitionBy(by).orderBy(draw(F.col(key), seed), key)
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).drop("_i")


class Refused(ValueError):
    """A question that was not run; its message is for the one who asked."""


def _names(node, found: dict[str, set]) -> dict[str, set]:
    """What a parsed question uses: kinds of its nodes, tables, names it gives itself, functions."""
    seq = lambda x: [x.apply(i) for i in range(x.size())]
    kind = node.getClass().getSimpleName().rstrip("$")
    found["nodes"].add(kind)
    if kind == "UnresolvedRelation":
        found["tables"].add(tuple(seq(node.multipartIdentifier())))
    elif kind == "UnresolvedFunction":
        found["functions"].add(seq(node.nameParts())[-1].lower())
    elif kind == "UnresolvedTableValuedFunction":
        found["functions"].add(seq(node.name())[-1].lower())
    elif kind == "UnresolvedWith":
        for cte in seq(node.cteRelations()):
            found["own"].add(cte.productElement(0).lower())
            _names(cte.productElement(1), found)
    if kind in SUBQUERIES:
        _names(node.plan(), found)
    for child in seq(node.children()):
        _names(child, found)
    c = node.getClass()
    while c is not None and c.getSimpleName() != "LogicalPlan":
        c = c.getSuperclass()
    for e in seq(node.expressions()) if c is not None else ():
        _names(e, found)
    return found


def guarded_sql(spark: SparkSession, question: str, most: int = ROWS, tables: Iterable[str] = ()) -> tuple[DataFrame, bool]:
    """The rows of one SELECT over the views ``tables``, at most ``most``, and whether there are more.  The question is run once.

    The question is parsed, not searched for words: only plain queries are let through, over the named views and what the question itself defines.  Paths, names
    made of strings and functions that run code are refused.
    """
    body = question.strip().rstrip(";").strip()
    if not body:
        raise Refused("Ask something.")
    if not re.match(r"(?i)(select|with)\b", body):
        raise Refused("Only SELECT and WITH are allowed.")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except Exception as e:
        raise Refused("The question can't be parsed; ask one thing at a time.") from e
    found = _names(plan, {"nodes": set(), "tables": set(), "own": set(), "functions": set()})
    if bad := [n for n in found["nodes"] if "UnresolvedIdentifier" in n or re.search(r"^(Insert|Create|Drop|Delete|Update|Merge|Alter|Set|Cache|Load|Truncate|Refresh|Describe|Show|Explain|Script)|Statement$|Command$|Transformation$", n)]:
        raise Refused(f"{bad[0]} is not allowed; questions only read.")
    known = {t.lower() for t in tables} | found["own"]
    if bad := [".".join(t) for t in found["tables"] if len(t) > 1 or t[0].lower() not in known]:
        raise Refused(f"{bad[0]} is not one of the tables.")
    if bad := found["functions"] & RUNS_CODE:
        raise Refused(f"{min(bad)} is not allowed.")
    most = max(1, min(most, MOST_ROWS))
    rows = spark.sql(body).limit(most + 1)
    got = rows.collect()  # at most MOST_ROWS and one
    return spark.createDataFrame(got[:most], rows.schema), len(got) > most


def mixed_route(cited: DataFrame, similar: DataFrame, start: str, goal: str, depth: int, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(step, src, dst, kind, score) of the best route: fewest hops, then fewest similar ones, then the better last step, then the smaller node.

    cited, similar: a, b, score, walked both ways.  Each level joins the frontier alone; a node carries its route (at most ``depth`` hops).
    """
    steps = None
    for kind, links in (("cited", cited), ("similar", similar)):
        both = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score").unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"), "score"))
        both = both.select("src", "dst", F.lit(kind).alias("kind"), F.col("score").cast("double").alias("score"))
        steps = both if steps is None else steps.unionByName(both)
    hop = "struct<src:string,dst:string,kind:string,score:double>"
    spark = cited.sparkSession
    front = spark.createDataFrame([(start, 0, [])], f"src string, similar int, way array<{hop}>")
    seen = front.select(F.col("src").alias("dst"))
    way = front.limit(0).select("way")
    for _ in range(depth if start != goal else 0):
        reach = front.join(steps, "src").join(seen, "dst", "left_anti")
        cost = F.struct((F.col("similar") + (F.col("kind") == "similar").cast("int")).alias("similar"), (-F.col("score")).alias("worse"), F.col("src").alias("from"), F.col("kind").alias("kind"))
        best = reach.groupBy("dst").agg(F.min(F.struct(cost.alias("cost"), F.concat("way", F.array(F.struct("src", "dst", "kind", "score"))).alias("way"))).alias("b"))
        front = checkpoint(best.select(F.col("dst").alias("src"), F.col("b.cost.similar").alias("similar"), "b.way"))
        if front.isEmpty():
            break
        seen = checkpoint(seen.unionByName(front.select(F.col("src").alias("dst"))))
        there = front.where(F.col("src") == goal).select("way")
        if not there.isEmpty():
            way = there
            break
    return way.select(F.posexplode("way").alias("step", "h")).select("step", "h.*")
