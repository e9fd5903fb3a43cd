"""Secret scans with DataFrame functions only: strong patterns, and weak candidates linked by an interval join.

Strong kinds are reported wherever they stand: ``assign`` (a value given to a password, secret, token or key), ``access`` (an access identifier) and ``hex`` (a
long run of hex digits).  Weak candidates are ``weak_id`` (what may be an account or key identifier) and ``weak_secret`` (a run of 32 to 64 letters,
digits and signs with upper case, lower case and digits).  A credential has several parts, so a weak candidate is reported only when a part that
completes it begins within its scope, that is, at most ``scope`` characters before its start or after its end: an identifier or an endpoint for
a weak secret, a secret for a weak identifier.  Scopes are joined to parts by bins of ``scope`` characters, in each of which only the first
and the last part count, so no pairs are formed.  A weak candidate that overlaps a strong span is left out.

Matches are leftmost and do not overlap within a kind; places are counted in code points, the end is exclusive.

Defined results: a null text counts as empty; a null doc_id is kept; rows that repeat doc_id and text get equal results; an empty table gives an
empty table; very long texts are scanned whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

#: Kinds in the order in which spans with one start are listed.
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
STRONG, WEAK = KINDS[:3], KINDS[3:5]
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "weak_id": r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[A-Z])(?=[A-Z0-9]*[0-9])[A-Z0-9]{16,40}(?![A-Za-z0-9])",
    "weak_secret": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{32,64}={0,2}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%-]*)?",
}
#: What completes a weak candidate.
COMPLETES = {"weak_id": ["assign", "hex", "weak_secret"], "weak_secret": ["access", "weak_id", "endpoint"]}
SPAN = "array<struct<start:int,rank:int,end:int>>"


#: Matches that are placed one after another; their blocks are placed by the blocks' lengths, so no array grows match by match.
BLOCK = 64


def matches(text: Column, kind: str) -> Column:
    """The spans of a kind as array<struct<start, rank, end>>: the places follow from the lengths of matches and of what stands between."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else found
    size = lambda a: F.transform(a, lambda x: F.length(x))
    steps = F.arrays_zip(size(F.split(text, PATTERNS[kind], -1)).alias("gap"), size(found).alias("match"), size(value).alias("value"))
    rank = KINDS.index(kind)
    ints = "array<int>"

    def placed(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(steps) - 1, F.lit(BLOCK)), lambda i: F.slice(steps, i + 1, F.lit(BLOCK)))
        return F.aggregate(F.array(blocks), F.array().cast(f"array<array<struct<start:int,rank:int,end:int>>>"), lambda _, b: F.zip_with(b, offsets(b), spans), F.flatten)

    def offsets(blocks: Column) -> Column:
        """What stands before each block."""
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["gap"] + F.coalesce(x["match"], F.lit(0))))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(ints).alias("out"))
        return F.aggregate(lengths, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def spans(block: Column, offset: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.coalesce(x["match"], F.lit(0))
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
            long = F.coalesce(x["value"] >= (6 if kind == "assign" else 0), F.lit(False))
            return F.struct(end.alias("at"), F.when(long, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        begin = F.struct(offset.alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(block, begin, step, lambda acc: acc["out"])

    return F.when(text.rlike(PATTERNS[kind]), F.aggregate(F.array(steps), F.array().cast(SPAN), lambda _, s: placed(s))).otherwise(F.array().cast(SPAN))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, th, strong, weak, endpoint): the spans of texts that have any, once for each doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    # one pass decides which texts are looked at more closely
    any_of = "|".join(f"(?:{p})" for p in PATTERNS.values())
    found = docs.select("doc_id", text.alias("text")).where(F.col("text").rlike(any_of)).select("doc_id", F.xxhash64("text").alias("th"), *(matches(F.col("text"), k).alias(k) for k in KINDS))
    found = found.select("doc_id", "th", F.array_sort(F.concat(*STRONG)).alias("strong"), F.concat(*WEAK).alias("weak"), F.col("endpoint"))
    return found.groupBy("doc_id", "th").agg(*(F.first(c).alias(c) for c in ("strong", "weak", "endpoint")))


def clear(found: DataFrame) -> DataFrame:
    """(doc_id, th, start, rank, end): all spans of texts with weak candidates, without the weak ones that overlap a strong one.

    Spans of a strong kind are apart from each other, so the furthest end of those that begin before a candidate's end tells: one sorted sweep a text.
    """
    each = found.where(F.size("weak") > 0).select("doc_id", "th", F.inline(F.concat("strong", "weak", "endpoint")))
    weak = F.col("rank").isin(*map(KINDS.index, WEAK))
    strong = F.col("rank") < len(STRONG)
    sweep = Window.partitionBy("doc_id", "th").orderBy(F.when(weak, 2 * F.col("end") - 1).otherwise(2 * F.col("start"))).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.coalesce(F.max(F.when(strong, F.col("end"))).over(sweep), F.lit(0))
    return each.withColumn("reach", reach).where(~weak | (F.col("reach") <= F.col("start"))).drop("reach")


def linked(found: DataFrame, scope: int) -> DataFrame:
    """(doc_id, th, linked): the weak candidates that a part within their scope completes."""
    key = ["doc_id", "th"]
    bin_of = lambda place: F.floor(place / scope).cast("int")
    each = clear(found)
    posts = each.groupBy(*key, "rank", bin_of(F.col("start")).alias("bin")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    needs = [(KINDS.index(w), KINDS.index(c)) for w, by in COMPLETES.items() for c in by]
    weak = each.where(F.col("rank").isin(*{w for w, _ in needs})).select(*key, "start", "rank", "end")
    asks = weak.withColumn("need", F.explode(F.array_compact(F.array(*(F.when(F.col("rank") == w, F.lit(c)) for w, c in needs)))))
    asks = asks.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start") - scope), bin_of(F.col("end") + scope))))
    a, p = asks.alias("a"), posts.alias("p")
    near = (F.col("p.last") >= F.col("a.start") - scope) & (F.col("p.first") <= F.col("a.end") + scope)
    same = F.col("a.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("a.th") == F.col("p.th")) & (F.col("a.need") == F.col("p.rank")) & (F.col("a.bin") == F.col("p.bin"))
    kept = a.join(p, same & near, "left_semi").select(*key, "start", "rank", "end").distinct()
    return kept.groupBy(*key).agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 240) -> DataFrame:
    """One row per doc_id and text with any span: doc_id, th (the text's hash), base and spans (arrays of start, rank in KINDS, end)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(parts(docs), "secret-parts")
    more = linked(found, scope)
    f, m = found.alias("f"), more.alias("m")
    both = f.join(m, F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.th") == F.col("m.th")), "left")
    spans = F.array_sort(F.concat("f.strong", F.coalesce("m.linked", F.array().cast(SPAN))))
    return both.select("f.doc_id", "f.th", F.col("f.strong").alias("base"), spans.alias("spans")).where(F.size("spans") > 0)


def cuts(found: DataFrame) -> DataFrame:
    """(doc_id, th, cuts): per text the stretches that its spans cover, as array<struct<start, after>>, where ``after`` is the end of what is covered before."""
    key = ["doc_id", "th"]
    before = Window.partitionBy(*key).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    each = found.select(*key, F.inline("spans")).withColumn("after", F.coalesce(F.max("end").over(before), F.lit(0)))
    stop = F.max("end").alias("stop")
    apart = F.filter(F.collect_list(F.struct("start", "after")), lambda c: c["start"] >= c["after"])
    return each.groupBy(*key).agg(F.array_sort(apart).alias("cuts"), stop)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def joined(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the columns of ``found`` beside doc_id and th, under names that begin with an underscore; null where nothing is found.

    What is found is little and is written first, so that texts are not shuffled where the planner finds it small enough to send to every task.
    """
    found = stored(found, "secret-spans").toDF(*(f"_{c}" for c in found.columns))
    th = F.xxhash64(F.coalesce(text_col, F.lit("")))
    return docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("_doc_id")) & (th == F.col("_th")), "left").drop("_doc_id", "_th")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 240) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = joined(slim, scan(slim, "doc_id", "text", scope), "doc_id", "text")
    none = F.array().cast(SPAN)
    out = out.select("doc_id", F.coalesce("_base", none).alias("_base"), F.coalesce("_spans", none).alias("_spans"))
    count = lambda k: F.size(F.filter("_base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, STRONG), F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 240, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans become one mark."""
    names = docs.columns
    id_, text_ = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    out = joined(numbered(docs), cuts(scan(docs, id_col, text_col, scope)), id_, text_)
    sign = "".join(f"{ord(c):08X}" for c in mark)

    def without(wide: Column) -> Column:
        stretch = lambda start, end: F.hex(F.substring(wide, 4 * start + 1, 4 * (end - start)))
        kept = F.array_join(F.transform("_cuts", lambda c: F.concat(stretch(c["after"], c["start"]), F.lit(sign))), "")
        return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), kept, stretch(F.col("_stop"), F.char_length(text_)))), "UTF-32")

    # four bytes a character, so that a stretch is taken without a walk from the text's start; made once a text, as a lambda's variable;
    # the mark of the byte order is taken off by the decoder
    text = F.element_at(F.transform(F.array(F.encode(text_, "UTF-32")), without), 1)
    return out.withColumn(text_, F.when(F.col("_cuts").isNotNull(), text).otherwise(F.col(text_))).drop("_cuts", "_stop").toDF(*names)
