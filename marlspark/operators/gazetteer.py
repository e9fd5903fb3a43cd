"""A gazetteer of names: which surface forms load, where texts hold them, and whose they are.

Terms are a table (term_id, canonical, aliases, entity_type, approved, ambiguous, rejected).  A form is matched with its case where it is short and upper-case, otherwise
without.  Forms that two terms share, and the aliases of a term flagged as ambiguous, don't load; ``by_context`` gives such forms back to
the one term that the same document names otherwise.

``find`` gives the leftmost longest matches at word boundaries.  The vocabulary goes to each Python worker once, as one automaton, while all forms together have at most
``most_chars`` characters; a larger one isn't sent: words of the texts are then joined to the first words of the forms, and the same sweep picks the matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The longest form that is matched with its case where it is upper-case and has no space (fixed value).
SHORT = 8
#: Characters of all forms together that are sent as an automaton: some 40 bytes each in every worker.
MOST_CHARS = 4_000_000
#: What may stand between two names that are said together, as "a city, its country" or "a city (its country" (fixed value).
BESIDE = r"\s*[,(]?\s*"


def is_cased(surface: Column) -> Column:
    return (F.char_length(surface) <= SHORT) & (F.upper(surface) == surface) & ~surface.contains(" ")


def surfaces(terms: DataFrame) -> DataFrame:
    """(term_id, entity_type, approved, ambiguous, position, surface, cased, key): the canonical form first, then aliases; blank and repeated ones go."""
    trimmed = F.transform(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda s: F.trim(F.coalesce(s, F.lit(""))))
    each = terms.withColumn("forms", F.array_distinct(trimmed)).select("term_id", "entity_type", "approved", "ambiguous", F.posexplode("forms").alias("position", "surface")).where("surface <> ''")
    cased = is_cased(F.col("surface"))
    # the canonical form may be blank: then the first alias is not taken for it
    return each.withColumn("cased", cased).withColumn("key", F.when(cased, F.concat(F.lit("="), "surface")).otherwise(F.concat(F.lit("~"), F.lower("surface"))))


def forms(terms: DataFrame) -> DataFrame:
    """(key, term_id, entity_type, surface, cased, reason, terms): every form of the approved terms.

    ``reason`` is null for a form that loads, ``ambiguous`` where a term flagged so has it as an alias, else ``collision`` where several
    terms share it; ``terms`` lists who has it.
    """
    own = surfaces(terms).where("approved").withColumn("flagged", F.col("ambiguous") & (F.col("position") > 0))
    by_key = Window.partitionBy("key")
    first = Window.partitionBy("key", "term_id").orderBy("position")
    who = F.sort_array(F.collect_set("term_id").over(by_key))
    reason = F.when(F.max("flagged").over(by_key), "ambiguous").when(F.size(who) > 1, "collision")
    listed = own.withColumns({"reason": reason, "terms": who, "r": F.row_number().over(first)}).where("r = 1")
    return listed.select("key", "term_id", "entity_type", "surface", "cased", "flagged", "reason", "terms")


def loaded(terms: DataFrame) -> DataFrame:
    """(surface, cased, term_id, label): the forms that are matched."""
    return forms(terms).where("reason is null").select("surface", "cased", "term_id", F.upper("entity_type").alias("label"))


def verdicts(terms: DataFrame) -> DataFrame:
    """(term_id, will_load, reason, collides_with): one row per term.

    The reason of an approved term is that of a form it lost, forms lost as ambiguous first; a flagged term's loss names the flagged terms, a
    collision all others.  A term without any usable form has ``no_patterns``.
    """
    f = forms(terms)
    flagged = Window.partitionBy("key")
    sharing = F.when(F.col("reason") == "ambiguous", F.sort_array(F.collect_set(F.when(F.col("flagged"), F.col("term_id"))).over(flagged))).otherwise(F.col("terms"))
    held = f.withColumn("sharing", sharing).where("reason is not null and (reason = 'collision' or flagged)")
    worst = F.min_by(F.struct("reason", F.array_except("sharing", F.array("term_id")).alias("others")), F.struct(F.col("reason"), F.col("key")))
    lost = held.groupBy("term_id").agg(worst.alias("lost"))
    kept = f.where("reason is null").select("term_id", F.lit(True).alias("kept")).distinct()
    each = terms.select("term_id", "approved", "rejected").join(kept, "term_id", "left").join(lost, "term_id", "left")
    will = F.col("approved") & F.col("kept").isNotNull()
    why = F.when(~F.col("approved"), F.when(F.col("rejected"), "rejected").otherwise("unapproved")).when(F.col("lost").isNotNull(), F.col("lost.reason")).when(~will, "no_patterns")
    others = F.when(F.col("approved") & F.col("lost").isNotNull(), F.col("lost.others")).otherwise(F.array().cast("array<long>"))
    return each.select("term_id", will.alias("will_load"), why.alias("reason"), others.alias("collides_with"))


# ---- matching


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def at_word_ends(text: str, start: int, end: int) -> bool:
    inside = lambda c: c == "_" or c.isalnum()
    return not (start and inside(text[start - 1])) and not (end < len(text) and inside(text[end]))


def swept(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, form) the leftmost longest that don't overlap; of two forms on one place the smaller number."""
    out, reached = [], 0
    for start, end, form in sorted(hits, key=lambda h: (h[0], -h[1], h[2])):
        if start >= reached:
            out.append((start, end, form))
            reached = end
    return out


class Matcher:
    """Automata over the forms: one for those matched with their case and one for the rest."""

    def __init__(self, names: list[tuple[str, bool]]):
        import ahocorasick

        self.automata = []
        for cased in (True, False):
            a = ahocorasick.Automaton()
            for i, (name, with_case) in enumerate(names):
                key = name if cased else lowered(name)
                if with_case == cased and key and key not in a:
                    a.add_word(key, (i, len(key)))
            if len(a):
                a.make_automaton()
                self.automata.append((cased, a))

    def find(self, text: str) -> list[tuple[int, int, int]]:
        hits = []
        for cased, a in self.automata:
            for last, (i, size) in a.iter(text if cased else lowered(text)):
                if at_word_ends(text, last + 1 - size, last + 1):
                    hits.append((last + 1 - size, last + 1, i))
        return swept(hits)


@lru_cache(maxsize=2)
def _matcher(sent) -> Matcher:
    return Matcher(sent.value)


_BESIDE = re.compile(BESIDE)
#: Matches that a task holds as Python objects before it hands them on.
FLUSHED = 20_000


def _found(ids: pa.Array, got: list[tuple]) -> pa.RecordBatch:
    at, *columns = zip(*got)
    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "start", "end", "beside", "surface", "cased"])


def find(texts: DataFrame, names: DataFrame, id_col: str, text_col: str = "text", most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, start, end, beside, surface, cased): leftmost longest matches of the forms ``names`` (surface, cased) in each text; ids are one a row.

    ``beside`` says that only BESIDE stands between a match and the one before it.  A null text has no match.  Without case two forms may be equal: ``surface`` is then the smaller.
    """
    spark = texts.sparkSession
    key = F.when(F.col("cased"), F.col("surface")).otherwise(F.lower("surface"))
    names = names.where("surface <> ''").groupBy(key.alias("form_key"), "cased").agg(F.min("surface").alias("surface"))
    size = names.agg(F.sum(F.char_length("surface")), F.max(F.char_length("surface"))).first()
    plain = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    if not size[0]:
        return plain.select(F.col("id").alias(id_col), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(True).alias("beside"), F.lit("").alias("surface"), F.lit(True).alias("cased")).limit(0)
    if size[0] <= most_chars:
        listed = [(r["surface"], r["cased"]) for r in names.orderBy("surface", "cased").select("surface", "cased").collect()]
        sent = spark.sparkContext.broadcast(listed)  # at most ``most_chars`` characters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, names = _matcher(sent), sent.value
            for b in batches:
                got = []
                for i in range(b.num_rows):
                    t, last = b.column(1)[i].as_py(), -1
                    for s, e, k in m.find(t):
                        got.append((i, s, e, last >= 0 and bool(_BESIDE.fullmatch(t, last, s)), *names[k]))
                        last = e
                        if len(got) == FLUSHED:
                            yield _found(b.column(0), got)
                            got = []
                if got:
                    yield _found(b.column(0), got)

        kind = dict(plain.dtypes)["id"]
        return plain.mapInArrow(run, f"id {kind}, start int, `end` int, beside boolean, surface string, cased boolean").withColumnRenamed("id", id_col)
    hits = _joined(plain, names, int(size[1])).withColumn("last", F.lag("end").over(Window.partitionBy("id").orderBy("start")))
    gap = F.expr("substring(text, last + 1, start - last)")
    beside = F.coalesce(gap.rlike(f"^(?:{BESIDE})$"), F.lit(False))
    return hits.join(plain, "id").select(F.col("id").alias(id_col), "start", "end", beside.alias("beside"), "surface", "cased")


_HEAD = re.compile(r"\w+|[^\w\s]")


def _heads(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                low, rows = lowered(t), []
                for m in _HEAD.finditer(t):
                    s = m.start()
                    rows.append((s, low[s : m.end()], t[s : s + longest + 1], low[s : s + longest + 1]))
                    if len(rows) == 20_000:
                        yield _batch(b.column(0), at, rows)
                        rows = []
                if rows:
                    yield _batch(b.column(0), at, rows)

    return run


def _batch(ids: pa.Array, at: int, rows: list) -> pa.RecordBatch:
    start, *rest = zip(*rows)
    return pa.RecordBatch.from_arrays([ids.take(pa.array([at] * len(rows))), pa.array(start, pa.int32()), *(pa.array(c, pa.string()) for c in rest)], ["id", "start", "head", "seen", "low"])


def _joined(plain: DataFrame, names: DataFrame, longest: int) -> DataFrame:
    """The same matches by a join of each word with the forms that begin with it."""
    kind = dict(plain.dtypes)["id"]
    heads = plain.mapInArrow(_heads(longest), f"id {kind}, start int, head string, seen string, low string")

    @F.pandas_udf("string")
    def head(surface: pd.Series) -> pd.Series:
        return surface.map(lambda s: m[0] if (m := _HEAD.match(lowered(s))) else "")

    size = F.char_length("surface")
    whole = F.when(F.col("cased"), F.startswith(F.col("seen"), F.col("surface"))).otherwise(F.startswith(F.col("low"), F.col("form_key")))
    after = F.expr("substring(seen, char_length(surface) + 1, 1)")
    met = heads.join(names.withColumn("head", head("surface")), "head").where(whole & ~after.rlike(r"^[\p{L}\p{N}_]"))
    hits = met.select("id", "start", (F.col("start") + size).alias("end"), "surface", "cased")

    def sweep(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "end", "surface", "cased"], ascending=[True, False, True, True]).reset_index(drop=True)
        kept = [i for _, _, i in swept(list(zip(rows["start"], rows["end"], rows.index)))]
        return rows.loc[kept]

    return hits.groupBy("id").applyInPandas(sweep, f"id {kind}, start int, `end` int, surface string, cased boolean")


def mentions(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str = "text", most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, start, end, term_id, label): where texts name the terms whose forms load."""
    own = loaded(terms)
    return find(texts, own, id_col, text_col, most_chars).join(own.withColumn("key", _key()).drop("surface", "cased"), _key() == F.col("key")).drop("key", "surface", "cased")


def _key() -> Column:
    return F.when(F.col("cased"), F.concat(F.lit("="), "surface")).otherwise(F.concat(F.lit("~"), F.lower("surface")))


def by_context(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str = "text", most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, start, end, term_id, reason): matches of all forms of approved terms, withheld ones included.

    A form that loads is its term's (reason null).  A withheld form is the term's that the same document names by a form that loads, where exactly one of those
    who share it is so named (``context``); otherwise term_id is null and the reason says why it was withheld.
    """
    all_forms = forms(terms).select("key", "term_id", "surface", "cased", "reason", "terms")
    whose = all_forms.groupBy("key").agg(F.min("term_id").alias("owner"), F.first("reason").alias("why"), F.first("terms").alias("terms"))
    found = find(texts, all_forms.select("surface", "cased").distinct(), id_col, text_col, most_chars).withColumn("key", _key())
    met = found.join(whose, "key").select(id_col, "start", "end", "why", "owner", "terms")
    # who the document names otherwise stands beside each match, so texts are matched once
    known = F.collect_set(F.when(F.col("why").isNull(), F.col("owner"))).over(Window.partitionBy(id_col))
    of = F.array_intersect("terms", known)
    judged = met.withColumn("of", F.when(F.col("why").isNotNull(), of))
    one = F.size("of") == 1
    return judged.select(
        id_col, "start", "end", F.when(F.col("why").isNull(), F.col("owner")).when(one, F.get("of", F.lit(0))).alias("term_id"), F.when(F.col("why").isNotNull(), F.when(one, "context").otherwise(F.col("why"))).alias("reason")
    )
