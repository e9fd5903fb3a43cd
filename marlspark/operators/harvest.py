"""Names that texts define by themselves: acronyms with their expansions, counted over documents and told apart."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words that an acronym may skip; fewest and most letters of one; words of the clause read beyond its letters; most characters of a name (fixed values).
SKIPPED, FEWEST, MOST, BEYOND, LONGEST = "a an and at by de der for in of on or the to und".split(), 2, 8, 2, 90
#: What stands in brackets, what ends a clause, what a token is (fixed values).
BRACKET, CLAUSE, TOKEN = r"\(([^()]{1,20})\)", r"[.!?;:•]|\n[ \t]*\n|\s[-–—]\s", r"[^\W_]+(?:['’][^\W_]+)*|[^\w\s]"
#: Signs that end a name (fixed values).
ENDS = [";", ":", '"', "“", "”", "(", ")", "[", "]"]
#: Documents that must define an expansion before it counts without a person's word (fixed value).
APPROVED = 3

DEFINITION = "array<struct<acronym:string,expansion:string>>"


def definitions(text: str | None) -> list[tuple[str, str]]:
    """(acronym, expansion) of each ``Full Name (FN)`` in a text, each once, in order.

    The words before the bracket, back to the clause's start, are held against the acronym's letters from the right: a word per letter, small words
    between may be skipped.  Only the clause before each bracket is read, from its end; as many tokens as the letters may need are looked at, however far apart they stand.
    """
    text, found = text or "", {}
    begins, at = 0, 0
    stops = [m.end() for m in re.finditer(CLAUSE, text)]
    for m in re.finditer(BRACKET, text):
        while at < len(stops) and stops[at] <= m.start():
            begins, at = stops[at], at + 1
        short = m.group(1).strip()
        letters = [c.lower() for c in short if c.isalpha()]
        if " " in short or not short[:1].isupper() or not FEWEST <= len(letters) <= MOST or sum(c.isupper() for c in short) < 2:
            continue
        reach = 2 * (len(letters) + BEYOND)
        near, words = _tail(text, begins, m.start(), reach)
        wanted = list(letters)
        first = None
        for w in reversed(words):
            token = w.group()
            if token[:1].lower() == wanted[-1]:
                wanted.pop()
                first = w
                if not wanted:
                    break
            elif first is None or not (token.lower() in SKIPPED or not token.isalnum() or len(token) == 1) or token in ENDS:
                break
        if wanted or first is None:
            continue
        name = re.sub(r"['’]s$", "", re.sub(r"\s+", " ", near[first.start() :]).strip())
        if " " in name and len(name) <= LONGEST:
            found.setdefault((short, name.lower()), (short, name))
    return list(found.values())


def _tail(text: str, begins: int, ends: int, reach: int) -> tuple[str, list[re.Match]]:
    """The end of a clause that holds its last ``reach`` tokens, and these: read in stretches that double, so a long clause is read as far as needed."""
    size = 256
    while True:
        start = max(begins, ends - size)
        while start > begins and not text[start - 1].isspace():
            start -= 1  # a stretch begins with a token
        words = list(re.finditer(TOKEN, text[start:ends]))
        if len(words) >= reach or start == begins:
            return text[start:ends], words[-reach:]
        size *= 2


def harvested(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, acronym, expansion) of every text; a null one has none.  No shuffle; equal texts of a batch are read once."""
    kind = pa.list_(pa.struct([("acronym", pa.string()), ("expansion", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1).dictionary_encode()
            found = pa.array([[{"acronym": a, "expansion": e} for a, e in definitions(t)] for t in text.dictionary.to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), found.take(text.indices)], ["id", "found"])

    plain = texts.where(F.col(text_col).contains("(")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(read, f"id {dict(plain.dtypes)['id']}, found {DEFINITION}").select(F.col("id").alias(id_col), F.inline("found"))


def counted(found: DataFrame, id_col: str) -> DataFrame:
    """(acronym, expansion, documents): by how many documents each expansion is defined."""
    return found.groupBy("acronym", "expansion").agg(F.count_distinct(id_col).alias("documents"))


def verdicts(found: DataFrame, rejected: DataFrame, id_col: str, approved: int = APPROVED) -> DataFrame:
    """(acronym, expansion, documents, status, ambiguous): expansions by the documents that define them.

    ``rejected`` (acronym, expansion) stays rejected; an acronym with two live expansions is ambiguous in every row.
    """
    return judged(counted(found, id_col), rejected, approved)


def judged(counts: DataFrame, rejected: DataFrame, approved: int = APPROVED) -> DataFrame:
    """The verdicts on what ``counted`` gives."""
    s = counts.join(rejected.select("acronym", "expansion", F.lit(True).alias("gone")).distinct(), ["acronym", "expansion"], "left")
    status = F.when(F.col("gone"), "rejected").when(F.col("documents") >= approved, "approved").otherwise("proposed")
    live = F.count_if(F.col("gone").isNull()).over(Window.partitionBy("acronym"))
    return s.select("acronym", "expansion", "documents", status.alias("status"), (live > 1).alias("ambiguous"))
