"""Furniture of pages taken out line by line: navigation, menus, lines that a site repeats, debris; and a guard that keeps a page whole that would lose too much.

A text's lines are rows: what a reader sees of a line is column expressions, menus are windows over a text's lines, repeated lines are counted over all pages of a host, and what is left
is put together again.  Nothing is collected but the lines of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .claims import MENU_LINES, MENU_LINKED, MENU_WORDS
from .dedupe import boilerplate

#: Share of what is seen of a text beyond which it is kept whole, most words of a line that moves a reader around and of an anchor (fixed values).
GUARD, MOVING_WORDS, ANCHOR_WORDS = 0.8, 8, 3
#: Characters and words of a line that may be a site's (fixed values).
LEAST_CHARS, MOST_CHARS, LEAST_WORDS = 12, 200, 2
#: List and heading marks that begin a line; images, links with text and target, and what may stand between links (fixed values).
MARKS = r"^\s*(?:(?:[-*+•·]|\d{1,3}[.)])\s+|#{1,6}\s+|>\s*)*"
LABEL = r"\[((?:[^\]\\]++|\\.)*+)\]"
IMAGE, LINK = rf'!{LABEL}\(\s*[^)\s]*(?:\s+"[^"]*")?\s*\)', rf'{LABEL}\(\s*([^)\s]*)(?:\s+"[^"]*")?\s*\)'
FILLER = r"^[\s|·•,/*_\-–—()\[\]]*$"
#: What names a work, in the text and as a target (fixed values).
IDENTIFIER, DOI = r"(?i)\b10\.\d{4,9}/\S+|\barxiv:\s*\d{4}\.\d{4,5}|https?://|\bwww\.\w", r"\b10\.\d{4,9}/"
#: Lines that move a reader around, links that open elsewhere, and ends of sentences and labels (fixed values).
MOVES = (
    r"(?i)^(?:(?:skip|jump)\b.{0,60}\b(?:content|navigation|nav|main|menu|breadcrumbs?|footer|search)|(?:back|return|go)\s+to\s+(?:the\s+)?top"
    r"|(?:toggle|open|close|expand)\s+(?:the\s+)?(?:navigation|menu|search))\W*$|^\{?\s*top\s*\}?$"
)
ELSEWHERE, TERMINAL = r"(?i)opens\s+in\s+(?:a\s+)?new\s+(?:tab|window)", r"[.!?;:]\s*$"
#: Fewer visible characters than this beside invisible ones are debris (fixed value).
DEBRIS = 3
REASONS = ["navigation", "empty-link", "anchor", "menu", "repeated", "debris"]


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def solid(c: Column) -> Column:
    """Characters that aren't white space."""
    return F.char_length(F.regexp_replace(c, r"(?U)\s", ""))


def lines(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, i, raw, and what a reader sees of the line): one row per line; a null text has none."""
    each = texts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("i", "raw"))
    body = F.trim(F.regexp_replace("raw", MARKS, ""))
    each = each.withColumn("body", body).withColumn("plain", F.regexp_replace("body", IMAGE, "$1"))
    seen = F.regexp_replace(F.regexp_replace("plain", LINK, "$1"), r"\\([\[\]()*_`\\])", "$1")
    each = each.withColumns({
        "visible": _squeezed(F.regexp_replace(seen, "[*_`]+", " ")),
        "targets": F.regexp_extract_all("plain", F.lit(LINK), F.lit(2)),
        "rest": F.regexp_replace(F.regexp_replace("body", IMAGE, ""), LINK, ""),
        "images": F.col("body").rlike(IMAGE),
    })
    return each.select(
        id_col, "i", "raw", "visible", "targets", (F.trim(F.regexp_replace("raw", r"(?U)\s", "")) == "").alias("blank"), F.startswith("body", F.lit("|")).alias("row"),
        F.when(F.col("visible") == "", 0).otherwise(F.size(F.split("visible", " "))).alias("words"), F.col("visible").rlike(r"\p{L}").alias("letters"),
        (((F.size("targets") > 0) | F.col("images")) & F.col("rest").rlike(FILLER)).alias("linked"),
        (F.col("visible").rlike(IDENTIFIER) | F.exists("targets", lambda t: t.rlike(DOI))).alias("names"),
    )


def navigation() -> Column:
    """Why a line only moves a reader around, or null."""
    moves = (F.col("words") <= MOVING_WORDS) & F.col("visible").rlike(MOVES)
    elsewhere = F.col("linked") & F.col("visible").rlike(ELSEWHERE)
    empty = F.col("linked") & (F.regexp_replace("visible", r"[ |·•,/\-–—()\[\]]", "") == "")
    anchor = F.col("linked") & (F.col("words") <= ANCHOR_WORDS) & (F.size("targets") > 0) & F.forall("targets", lambda t: t.contains("#"))
    why = F.when(moves | elsewhere, "navigation").when(empty, "empty-link").when(anchor, "anchor")
    return F.when(~F.col("blank") & ~F.col("row") & ~F.col("names"), why)


def in_menus(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``menu``: whether a line is in a run of short lines most of which are links, from its first link to its last.

    Blank lines don't end a run, lines without letters ride along, anything else ends it.
    """
    heading = F.startswith(F.ltrim("raw"), F.lit("#"))
    item = ~F.col("row") & (F.col("linked") | ~heading) & F.col("letters") & (F.col("words") <= MENU_WORDS) & ~F.col("visible").rlike(TERMINAL) & ~F.col("names")
    rides = ~F.col("letters") & ~F.col("row")
    kind = F.when(F.col("blank"), "blank").when(item, "item").when(rides, "rides").otherwise("ends")
    in_order = Window.partitionBy(id_col).orderBy("i")
    run = Window.partitionBy(id_col, "run")
    r = rows.withColumn("kind", kind).withColumn("run", F.count_if(F.col("kind") == "ends").over(in_order))
    items = lambda c: F.count_if((F.col("kind") == "item") & c).over(run)
    r = r.withColumns({"items": items(F.lit(True)), "links": items(F.col("linked")), "begins": F.min(F.when(F.col("kind") == "item", F.col("i"))).over(run)})
    link = F.when(F.col("linked") & F.col("kind").isin("item", "rides") & (F.col("i") >= F.col("begins")), F.col("i"))
    r = r.withColumns({"first": F.min(link).over(run), "last": F.max(link).over(run)})
    menu = (F.col("items") >= MENU_LINES) & (F.col("links") >= MENU_LINKED * F.col("items")) & F.col("i").between(F.col("first"), F.col("last")) & F.col("kind").isin("item", "rides")
    return r.withColumn("menu", F.coalesce(menu, F.lit(False))).drop("kind", "run", "items", "links", "begins", "first", "last")


def site_line() -> Column:
    """The form in which a line is compared over the pages of a site: lower case; null where it is too short or long for one."""
    low = F.lower("visible")
    return F.when(F.char_length(low).between(LEAST_CHARS, MOST_CHARS) & (F.col("words") >= LEAST_WORDS) & ~F.col("blank"), low)


def debris() -> Column:
    """An invisible character and hardly anything else."""
    odd = r"[\p{Cf}\p{Co}\p{Cn}[\p{Cc}&&[^\t\r]]]"
    return F.col("raw").rlike(odd) & (F.char_length(F.regexp_replace("raw", r"(?U)[\s\p{Cf}\p{Cc}\p{Co}\p{Cn}]", "")) < DEBRIS)


def judged(texts: DataFrame, id_col: str, text_col: str = "text", host_col: str | None = "host") -> DataFrame:
    """(id, i, raw, seen, reason): every line with the number of characters that are seen of it and why it goes, or null; the first rule that takes it is named."""
    rows = in_menus(lines(texts, id_col, text_col), id_col).withColumn("site_line", site_line())
    if host_col is None:
        rows = rows.withColumn("often", F.lit(False))
    else:
        rows = rows.join(texts.select(id_col, F.col(host_col).alias("host")), id_col)
        often = boilerplate(rows.where("site_line is not null and host is not null").select("host", F.col(id_col).alias("page_id"), F.col("site_line").alias("line")))
        rows = rows.join(often.select("host", F.col("line").alias("site_line"), F.lit(True).alias("often")), ["host", "site_line"], "left")
    why = F.coalesce(navigation(), F.when(F.col("menu"), "menu"), F.when(F.col("often"), "repeated"), F.when(debris(), "debris"))
    return rows.select(id_col, "i", "raw", solid(F.col("visible")).alias("seen"), why.alias("reason"))


def cleaned(texts: DataFrame, id_col: str, text_col: str = "text", host_col: str | None = "host") -> DataFrame:
    """(id, text, lines_removed, removed_chars, total_chars, kept_original, reasons): each text without its furniture, or as it was where more than GUARD of what is seen would go.

    ids are one a row; a null text gives none.  ``reasons`` counts the lines that went by rule.
    """
    j = judged(texts, id_col, text_col, host_col)
    row = F.struct("i", "raw", "reason")
    g = j.groupBy(id_col).agg(
        F.array_sort(F.collect_list(row)).alias("ls"), F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("seen"))), F.lit(0)).alias("removed_chars"), F.sum("seen").alias("total_chars")
    )
    kept = (F.col("total_chars") > 0) & (F.col("removed_chars") / F.col("total_chars") > GUARD)
    left = F.filter("ls", lambda x: F.col("kept_original") | x["reason"].isNull())
    gone = F.filter("ls", lambda x: ~F.col("kept_original") & x["reason"].isNotNull())
    taken = lambda r: F.struct(F.lit(r).alias("reason"), F.size(F.filter("gone", lambda x: x["reason"] == r)).alias("n"))
    reasons = F.filter(F.array(*map(taken, REASONS)), lambda x: x["n"] > 0)
    g = g.withColumn("kept_original", kept).withColumn("gone", gone)
    return g.select(id_col, F.array_join(F.transform(left, lambda x: x["raw"]), "\n").alias("text"), F.size("gone").alias("lines_removed"), "removed_chars", "total_chars", "kept_original", F.map_from_entries(reasons).alias("reasons"))
