"""Judgements on lines, passages and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Priorities by tier and half-lives in days (fixed values).
TIER_PRIORITY = {"peer_reviewed": 80, "government": 70, "institutional": 60, "trade": 40, "news": 30, "informal": 10}
URGENT_DAYS, MOST_URGENCY = 365, 8
#: Shares and lengths of line and page rules (fixed values).
DEBRIS_VISIBLE, LISTING_SHARE, REFERENCES_FROM, SCANNED_CHARS, LEAST_PHRASE = 3, 0.5, 0.4, 100, 5
ERROR_WORDS = r"(?i)\b(404|page not found|not found|page (does not|doesn't) exist|no longer available)\b"


def visible(text: Column) -> Column:
    """The number of characters that are neither white space nor invisible."""
    return F.char_length(F.regexp_replace(text, r"[\s\p{Cf}\p{Cc}\p{Co}]", ""))


def debris(line: Column) -> Column:
    """An invisible character and hardly anything else."""
    return line.rlike(r"[\p{Cf}\p{Cc}\p{Co}\p{Cn}]") & (visible(line) < DEBRIS_VISIBLE)


def link_share(text: Column) -> Column:
    """The share of what is seen of a text that is the labels of its links."""
    labels = F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]\([^)]*\)"), F.lit(1))
    seen = visible(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"))
    return F.when(seen > 0, visible(F.array_join(labels, "")) / seen).otherwise(0.0)


def listing(text: Column) -> Column:
    return link_share(text) > LISTING_SHARE


def garbled_share(text: Column) -> Column:
    """The share of what is seen that could not be decoded."""
    seen = visible(text)
    return F.when(seen > 0, F.regexp_count(text, F.lit("�")) / seen).otherwise(0.0)


def tokens(text: Column) -> Column:
    """Lower-case words with single spaces around and between them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def phrase_topic(text: Column, phrases: dict[str, str]) -> Column:
    """The topic of the longest phrase that the text holds as whole words, or null; ties go to the phrase that sorts first."""
    out = F.lit(None).cast("string")
    low = tokens(text)
    for p, topic in sorted(phrases.items(), key=lambda x: (-len(x[0]), x[0]), reverse=True):
        if len(p) >= LEAST_PHRASE:
            out = F.when(low.contains(f" {p} "), topic).otherwise(out)
    return out


def without_references(text: Column) -> Column:
    """Lines up to a heading ``References`` that stands beyond two fifths of the lines, without lines that look like citations."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    marks = F.transform(lines, lambda x, i: F.when(F.lower(F.trim(x)).rlike(r"^#* *(references|bibliography|literatur):?$") & (i + 1 > REFERENCES_FROM * n), i))
    stop = F.coalesce(F.array_min(F.array_compact(marks)), n)
    kept = F.filter(F.slice(lines, 1, stop), lambda x: ~x.rlike(r"^\s*\[[0-9]+\] "))
    return F.array_join(kept, "\n")


def priority(tier: Column, half_life: Column) -> Column:
    """The tier's priority and up to eight for what ages fast; halves are rounded to even."""
    base = F.create_map(*(x for t, p in TIER_PRIORITY.items() for x in (F.lit(t), F.lit(p))))[tier]
    urgency = F.when(half_life > 0, F.least(F.greatest(F.bround(MOST_URGENCY * URGENT_DAYS / half_life, 0), F.lit(0.0)), F.lit(float(MOST_URGENCY)))).otherwise(0.0)
    return (F.coalesce(base, F.lit(0)) + urgency).cast("int")


def admission(examined: Column, on_topic: Column, pending: Column, least: int = 5, most: int = 50, most_unknown: int = 20) -> Column:
    """What happens to a host's links: ``refuse`` off topic, ``wait`` above what may be pending, ``probe`` while little is known, else ``queue``."""
    share = on_topic / F.greatest(examined, F.lit(1))
    return (
        F.when((examined >= least) & (share < 0.1), "refuse").when((examined < least) & (pending >= most_unknown), "wait").when(pending >= most, "wait")
        .when(examined < least, "probe").otherwise("queue")
    )


def error_page(title: Column, text: Column, most: int = 200) -> Column:
    """The title or the opening says that there is nothing here."""
    return F.coalesce(title.rlike(ERROR_WORDS), F.lit(False)) | F.coalesce(F.substring(text, 1, most).rlike(ERROR_WORDS), F.lit(False))


def page_unit(kind: Column, place: Column) -> Column:
    """What a passage's place counts: pages of a PDF, offsets of anything else."""
    return F.when(place.isNull(), F.lit(None)).when(kind == "pdf", "page").otherwise("offset")


def literal_like(column: Column, words: str) -> Column:
    """Whether ``words`` occur as they are written, in any case."""
    safe = words.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{safe}%")


def not_a_stub(extra: Column) -> Column:
    """No ``stub`` in the JSON; without any JSON it is none."""
    return F.get_json_object(extra, "$.stub").isNull()


def asks_for_places(question: Column, places: list[str]) -> Column:
    """Names a place as a word, or asks where or in which country."""
    named = F.lit(False)
    for p in places:
        named = named | tokens(question).contains(f" {p.lower()} ")
    return named | question.rlike(r"(?i)\b(where|which (countries|country|cities|places)|by country)\b")


#: Parts of a page that hold no text of its own, blocks that end a line, and character references (fixed values).
SILENT = "script|style|noscript|template|svg|head"
BLOCKS = "p|div|li|ul|ol|h[1-6]|tr|table|section|article|br|blockquote|pre|nav|header|footer"
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescaped(text: Column) -> Column:
    for a, b in REFERENCES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_title(html: Column) -> Column:
    return unescaped(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_language(html: Column) -> Column:
    """The declared language without region, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1)), F.lit(""))


def html_text(html: Column) -> Column:
    """The text of a page: silent parts and comments dropped, blocks on lines of their own, references resolved, blanks collapsed."""
    out = F.regexp_replace(html, rf"(?is)<({SILENT})\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?i)</?({BLOCKS})\b[^>]*>", "\n")
    out = unescaped(F.regexp_replace(out, r"(?s)<[^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def html_links(html: Column) -> Column:
    """The addresses that a page links to, each once, in their order, without fragments, scripts and mail."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?\bhref=[\"']([^\"'#]*)"), F.lit(1)), lambda x: unescaped(x))
    return F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.rlike(r"(?i)^(javascript|mailto|tel|data):")))
