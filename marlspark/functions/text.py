"""Text and address functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track (fixed values).
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref"]
#: Half-life shares and document kinds by opening words (fixed values).
FURNITURE = ["login", "signup", "cart", "privacy", "terms"]


def host_key(url: Column) -> Column:
    """The host in lower case, without ``www.`` and port."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def registrable(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def normal_url(url: Column) -> Column:
    """http(s) only: lower scheme and host, no default port, credentials, fragment or tracking parameters; an empty path is ``/``; else null."""
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z]+)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    scheme, host = F.lower(part(1)), F.regexp_replace(F.regexp_replace(F.lower(part(2)), r":80$", ""), r":443$", "")
    names = F.array(*map(F.lit, TRACKING))
    kept = F.filter(F.split(part(4), "&"), lambda p: ~F.array_contains(names, F.lower(F.split_part(p, F.lit("="), F.lit(1)))) & (p != ""))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, path, query))


def refusal(url: Column) -> Column:
    """Why an address is not worth a visit, or null."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    return (
        F.when(normal_url(url).isNull(), "scheme")
        .when(path.rlike("/(" + "|".join(FURNITURE) + ")(/|$)"), "furniture")
        .when(path.rlike(r"\.(jpg|png|gif|zip|mp4|css|js)$"), "extension")
        .when(url.contains("#"), "fragment")
    )


def excerpt(text: Column, most: int = 240) -> Column:
    """White space collapsed, cut at a word below ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_extract(F.substring(flat, 1, most - 1), r"^(.*) ", 1)
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.when(cut != "", cut).otherwise(F.substring(flat, 1, most - 1)), F.lit("…")))


def reference_list(text: Column, lines: int = 3, share: float = 0.6) -> Column:
    """At least ``lines`` lines look like references and hold at least ``share`` of the characters."""
    rows = F.filter(F.split(text, "\n"), lambda r: F.trim(r) != "")
    entry = lambda r: r.rlike(r"^\s*(\[[0-9]+\]|[0-9]+\.|[A-Z][a-z]+, [A-Z]\.)") | r.rlike(r"\((19|20)[0-9]{2}\)") | r.rlike(r"doi\.org/|10\.[0-9]{4,}/")
    hits = F.filter(rows, entry)
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, r: s + F.char_length(r))
    return (F.size(hits) >= lines) & (chars(hits) >= share * chars(rows))


def table_head(text: Column) -> Column:
    """The row above a separator of dashes, or null."""
    return F.nullif(F.regexp_extract(text, r"(?m)^([^\n]*\|[^\n]*)\n[ |:-]*---[ |:-]*$", 1), F.lit(""))


def bare_text(text: Column) -> Column:
    """Markdown links and images as their labels, addresses dropped, spaces collapsed; never empty."""
    plain = F.regexp_replace(F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"https?://\S+", "")
    plain = F.trim(F.regexp_replace(plain, r"[ \t]+", " "))
    return F.when(plain == "", text).otherwise(plain)


def unreadable(text: Column) -> Column:
    """Share of characters in words with a control, private-use or replacement character."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bad = F.filter(words, lambda w: w.rlike(r"[\p{Cc}\p{Co}\x{FFFD}]"))
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, r: s + F.char_length(r))
    return F.when(chars(words) > 0, chars(bad) / chars(words)).otherwise(0.0)


def wide_pairs(text: Column) -> Column:
    """Runs of Chinese, Japanese and Korean characters as overlapping pairs; a single one stays."""
    runs = F.regexp_extract_all(text, F.lit(r"([\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]+)"), F.lit(1))
    pairs = F.transform(runs, lambda r: F.when(F.char_length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return F.flatten(pairs)


def identifiers(text: Column) -> Column:
    """DOIs and arXiv numbers in a text, each once, in order of kind."""
    dois = F.regexp_extract_all(text, F.lit(r"(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)"), F.lit(1))
    arxiv = F.regexp_extract_all(text, F.lit(r"arXiv:([0-9]{4}\.[0-9]{4,5})"), F.lit(1))
    return F.array_distinct(F.concat(F.transform(dois, lambda x: F.concat(F.lit("doi:"), F.lower(x))), F.transform(arxiv, lambda x: F.concat(F.lit("arxiv:"), x))))


def date_refusal(published: Column, fetched: Column) -> Column:
    """Why a declared date is not believed, or null."""
    return (
        F.when(published.isNull(), "missing").when(published > fetched, "future").when(published == fetched, "fetch day")
        .when(F.year(published) < 1993, "before the web").when((F.month(published) == 1) & (F.dayofmonth(published) == 1), "first of January")
    )


def source_tier(host: Column, suffixes: list[tuple[str, str]], default: str = "informal") -> Column:
    """The tier of the longest suffix that the host ends in."""
    out = F.lit(default)
    for suffix, tier in sorted(suffixes, key=lambda x: len(x[0])):
        out = F.when((host == suffix) | host.endswith("." + suffix), tier).otherwise(out)
    return out


def zone_time(ts: Column, zone: str) -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts), "yyyy-MM-dd HH:mm")
