"""Names: titles, kinds of entity, countries of domains, languages by their common words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles that name a kind of page on any site (fixed values).
GENERIC_TITLES = [
    "home", "homepage", "home page", "index", "welcome", "main navigation", "menu", "search", "search results", "results", "news", "events", "resources",
    "publications", "about", "about us", "contact", "contact us", "topics", "overview", "login", "log in", "sign in", "page not found", "introduction",
    "abstract", "contents", "table of contents", "references", "appendix", "summary",
]
#: Titles that stand for none (fixed values).
PLACEHOLDER = r"(?i)^(?:untitled(?:\s+document)?|nan|none|null|undefined|n/?a|no\s+title|title|document\d*|default|slide\s*\d*|page\s*\d*|powerpoint\s+presentation|microsoft\s+(?:word|powerpoint|excel)\b.*|\(untitled\))$"
#: How sites join titles to their names, file names, and numbers stuck to headings (fixed values).
SEGMENTS, FILE_NAME, STUCK_NUMBER = r"\s+(?:\||-|–|—|::|·|»)\s+", r"(?i)\.(?:docx?|pdf|pptx?|xlsx?|tex|dvi|indd|rtf|odt|txt)$", r"^\d+(?:\.\d+)*(?=[A-Z])"

#: Head words by the kind of entity that they signal, and words that end a head (fixed values).
HEADS = {
    "agency": "academy agency alliance administration assembly association authority board bureau centre center coalition college commission committee company conference consortium corporation council court department directorate federation forum foundation inspectorate institute institution laboratory laboratories league ministry office organisation organization parliament partnership secretariat society tribunal union university",
    "scheme": "act allowance bill code directive fund grant guideline guidelines initiative licence license ordinance pass permit pilot plan policy programme program project rebate regulation regulations scheme standard strategy subsidy trial",
    "infrastructure": "airport bridge corridor depot expressway highway hospital interchange lane line motorway port railway road station terminal tunnel",
    "metric": "coefficient index indicator percentage ratio rate score",
}
PREPOSITIONS = ["of", "on", "for", "in", "to", "at", "de", "der", "du"]

#: Country codes that are sold as generic names, and suffixes that stand for another code (fixed values).
GENERIC_CODES = "io co tv me ai ly fm am to cc ws gg la nu tk ag sh vc so gl is im".split()
SUFFIX_COUNTRY = {"uk": "GB", "gov": "US"}

#: Common words that only one of the languages has (own choice).
COMMON_WORDS = {
    "en": "the of and with that from which this have been are was would their when not but they".split(),
    "de": "der die das und ist nicht mit ein eine auf für von dem den sich auch wird sind".split(),
    "fr": "le les des est une dans pour qui sur avec par pas plus nous vous cette sont du".split(),
    "es": "el los las una por con para del como más pero sus ha fue este son ser muy".split(),
}
#: Fewest letters of a text that is judged, least share of letters among what is visible, least certainty (fixed values).
LETTERS, LETTER_SHARE, CERTAIN = 200, 0.6, 0.9


def clean_title(title: Column, publisher: Column, host: Column) -> Column:
    """A title without the segments that name its site or a kind of page; null if nothing is left, or if it is a file's name or under three characters."""
    flat = F.trim(F.regexp_replace(title, r"\s+", " "))
    bare = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^www\.", "")
    site = F.array(F.lower(F.trim(F.coalesce(publisher, F.lit("")))), bare, F.concat(F.lit("www."), bare), F.split_part(bare, F.lit("."), F.lit(1)))
    drop = lambda s: F.array_contains(site, F.lower(s)) | F.lower(s).isin(*GENERIC_TITLES)
    parts = F.filter(F.split(flat, SEGMENTS), lambda s: s != "")
    kept = F.filter(parts, lambda s: ~drop(s))
    text = F.trim(F.regexp_replace(F.when(F.size(kept) < F.size(parts), F.array_join(kept, " - ")).otherwise(flat), STUCK_NUMBER, ""))
    bad = title.isNull() | (F.char_length(flat) < 3) | flat.rlike(FILE_NAME) | flat.rlike(PLACEHOLDER) | text.rlike(PLACEHOLDER) | (F.size(kept) == 0) | (F.char_length(text) < 3) | drop(text)
    return F.when(~bad, text)


def entity_kind(name: Column, default: str = "concept") -> Column:
    """The kind that a name's head signals: its last word before the first preposition; all kinds but a metric need a capital."""
    words = F.filter(F.split(F.trim(name), r"[\s/-]+"), lambda w: w != "")
    stops = F.filter(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*PREPOSITIONS), i)), lambda i: i.isNotNull())
    head = F.get(words, F.coalesce(F.get(stops, F.lit(0)), F.size(words)) - 1)
    out = F.lit(default)
    for kind, heads in HEADS.items():
        proper = F.lit(True) if kind == "metric" else head.rlike(r"^\p{Lu}")
        out = F.when(F.lower(head).isin(*heads.split()) & proper, kind).otherwise(out)
    return out


def domain_country(host: Column, codes: list[str]) -> Column:
    """The country of a domain's last label, or null where that says nothing; ``codes`` are the two-letter codes known."""
    last = F.element_at(F.split(F.lower(host), r"\."), -1)
    table = F.create_map(*(F.lit(x) for pair in SUFFIX_COUNTRY.items() for x in pair))
    plain = F.when((F.char_length(last) == 2) & ~last.isin(*GENERIC_CODES) & F.upper(last).isin(*codes), F.upper(last))
    return F.when(host.contains("."), F.coalesce(F.try_element_at(table, last), plain))


def language(text: Column) -> Column:
    """The language whose common words make up at least nine tenths of all common words; null for short texts, texts of few letters, and where unsure."""
    letters, seen = F.char_length(F.regexp_replace(text, r"\P{L}", "")), F.char_length(F.regexp_replace(text, r"\s", ""))
    words = F.split(F.lower(text), r"[^\p{L}]+")
    among = lambda common: F.size(F.filter(words, lambda w: w.isin(*common)))
    counts = F.array(*(F.struct(among(common).alias("n"), F.lit(name).alias("name")) for name, common in COMMON_WORDS.items()))
    best, total = F.array_max(counts), F.aggregate(counts, F.lit(0), lambda s, c: s + c["n"])
    return F.when((letters >= LETTERS) & (letters >= LETTER_SHARE * seen) & (total > 0) & (best["n"] >= CERTAIN * total), best["name"])
