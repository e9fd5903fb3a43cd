"""Which places texts are about: names counted, cities folded into their countries, and a decision from text, entities, domain and language.

A code of two letters is a country, one of five a city that begins with its country.  The vocabulary is a table (surface, code, term): a null code is
a phrase that holds a name and isn't about the place, ``term`` says that the form is a term of a jurisdiction and not a place's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gazetteer

#: Fewest mentions that tag a place, characters a mention, least share of the most-named country, weight of a title, shortest term, fewest mentions of a domain's own country (fixed values).
MIN_MENTIONS, CHARS_PER_MENTION, SHARE_OF_BEST, TITLE_WEIGHT, MIN_TERM, GOVERNMENT_MENTIONS, DOMAIN_MENTIONS = 4, 10_000, 0.25, 3, 5, 1, 2
#: Signals in the order in which they are listed (fixed values).
SIGNALS = ["text", "gazetteer", "entity", "domain", "language"]
#: A heading of a reference list, and the share of the text from which one counts (fixed values).
REFERENCES, REFERENCES_FROM = r"(?i)^[#*\s\d.]*(?:references|bibliography|works cited|literature cited|reference list)[\s:*]*$", 0.4
#: The longest line that is a citation, the year it holds, and words of citations (fixed values).
CITATION, YEAR = 600, r"\b(?:19|20)\d\d\b"
CITED = r"et al\.|\bpp\.|\bdoi\b|doi\.org|\b[Vv]ol\.|Proceedings|Journal|Conference|Symposium|\bPress\b|Publish|Retrieved from|ISBN|ISSN|arXiv|Workshop|Transactions"


def vocabulary(names: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(surface, code, term) from names (surface, code, ambiguous) and terms of the gazetteer with a ``jurisdiction``.

    Ambiguous names go.  A name also counts in capitals unless that is a name of its own; a phrase without a code beats a name.  Forms of approved, unambiguous terms
    that aren't rejected count for their country where they have MIN_TERM characters and aren't names; a form of several terms is that of the smallest id.
    """
    own = names.where(~F.coalesce("ambiguous", F.lit(False)) | F.col("code").isNull()).select("surface", "code")
    ranked = own.withColumn("rank", F.when(F.col("code").isNull(), 0).otherwise(1)).unionByName(
        own.select(F.upper("surface").alias("surface"), "code", F.when(F.col("code").isNull(), 0).otherwise(2).alias("rank"))
    )
    places = ranked.groupBy("surface").agg(F.min_by("code", F.struct("rank", "code")).alias("code")).withColumn("term", F.lit(False))
    if terms is None:
        return places
    country = F.upper(F.trim("jurisdiction"))
    country = F.when(country == "UK", "GB").otherwise(country)
    of = terms.where("approved and not coalesce(rejected, false) and not ambiguous").select("term_id", country.alias("code")).where("length(code) = 2")
    forms = gazetteer.surfaces(terms).select("term_id", "surface").join(of, "term_id").where(F.char_length("surface") >= MIN_TERM)
    first = forms.groupBy("surface").agg(F.min_by("code", "term_id").alias("code"))
    return places.unionByName(first.join(places, "surface", "left_anti").withColumn("term", F.lit(True)))


def citation(line: Column) -> Column:
    return (F.char_length(line) <= CITATION) & line.rlike(YEAR) & line.rlike(CITED)


def without_references(text: Column) -> Column:
    """The text up to the first heading of a reference list that stands late enough, without lines that read as citations; a heading is one line."""
    lines = F.split(text, "\n")
    at = F.aggregate(
        lines, F.struct(F.lit(0).alias("at"), F.lit(-1).alias("cut"), F.lit(0).alias("n")),
        lambda s, x: F.struct(
            (s["at"] + F.char_length(x) + 1).alias("at"),
            F.when((s["cut"] < 0) & x.rlike(REFERENCES) & (s["at"] >= REFERENCES_FROM * F.char_length(text)), s["n"]).otherwise(s["cut"]).alias("cut"),
            (s["n"] + 1).alias("n"),
        ),
        lambda s: F.when(s["cut"] < 0, s["n"]).otherwise(s["cut"]),
    )
    return F.array_join(F.filter(F.slice(lines, F.lit(1), at), lambda x: ~citation(x)), "\n")


def is_city(code: Column) -> Column:
    return F.char_length(code) == 5


def country_of(code: Column) -> Column:
    return F.left(code, F.lit(2))


def counted(texts: DataFrame, vocab: DataFrame, id_col: str, text_col: str = "text", most_chars: int = gazetteer.MOST_CHARS) -> DataFrame:
    """(id, code, term, n): the places that each text names; a country right after its own city is the same mention."""
    found = gazetteer.find(texts, vocab.select("surface", F.lit(True).alias("cased")), id_col, text_col, most_chars)
    named = found.select(id_col, "start", "beside", "surface").join(vocab, "surface")
    before = F.lag("code").over(Window.partitionBy(id_col).orderBy("start"))
    again = F.col("beside") & ~F.col("term") & ~is_city(F.col("code")) & is_city(before) & (country_of(before) == F.col("code")) & ~F.lag("term").over(Window.partitionBy(id_col).orderBy("start"))
    kept = named.withColumn("again", F.coalesce(again, F.lit(False))).where("code is not null and not again")
    return kept.groupBy(id_col, "code", "term").agg(F.count("*").alias("n"))


def mentions(sources: DataFrame, vocab: DataFrame, id_col: str, text_col: str = "text", title_col: str = "title", most_chars: int = gazetteer.MOST_CHARS) -> DataFrame:
    """(id, code, term, n): places of the body without its references, and those of the title TITLE_WEIGHT times."""
    body = sources.select(id_col, without_references(F.col(text_col)).alias("text"))
    titles = sources.select(id_col, F.col(title_col).alias("text"))
    both = counted(body, vocab, id_col, "text", most_chars).unionByName(counted(titles, vocab, id_col, "text", most_chars).withColumn("n", F.col("n") * TITLE_WEIGHT))
    return both.groupBy(id_col, "code", "term").agg(F.sum("n").alias("n"))


def decided(sources: DataFrame, named: DataFrame, entities: DataFrame, languages: DataFrame, id_col: str) -> DataFrame:
    """(id, code, n, signals): the places that each source is about, by what decided.

    ``sources`` has id, chars (of the body), language, domain_country and government; ``named`` is what ``mentions`` gives; ``entities`` (id, code) are the
    places cited; ``languages`` (language, country) point at countries.

    A country is in by the text if it is named MIN_MENTIONS times, once every CHARS_PER_MENTION characters, and SHARE_OF_BEST as often as the most-named one; cited
    places are in.  The domain's own country needs fewer mentions; where nothing else is in, a government's domain decides, or one whose country
    the language points at.  A city named as often as a country needs to be is in if its country is.
    """
    country = named.groupBy(id_col, country_of(F.col("code")).alias("code")).agg(
        F.sum("n").alias("n"), F.sum(F.when(~F.col("term"), F.col("n")).otherwise(0)).alias("by_name"), F.sum(F.when(F.col("term"), F.col("n")).otherwise(0)).alias("by_term")
    )
    none = F.lit(0).cast("long")
    cited = entities.select(id_col, country_of(F.col("code")).alias("code")).distinct().withColumn("cited", F.lit(True))
    homes = sources.where("domain_country is not null").select(id_col, F.col("domain_country").alias("code"), F.lit(True).alias("home"))
    rows = country.unionByName(cited, allowMissingColumns=True).unionByName(homes, allowMissingColumns=True)
    rows = rows.groupBy(id_col, "code").agg(*(F.coalesce(F.max(c), none).alias(c) for c in ("n", "by_name", "by_term")), *(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("cited", "home")))
    rows = rows.join(sources.select(id_col, "chars", "language", "government"), id_col)
    points = languages.select(F.col("language"), F.col("country").alias("code"), F.lit(True).alias("points")).distinct()
    rows = rows.withColumn("language", F.lower(F.trim("language"))).join(points, ["language", "code"], "left")
    whole = Window.partitionBy(id_col)
    best, floor = F.max("n").over(whole), F.greatest(F.lit(MIN_MENTIONS), F.ceil(F.col("chars") / CHARS_PER_MENTION))
    often = lambda n, least: (n >= least) & (n >= SHARE_OF_BEST * F.col("best"))
    rows = rows.withColumns({"best": best, "floor": floor})
    rows = rows.withColumn("by_text", often(F.col("n"), F.col("floor")))
    rows = rows.withColumn("before", F.max(F.col("by_text") | F.col("cited")).over(whole))
    near = F.col("home") & ~(F.col("by_text") | F.col("cited")) & often(F.col("n"), F.when(F.col("government"), GOVERNMENT_MENTIONS).otherwise(DOMAIN_MENTIONS))
    alone = F.col("home") & ~F.col("before") & ~near
    rows = rows.withColumns({"near": near, "by_state": alone & F.col("government"), "by_language": alone & ~F.col("government") & F.coalesce("points", F.lit(False))})
    is_in = F.col("by_text") | F.col("cited") | F.col("near") | F.col("by_state") | F.col("by_language")
    counts = F.col("by_text") | F.col("near")
    signals = listed({
        "text": counts & (F.col("by_name") > 0), "gazetteer": counts & (F.col("by_term") > 0), "entity": F.col("cited"), "domain": F.col("home") & is_in, "language": F.col("by_language"),
    })
    countries = rows.where(is_in).select(id_col, "code", "n", "best", "floor", signals.alias("signals"))

    cities = named.where(is_city(F.col("code")) & ~F.col("term")).select(id_col, "code", "n").unionByName(
        entities.where(is_city(F.col("code"))).select(id_col, "code", F.lit(None).cast("long").alias("n"), F.lit(True).alias("cited")).distinct(), allowMissingColumns=True
    )
    cities = cities.groupBy(id_col, "code").agg(F.coalesce(F.max("n"), none).alias("n"), F.coalesce(F.max("cited"), F.lit(False)).alias("cited"))
    within = cities.join(countries.select(id_col, F.col("code").alias("country"), "best", "floor"), [cities[id_col] == countries[id_col], country_of(cities["code"]) == F.col("country")]).drop(countries[id_col])
    by_text = often(F.col("n"), F.col("floor"))
    within = within.where(by_text | F.col("cited")).select(id_col, "code", "n", listed({"text": by_text, "entity": F.col("cited")}).alias("signals"))
    return countries.drop("best", "floor").unionByName(within)


def listed(signals: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(signals[s], s) for s in SIGNALS if s in signals)))


def ordered(places: DataFrame, id_col: str) -> DataFrame:
    """(id, places): the codes of each source, most-named first, ties by code."""
    return places.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))), lambda p: p["code"]).alias("places"))


def comparison_set(patterns: DataFrame, terms: DataFrame, names: DataFrame, suffixes: dict[str, str], generic: list[str]) -> DataFrame:
    """(code, name): the countries of government domain patterns (pattern) and of the gazetteer's jurisdictions, by name.

    ``names`` (code, name) are the countries known, with their display names; ``suffixes`` are last labels that stand for a code, ``generic`` codes sold as generic names.
    """
    table = F.create_map(*(F.lit(x) for pair in suffixes.items() for x in pair)) if suffixes else F.lit(None)
    by_suffix = F.try_element_at(table, F.col("tld")) if suffixes else F.lit(None).cast("string")
    plain = F.when((F.char_length("tld") == 2) & ~F.col("tld").isin(*generic), F.upper("tld"))
    of_domains = patterns.withColumn("tld", F.try_element_at(F.filter(F.split(F.lower("pattern"), r"\."), lambda x: ~x.isin("", "*")), F.lit(-1))).select(F.coalesce(by_suffix, plain).alias("code"))
    of_terms = terms.where("approved and not coalesce(rejected, false)").select(F.upper(F.trim("jurisdiction")).alias("code"))
    codes = of_domains.unionByName(of_terms).where("code is not null").withColumn("code", F.when(F.col("code") == "UK", "GB").otherwise(F.col("code"))).distinct()
    return codes.join(names.where("length(code) = 2"), "code").select("code", "name")
