"""The gazetteer and places against regular expressions and a plain reading of the rules."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlspark.operators import gazetteer as G
from marlspark.operators import places as P

TERM = "term_id long, canonical string, aliases array<string>, entity_type string, approved boolean, ambiguous boolean, rejected boolean, jurisdiction string"


def is_cased(s):
    return len(s) <= 8 and s.upper() == s and " " not in s


def brute_matches(text, names):
    """Longest alternatives first at the leftmost place; names: (surface, cased)."""
    if not text or not names:
        return []
    parts = sorted(names, key=lambda n: (-len(n[0]), n[0]))
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(f"(?:{re.escape(s)})" if cased else f"(?i:{re.escape(s)})" for s, cased in parts) + r")(?!\w)")
    return [(m.start(), m.end()) for m in pattern.finditer(text)]


WORDS = ["Land", "land", "Transport", "Authority", "LTA", "lta", "New", "York", "Times", "U.S.", "C++", "é", "Éire", "of", "Bo", "Bosnia", "and"]
NAMES = [("Land Transport Authority", False), ("Land", False), ("LTA", True), ("New York", False), ("New York Times", False), ("U.S.", True), ("C++", True), ("Éire", False), ("Bosnia and", False), ("Bosnia", False), ("York Times of", False)]


def texts(n, seed):
    r = random.Random(seed)
    return [(i, "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ", ", " (", "\n", "", "-", "_"]) for _ in range(r.randrange(25)))) for i in range(n)] + [(n, ""), (n + 1, None), (n + 2, "Land" * 2000), (n + 3, "New York " * 3000)]


@pytest.mark.parametrize("most", [10_000, 0])
def test_find_is_leftmost_longest(spark, most):
    """The automaton and the join give what one alternation, longest first, gives."""
    data = texts(300, 1)
    got = G.find(spark.createDataFrame(data, "k long, text string"), spark.createDataFrame(NAMES, "surface string, cased boolean"), "k", most_chars=most)
    rows = got.collect()
    have = {}
    for r in rows:
        have.setdefault(r["k"], []).append((r["start"], r["end"]))
    for k, t in data:
        assert sorted(have.get(k, [])) == brute_matches(t, NAMES), (k, t)
    near = {(r["k"], r["start"]): r["beside"] for r in rows}
    for k, t in data:
        spans = brute_matches(t, NAMES)
        for (_, last), (s, _) in zip(spans, spans[1:]):
            assert near[k, s] == bool(re.fullmatch(r"\s*[,(]?\s*", t[last:s]))
        if spans:
            assert not near[k, spans[0][0]]


def test_find_among_100_000_names(spark):
    """A vocabulary of 100,000 names, sent and joined: every word is looked up in a plain table."""
    r = random.Random(5)
    letters = "abcdefghijklmnop"
    names = {"".join(r.choice(letters) for _ in range(r.randrange(5, 9))).capitalize() for _ in range(130_000)}
    names = sorted(names)[:100_000]
    assert len(names) == 100_000
    known = set(names)
    data = [(i, " ".join(r.choice(names) if r.random() < 0.3 else "".join(r.choice(letters) for _ in range(6)).capitalize() for _ in range(60))) for i in range(150)]
    t, v = spark.createDataFrame(data, "k long, text string"), spark.createDataFrame([(n, True) for n in names], "surface string, cased boolean")
    want = Counter((k, w) for k, text in data for w in text.split() if w in known)
    for most in (G.MOST_CHARS, 1000):
        got = Counter((x["k"], x["surface"]) for x in G.find(t, v, "k", most_chars=most).collect())
        assert got == want


def test_find_nothing(spark):
    t = spark.createDataFrame([(1, "a b")], "k long, text string")
    none = spark.createDataFrame([], "surface string, cased boolean")
    assert G.find(t, none, "k").collect() == [] and G.find(t, spark.createDataFrame([("", True)], none.schema), "k").collect() == []
    assert G.find(t.limit(0), spark.createDataFrame([("a", True)], none.schema), "k").collect() == []


TERMS = [
    (1, "Land Transport Authority", ["LTA", " LTA ", ""], "agency", True, False, False, "SG"),
    (2, "Latvian Tennis Association", ["LTA"], "agency", True, False, False, "LV"),
    (3, "Bus Rapid Transit", ["BRT", "Metrobus"], "scheme", True, True, False, "CO"),
    (4, "Bridge Repair Team", ["BRT"], "agency", True, False, False, "GB"),
    (5, "Proposed thing", [], "scheme", False, False, False, None),
    (6, "Rejected thing", None, "scheme", False, False, True, None),
    (7, "  ", None, "scheme", True, False, False, None),
    (8, "Ode", ["odd"], "metric", True, False, False, "uk"),
    (9, "ODD", [], "metric", True, False, False, "FR"),
    (10, "Bus Rapid Transit", ["Busway"], "scheme", True, False, False, "BR"),
]


def test_verdicts(spark):
    got = {r["term_id"]: (r["will_load"], r["reason"], r["collides_with"]) for r in G.verdicts(spark.createDataFrame(TERMS, TERM)).collect()}
    assert got == {
        1: (True, "collision", [2]), 2: (True, "collision", [1]), 3: (False, "ambiguous", []), 4: (True, None, []), 5: (False, "unapproved", []), 6: (False, "rejected", []),
        7: (False, "no_patterns", []), 8: (True, None, []), 9: (True, None, []), 10: (True, "collision", [3]),
    }
    loaded = {(r["surface"], r["cased"], r["term_id"], r["label"]) for r in G.loaded(spark.createDataFrame(TERMS, TERM)).collect()}
    assert loaded == {("Land Transport Authority", False, 1, "AGENCY"), ("Latvian Tennis Association", False, 2, "AGENCY"), ("Bridge Repair Team", False, 4, "AGENCY"), ("Ode", False, 8, "METRIC"), ("odd", False, 8, "METRIC"), ("ODD", True, 9, "METRIC"), ("Busway", False, 10, "SCHEME")}


def test_by_context(spark):
    data = [(1, "The LAND transport authority; LTA says"), (2, "LTA alone"), (3, "Land Transport Authority and Latvian Tennis Association: LTA"), (4, "Busway of bus rapid transit, BRT, Bridge Repair Team"), (5, "odd ODD"), (6, None)]
    t = spark.createDataFrame(data, "k long, text string")
    got = sorted((r["k"], r["start"], r["term_id"], r["reason"]) for r in G.by_context(t, spark.createDataFrame(TERMS, TERM), "k").collect())
    text = dict(data)
    assert got == sorted(
        [
            (1, 4, 1, None), (1, 30, 1, "context"), (2, 0, None, "collision"), (3, 0, 1, None), (3, 29, 2, None), (3, 57, None, "collision"),
            (4, 0, 10, None), (4, text[4].index("bus rapid"), 10, "context"), (4, text[4].index("BRT"), 4, "context"), (4, text[4].index("Bridge"), 4, None), (5, 0, 8, None), (5, 4, 9, None),
        ],
        key=lambda x: x[:2],
    )
    assert sorted((r["k"], r["start"], r["term_id"]) for r in G.mentions(t, spark.createDataFrame(TERMS, TERM), "k").collect()) == sorted((k, s, i) for k, s, i, why in got if why is None)


# ---- places


PLACE_NAMES = [("Singapore", "SG", False), ("Singapore River", "SGSIN", False), ("Paris", "FRPAR", False), ("France", "FR", False), ("Paris Agreement", None, False), ("Georgia", "GE", True), ("Kenya", "KE", False), ("Nairobi", "KENBO", False), ("UK", "GB", False), ("uk", "UA", False)]


def brute_vocabulary():
    codes = {}
    for s, c, ambiguous in PLACE_NAMES:
        if not ambiguous and c:
            codes[s] = c
    for s, c, ambiguous in PLACE_NAMES:
        if not ambiguous and c and s.upper() not in codes:
            codes[s.upper()] = c
    for s, c, _ in PLACE_NAMES:
        if c is None:
            codes[s] = codes[s.upper()] = None
    terms = {}
    for i, canonical, aliases, _, approved, ambiguous, rejected, where in TERMS:
        code = {"UK": "GB"}.get((where or "").upper(), (where or "").upper())
        if approved and not rejected and not ambiguous and len(code) == 2:
            for s in dict.fromkeys(x.strip() for x in [canonical, *(aliases or [])]):
                if len(s) >= 5 and s not in codes:
                    terms.setdefault(s, code)
    return codes, terms


def brute_mentions(text, codes, terms):
    out, last = Counter(), (-1, None)
    for s, e in brute_matches(text, [(n, True) for n in {*codes, *terms}]):
        name = text[s:e]
        if name in codes:
            code = codes[name]
            if code is None:
                continue
            if len(code) == 2 and code == last[1] and re.fullmatch(r"\s*[,(]?\s*", text[last[0] : s]):
                last = (-1, None)
                continue
            out[code, False] += 1
            if len(code) == 5:
                last = (e, code[:2])
        else:
            out[terms[name], True] += 1
    return out


def place_texts(n, seed):
    r = random.Random(seed)
    bits = ["Singapore", "Singapore River", "Paris", "PARIS", "France", "Paris Agreement", "Georgia", "Kenya", "Nairobi", "UK", "uk", "Busway", "Land Transport Authority", "word", "words of it"]
    return ["".join(r.choice(bits) + r.choice([" ", " ", ", ", " (", ". ", "\n"]) for _ in range(r.randrange(40))) for _ in range(n)]


def vocabulary(spark):
    return P.vocabulary(spark.createDataFrame(PLACE_NAMES, "surface string, code string, ambiguous boolean"), spark.createDataFrame(TERMS, TERM))


def test_vocabulary_and_mentions(spark):
    codes, terms = brute_vocabulary()
    v = vocabulary(spark)
    assert {(r["surface"], r["code"], r["term"]) for r in v.collect()} == {(s, c, False) for s, c in codes.items()} | {(s, c, True) for s, c in terms.items()}
    data = list(enumerate([*place_texts(250, 3), "", None, "Paris, France", "Paris (France)", "Paris Kenya France", "Nairobi,\n Kenya, Kenya", "Nairobi Singapore"]))
    got = {}
    for r in P.counted(spark.createDataFrame(data, "k long, text string"), v, "k").collect():
        got.setdefault(r["k"], {})[r["code"], r["term"]] = r["n"]
    for k, t in data:
        assert got.get(k, {}) == dict(brute_mentions(t or "", codes, terms)), t


def brute_body(text):
    lines, at, cut = text.split("\n"), 0, None
    for i, line in enumerate(lines):
        if cut is None and re.search(P.REFERENCES, line) and at >= 0.4 * len(text):
            cut = i
        at += len(line) + 1
    return "\n".join(x for x in lines[:cut] if not (len(x) <= 600 and re.search(P.YEAR, x) and re.search(P.CITED, x)))


def test_references_are_stripped(spark):
    r = random.Random(8)
    bits = ["Some prose of the text.", "## References", "references:", "1. Works cited", "A. Author et al. 2019", "Journal of 1999, vol. 3", "In 2020 we went", "", "x" * 700 + " 2019 Journal", "Bibliography of things"]
    data = [(i, "\n".join(r.choice(bits) for _ in range(r.randrange(1, 14)))) for i in range(300)] + [(300, "")]
    got = {x["k"]: x["t"] for x in spark.createDataFrame(data, "k long, text string").select("k", P.without_references(F.col("text")).alias("t")).collect()}
    assert got == {k: brute_body(t) for k, t in data}


LANGUAGES = [("fr", "FR"), ("de", "DE"), ("de", "AT")]


def brute_decision(names, chars, cited, domain, government, language):
    country, by_name, by_term = Counter(), Counter(), Counter()
    for (code, term), n in names.items():
        country[code[:2]] += n
        (by_term if term else by_name)[code[:2]] += n
    best, floor = max(country.values(), default=0), max(4, math.ceil(chars / 10_000))
    passes = lambda n, least: n >= least and n >= 0.25 * best
    said = lambda c: ({"text"} if by_name[c] else set()) | ({"gazetteer"} if by_term[c] else set())
    out = {c: said(c) for c, n in country.items() if passes(n, floor)}
    for code in cited:
        out.setdefault(code, set()).add("entity")
        out.setdefault(code[:2], set()).add("entity")
    if domain:
        if domain in out:
            out[domain].add("domain")
        elif passes(country[domain], 1 if government else 2):
            out[domain] = said(domain) | {"domain"}
        elif not out:
            if government:
                out[domain] = {"domain"}
            elif (language or "").lower() in dict(LANGUAGES) and (language.lower(), domain) in LANGUAGES:
                out[domain] = {"domain", "language"}
    for (code, term), n in names.items():
        if len(code) == 5 and not term and code[:2] in out and passes(n, floor):
            out.setdefault(code, set()).add("text")
    weight = lambda c: names.get((c, False), 0) if len(c) == 5 else country[c]
    return [(c, weight(c), [s for s in P.SIGNALS if s in out[c]]) for c in sorted(out, key=lambda c: (-weight(c), c))]


def test_decision(spark):
    r = random.Random(13)
    codes, terms = brute_vocabulary()
    rows, cited = [], []
    for i, t in enumerate(place_texts(400, 21)):
        title = r.choice([None, "", "On Paris", "Kenya and Nairobi", "UK"])
        rows.append((i, t + "w" * r.choice([0, 0, 60_000]), title, r.choice([None, "fr", "DE", "en", "de"]), r.choice([None, "FR", "SG", "DE", "AT", "KE"]), r.random() < 0.4))
        cited += [(i, c) for c in ("KENBO", "SG", "FRPAR", "JP") if r.random() < 0.1]
    s = spark.createDataFrame(rows, "k long, text string, title string, language string, domain_country string, government boolean")
    named = P.mentions(s, vocabulary(spark), "k")
    found = P.decided(s.withColumn("chars", F.char_length("text")), named, spark.createDataFrame(cited + cited[:5], "k long, code string"), spark.createDataFrame(LANGUAGES, "language string, country string"), "k")
    got, order = {}, {x["k"]: x["places"] for x in P.ordered(found, "k").collect()}
    for x in found.collect():
        got.setdefault(x["k"], {})[x["code"]] = (x["n"], x["signals"])
    some = 0
    for i, text, title, language, domain, government in rows:
        names = brute_mentions(text, codes, terms)
        for key, n in brute_mentions(title or "", codes, terms).items():
            names[key] += 3 * n
        want = brute_decision(names, len(text), {c for k, c in cited if k == i}, domain, government, language)
        assert got.get(i, {}) == {c: (n, signals) for c, n, signals in want} and order.get(i, []) == [c for c, _, _ in want], i
        some += bool(want)
    assert some > 200


def test_comparison_set(spark):
    patterns = spark.createDataFrame([("*.gov.sg",), ("gov.uk",), ("*.gov",), ("x.io",), ("",), ("*",), ("agency.zz",)], "pattern string")
    names = spark.createDataFrame([("SG", "Singapore"), ("GB", "Britain"), ("US", "States"), ("LV", "Latvia"), ("IO", "Ocean"), ("BR", "Brazil"), ("SGSIN", "River"), ("FR", "France"), ("CO", "Colombia")], "code string, name string")
    got = P.comparison_set(patterns, spark.createDataFrame(TERMS, TERM), names, {"uk": "GB", "gov": "US"}, ["io"])
    assert sorted(map(tuple, got.collect())) == sorted([("SG", "Singapore"), ("GB", "Britain"), ("US", "States"), ("LV", "Latvia"), ("BR", "Brazil"), ("FR", "France"), ("CO", "Colombia")])
