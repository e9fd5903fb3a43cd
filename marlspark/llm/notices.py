"""License scans by fuzzy search for short notices.

A text is lower-cased (A-Z), its words are taken (runs of a-z, 0-9 and characters beyond ASCII) and joined by single spaces.  In this line

- the base phrases are found word for word, and
- every notice of NOTICES is found with a bounded number of edits (inserted, dropped or replaced characters): one per ``per_edit`` characters of it, at most
  ``most_edits``.  A notice with k edits is split into k + 1 pieces, of which any match holds one unchanged (pigeonhole).  One automaton of all pieces goes over the line;
  each hit names a window that the match must lie in, overlapping windows are joined, and the ``regex`` module's bounded-error matching
  says whether a match is there, where, and with how many edits.

A match begins and ends at word boundaries, and the notice's short words that name a license (NAMES) must stand in it unchanged, as "mit" and
"bit" are one edit apart.  A notice may also give labels to texts that no base phrase is in; base labels stay whatever the search says.

Work is linear in the text but for the windows, which are as long as the notices.  Defined results: null text counts as empty; a text without words has no
places, null first and last word and score 0; rows are judged one by one, so ids may repeat or be null; very long texts are searched
whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_by_bytes, prepared, text_bytes

#: Phrases that are searched word for word, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices that are searched with errors, with their labels.
NOTICES = [
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("cc by", "cc-by"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

#: Words of up to four letters that tell one license from another; they must stand unchanged.
NAMES = {"gnu", "cc", "by", "mit"}

#: A-Z become a-z, and every other ASCII character that isn't a letter or digit becomes a space.
PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def edits(notice: str, per_edit: int, most_edits: int) -> int:
    return min(most_edits, len(notice) // per_edit)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """The notice in k + 1 pieces of about equal length, with their places."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Search:
    """The automaton of all pieces and the bounded-error pattern of each notice."""

    def __init__(self, notices: tuple[tuple[str, str], ...], per_edit: int, most_edits: int):
        import ahocorasick
        import regex

        self.notices, self.k = notices, [edits(n, per_edit, most_edits) for n, _ in notices]
        self.patterns = [regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(n, special_only=True)}){{e<={k}}}(?![^ ])") for (n, _), k in zip(notices, self.k)]
        self.names = [NAMES & set(n.split()) for n, _ in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, ((notice, _), k) in enumerate(zip(notices, self.k)):
            for place, piece in pieces(notice, k):
                seeds.setdefault(piece, []).append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()

    def windows(self, line: str) -> list[tuple[int, int, int]]:
        """(notice, start, end): where a match may lie; those of one notice are in order and apart."""
        found: dict[int, list[list[int]]] = {}
        for end, (size, of) in self.automaton.iter(line):
            for i, place in of:
                begin, own = end + 1 - size - place, found.setdefault(i, [])
                low, high = max(0, begin - self.k[i]), min(len(line), begin + len(self.notices[i][0]) + self.k[i])
                if own and low <= own[-1][1] and high <= own[-1][1] and low >= own[-1][0]:
                    continue
                # whole words, so that the window's ends are word boundaries
                low, high = line.rfind(" ", 0, low) + 1, line.find(" ", high)
                high = len(line) if high < 0 else high
                while own and low <= own[-1][1]:
                    low, high = min(own[-1][0], low), max(own[-1][1], high)
                    own.pop()
                own.append([low, high])
        return [(i, a, b) for i, own in sorted(found.items()) for a, b in own]

    def matches(self, line: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in the line, leftmost first and not overlapping for each notice."""
        out = []
        for i, a, b in self.windows(line):
            for m in self.patterns[i].finditer(line, a, b):
                if self.names[i] <= set(m[0].split(" ")):
                    out.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
        return out


@lru_cache(maxsize=4)
def search(notices: tuple[tuple[str, str], ...], per_edit: int, most_edits: int) -> Search:
    return Search(notices, per_edit, most_edits)


def places(line: str, phrase: str) -> list[int]:
    """Where the phrase's words stand one after another; places may overlap."""
    out, at = [], line.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (not at or line[at - 1] == " ") and (end == len(line) or line[end] == " "):
            out.append(at)
        at = line.find(phrase, at + 1)
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scan(text: bytes, notices: Search) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of one text in UTF-8."""
    words = text.translate(PLAIN).split(b" ")
    words = [w for w in words if w]
    line = b" ".join(words).decode()
    found = sorted((at, label) for phrase, label in BASE.items() for at in places(line, phrase))
    fuzzy = sorted(notices.matches(line), key=lambda m: (m[1], m[2], m[0]))
    base = sorted({label for _, label in found})
    labels = sorted({*base, *(notices.notices[i][1] for i, *_ in fuzzy)})
    score = 1.0 if found else max((1 - e / (1 + notices.k[i]) for i, _, _, e in fuzzy), default=0.0)
    first = line.count(" ", 0, found[0][0]) if found else None
    last = first + line.count(" ", found[0][0], found[-1][0]) if found else None
    return len(words), len(found), first, last, ",".join(base), ",".join(labels), score, spans(text, line, fuzzy, notices) if fuzzy else "[]"


def spans(text: bytes, line: str, fuzzy: list, notices: Search) -> str:
    """The matches in the original text, as JSON: label, notice, start, end (code points, end exclusive), edits."""
    original = text.decode()
    at = [m.span() for m in WORD.finditer(original.translate({c: c + 32 for c in range(65, 91)}))]
    out, seen, word = [], 0, 0
    for i, start, end, e in fuzzy:
        word, seen = word + line.count(" ", seen, start), start
        last = word + line.count(" ", start, end)
        out.append({"label": notices.notices[i][1], "notice": notices.notices[i][0], "start": at[word][0], "end": at[last][1], "edits": e})
    return json.dumps(out, separators=(",", ":"))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.string())])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=tuple(NOTICES), per_edit: int = 10, most_edits: int = 6) -> DataFrame:
    """One row per row of ``docs``; ``matches`` lists what the search with errors has found, base phrases found so included."""

    def run(batches):
        s = search(notices, per_edit, most_edits)
        for b in batches_by_bytes(batches, 1):
            rows = [scan(t, s) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(RESULT)[1:]))], schema=RESULT)

    return prepared(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string")
