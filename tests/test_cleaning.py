"""Pages without their furniture against a plain reading of the rules, line by line."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import pytest

from marlspark.operators import cleaning as K
from marlspark.operators.claims import MENU_LINES, MENU_LINKED, MENU_WORDS

PY = lambda p: re.compile(p.replace("++", "+").replace("*+", "*"))


class Line:
    def __init__(self, raw):
        self.raw = raw
        body = re.sub(K.MARKS, "", raw).strip(" ")
        plain = PY(K.IMAGE).sub(lambda m: m[1], body)
        self.targets = [m[2] for m in PY(K.LINK).finditer(plain)]
        seen = PY(K.LINK).sub(lambda m: m[1], plain)
        seen = re.sub(r"\\([\[\]()*_`\\])", r"\1", seen)
        self.visible = " ".join(re.sub(r"[*_`]+", " ", seen).split())
        rest = PY(K.LINK).sub("", PY(K.IMAGE).sub("", body))
        self.linked = bool(self.targets or PY(K.IMAGE).search(body)) and bool(re.match(K.FILLER, rest))
        self.row, self.blank = body.startswith("|"), not raw.strip()
        self.words, self.letters = len(self.visible.split()), any(unicodedata.category(c)[0] == "L" for c in self.visible)
        self.names = bool(re.search(K.IDENTIFIER, self.visible)) or any(re.search(K.DOI, t) for t in self.targets)
        self.seen = sum(not c.isspace() for c in self.visible)

    def navigation(self):
        if self.blank or self.row or self.names:
            return None
        if self.words <= 8 and re.match(K.MOVES, self.visible):
            return "navigation"
        if not self.linked:
            return None
        if re.search(K.ELSEWHERE, self.visible):
            return "navigation"
        if not self.visible.strip(" |·•,/-–—()[]"):
            return "empty-link"
        return "anchor" if self.words <= 3 and self.targets and all("#" in t for t in self.targets) else None

    def item(self):
        return not self.row and (self.linked or not self.raw.lstrip(" ").startswith("#")) and self.letters and self.words <= MENU_WORDS and not re.search(K.TERMINAL, self.visible) and not self.names

    def debris(self):
        odd = ("Cf", "Cc", "Co", "Cn")
        if not [c for c in self.raw if unicodedata.category(c) in odd and c not in "\t\r"]:
            return False
        return sum(not c.isspace() and unicodedata.category(c) not in odd for c in self.raw) < 3

    def site(self):
        low = self.visible.lower()
        return low if 12 <= len(low) <= 200 and self.words >= 2 and not self.blank else None


def menus(lines):
    out, run = set(), []

    def flush():
        items = [i for i in run if lines[i].letters]
        if len(items) >= MENU_LINES and sum(lines[i].linked for i in items) >= MENU_LINKED * len(items):
            ends = [i for i in run if lines[i].linked]
            out.update(i for i in run if ends[0] <= i <= ends[-1])
        run.clear()

    for i, line in enumerate(lines):
        if line.blank:
            continue
        if line.item() or (run and not line.letters and not line.row):
            run.append(i)
        else:
            flush()
    flush()
    return out


def brute(pages):
    """pages: (id, text, host)."""
    read = {i: [Line(x) for x in t.split("\n")] for i, t, _ in pages if t is not None}
    hosts = {i: h for i, _, h in pages}
    size, often = Counter(hosts[i] for i in read if any(x.site() for x in read[i])), Counter()
    for i, ls in read.items():
        for mark in {x.site() for x in ls} - {None}:
            often[hosts[i], mark] += 1
    out = {}
    for i, ls in read.items():
        menu, reasons = menus(ls), []
        for n, x in enumerate(ls):
            k = often[hosts[i], x.site()] if hosts[i] is not None and x.site() else 0
            reasons.append(x.navigation() or ("menu" if n in menu else "repeated" if k >= 5 and k >= 0.3 * size[hosts[i]] else "debris" if x.debris() else None))
        removed, total = sum(x.seen for x, r in zip(ls, reasons) if r), sum(x.seen for x in ls)
        keep = bool(total) and removed / total > 0.8
        left = [x.raw for x, r in zip(ls, reasons) if keep or not r]
        out[i] = ("\n".join(left), len(ls) - len(left), removed, total, keep, {} if keep else dict(Counter(r for r in reasons if r)))
    return out


BITS = [
    "Skip to main content", "[Skip to content](#main)", "Back to top", "Open the menu", "{ top }", "Skip this long way of words before the next content here", "[Home](/)", "- [News](/news)", "* [About us](/about)", "1. [Contact](/c)",
    "[Data (opens in a new tab)](/d)", "See [this](/x) (opens in new tab) for more of it.", "[](/empty)", "[ ![](logo.png) ](/home)", "[1](#fn1)", "[Section 2](#s2)", "[Crossref](https://doi.org/10.1000/abc)", "10.1234/abc.def",
    "| a | b |", "|---|", "## Heading", "## [Linked heading](/h)", "2", "—", "[2](/p2)", "", "   ", "A sentence that says something about tolls.", "Plain words", "Label:", "Ends here.", "© 2020 The Example Press Office", "Share this page with a friend",
    "\u200b", "\u00ad x", "x\u200bword here", "\x0c", "**Bold** _line_ of `code`", r"[a \] b](/t)", "> [quoted](/q)", "www.example.org", "Éditions [Élan](/e)", "![alt text](a.png)", "[two](/2) | [three](/3)",
]


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(r.choice(BITS) for _ in range(r.randrange(1, 22)))
        if r.random() < 0.3:
            text += "\n" + "\n".join(f"[Item {k}](/i{k})" for k in range(r.randrange(3, 9)))
        if r.random() < 0.5:
            text += "\n© 2020 The Example Press Office\n" + "A longer paragraph that is worth reading, with many words in it. " * r.randrange(1, 4)
        rows.append((i, text, r.choice(["a", "b", "c", None])))
    return rows + [(n, None, "a"), (n + 1, "", "a"), (n + 2, "[Home](/)\n" * 6 + "word", "d"), (n + 3, "x " * 50_000 + "\n[](/e)", "d")]


def got(spark, rows):
    df = spark.createDataFrame(rows, "k long, text string, host string")
    return {r["k"]: (r["text"], r["lines_removed"], r["removed_chars"], r["total_chars"], r["kept_original"], r["reasons"]) for r in K.cleaned(df, "k").collect()}


def test_cleaning(spark):
    rows = made(400, 17)
    want, have = brute(rows), got(spark, rows)
    assert have.keys() == want.keys()
    for k in want:
        assert have[k] == want[k], (k, dict((i, t) for i, t, _ in rows)[k])
    seen = Counter(r for v in want.values() for r in v[5])
    assert set(seen) == set(K.REASONS) and any(v[4] for v in want.values())


def test_the_guard(spark):
    menu = "\n".join(f"[Item {k}](/i{k})" for k in range(8))  # 8 x 5 characters
    rows = [(1, menu, None), (2, menu + "\n" + "w" * 10, None), (3, menu + "\n" + "w" * 9, None), (4, "", None), (5, "[](/x)", None)]
    have = got(spark, rows)
    assert have[1][4] and have[1][0] == menu and have[1][2:4] == (40, 40)
    assert not have[2][4] and have[2][0] == "w" * 10 and have[2][1] == 8  # four fifths exactly may go
    assert have[3][4] and have[3][1] == 0
    assert have[4] == ("", 0, 0, 0, False, {}) and have[5][0] == "" and have[5][5] == {"empty-link": 1}


@pytest.mark.parametrize("seed", [1])
def test_cleaning_again_finds_no_navigation(spark, seed):
    rows = [(i, t, None) for i, t, _ in made(120, seed) if t]
    once = got(spark, rows)
    twice = got(spark, [(i, v[0], None) for i, v in once.items() if not v[4]])
    assert all(not {"navigation", "empty-link", "anchor", "debris"} & set(v[5]) for v in twice.values())
