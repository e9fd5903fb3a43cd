"""Secret scans, personal data and toxicity."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspark.llm import pii, secrets, toxicity

from .cases import TEXTS, awkward, by_text, documents, multiset, rows

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def listed(spans, kinds):
    return ",".join(f"{kinds[r]}:{s}:{e}" for s, r, e in sorted(spans))


def secret_base(t: str):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def secret_spans(t: str, scope: int = 240):
    base = secret_base(t)
    parts = list(base) + [(m.start(), 5, m.end()) for m in re.finditer(secrets.PATTERNS["endpoint"], t)]
    weak = [(m.start(), r, m.end()) for r, k in ((3, "weak_id"), (4, "weak_secret")) for m in re.finditer(secrets.PATTERNS[k], t)]
    weak = [w for w in weak if not any(s < w[2] and w[0] < e for s, _, e in base)]
    parts += weak
    needs = {secrets.KINDS.index(k): {secrets.KINDS.index(c) for c in v} for k, v in secrets.COMPLETES.items()}
    return base, base + [w for w in weak if any(r in needs[w[1]] and w[0] - scope <= s <= w[2] + scope for s, r, _ in parts)]


def random_texts(alphabet: list[str], n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


SECRET_BITS = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", "😀", ".", "https://a.b/c", "Zx9", "\n", "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF"]


def test_secrets(spark, sf_dir):
    texts = [t for _, t in by_text(awkward(spark))] + [t for _, t in by_text(documents(spark, sf_dir))] + random_texts(SECRET_BITS, 300, 3)
    data = list(enumerate(texts)) + [(None, texts[19]), (7, texts[7])]
    want = []
    for i, t in data:
        base, spans = secret_spans(t or "")
        count = [sum(r == k for _, r, _ in base) for k in range(3)]
        want.append((i, *count, hashlib.sha256(listed(base, secrets.KINDS).encode()).hexdigest(), listed(spans, secrets.KINDS)))
    got = secrets.report(spark.createDataFrame(data, "doc_id long, text string"))
    assert multiset(rows(got)) == multiset(want)


def test_secrets_of_a_long_list(spark):
    """A text of five million characters with 90,000 matches takes seconds, and the result is that of the brute force."""
    rng = random.Random(21)
    text = " ".join(f"{rng.getrandbits(128):032x}" if i % 3 else f"note {i} of the é list, " + "w" * 40 for i in range(135_000))
    docs = spark.createDataFrame([(5, text), (6, "token = abcdef12 " + text[:50_000] + " key " + "Zx9aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF")], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r for r in secrets.report(docs).collect()}
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert time.monotonic() - began < 90
    base = secret_base(text)
    assert len(text) > 4_900_000 and got[5]["n_hex"] == len(base) == 90_000
    assert got[5]["base_sha256"] == hashlib.sha256(listed(base, secrets.KINDS).encode()).hexdigest()
    assert out[5] == re.sub(r"[0-9a-f]{24,}", "[SECRET]", text)
    assert out[6].startswith("[SECRET] [SECRET]" if text[:32].isalnum() else "[SECRET] note 0") and not secret_base(out[6].replace("[SECRET]", ""))


def test_weak_parts_alone_are_not_reported():
    key = "Abcdefgh1jklmnopqrstuvwxyz0123456789ABCD"
    assert secret_spans(key)[1] == []
    assert len(secret_spans(f"https://x.example/ {key}")[1]) == 1
    assert secret_spans(f"https://x.example/ {'. ' * 200}{key}")[1] == []


def test_redaction_keeps_columns_and_rows(spark):
    docs = awkward(spark)
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[19] == "[SECRET] and [SECRET]" and got[0] == "Hello World"
    for r in out.where("text is not null").select("text", "score", "_spans").collect():
        assert not [s for s in secret_base(r["text"]) if r["text"][s[0] : s[2]] != "[SECRET]"] and r["score"] == r["_spans"] == "clash"


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def private_base(t: str):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15])


PRIVATE_BITS = ["a", "@", ".", "-", "b1", "com", " ", "+", "1", "44", "255", "256", "0.0.0.1", "4111111111111111", "4111 1111 1111 1111", "(0)", "é", "😀", "%", "12", "007", "x@y.z"]


def test_base_patterns_of_personal_data():
    for t in [t or "" for t in TEXTS] + random_texts(PRIVATE_BITS, 4000, 4):
        assert pii.base_spans(t) == private_base(t), t


def test_personal_data(spark, sf_dir):
    for docs in (documents(spark, sf_dir), awkward(spark), documents(spark, sf_dir).limit(0)):
        want = []
        for i, t in by_text(docs):
            base = private_base(t or "")
            want.append((i, *(sum(r == k for _, r, _ in base) for k in range(4)), hashlib.sha256(listed(base, pii.KINDS).encode()).hexdigest()))
        got = pii.report(docs)
        found = rows(got)
        assert multiset(r[:-1] for r in found) == multiset(want)
        for r in found:
            spans = [x.split(":") for x in r[-1].split(",") if x]
            base = [x for x in spans if x[0] in pii.KINDS[:4]]
            assert len(base) == sum(r[1:5]) and spans == sorted(spans, key=lambda x: (int(x[1]), pii.KINDS.index(x[0])))


def test_trees_find_what_the_patterns_leave_out():
    rng = random.Random(8)
    rows_ = []
    for _ in range(400):
        n = "".join(rng.choice("0123456789") for _ in range(9))
        rows_ += pii.examples(f"please call +44 {n[:4]} {n[4:]} today or read section {rng.randrange(10**7, 10**8)} of it, page {n[:3]}-{n[3:7]}")
    judge = pii.fit(rows_)
    assert judge.trees is not None
    base, found = judge.spans(["nothing here", "call +44 2079 46095 now"])[1]
    assert base and found[: len(base)] == base


def test_planted_personal_data(spark):
    """Addresses and numbers that are spelled otherwise are found in texts of the tables, and little else is."""
    rng = random.Random(9)
    docs, data, want = documents(spark, "/root/testdata/sf0.01"), [], {}
    for i, text in by_text(docs.where("length(text) between 200 and 2000")):
        words = text.split(" ")
        if i % 2:
            name, host = "".join(rng.choice("abcdefgh") for _ in range(7)), rng.choice(["example", "corp-mail", "uni"])
            form = rng.choice([f"{name} [at] {host} [dot] com", f"{name} (at) {host}.org"])
            words.insert(len(words) // 2, form)
            want[i] = form
        data.append((i, " ".join(words)))
    judge = pii.train(documents(spark, "/root/testdata/sf0.1"))
    planted = spark.createDataFrame(data, "doc_id long, text string")
    texts, found, right, extra = dict(data), {r["doc_id"]: r for r in pii.find(planted, judge=judge).collect()}, 0, 0
    for i, r in found.items():
        more = [texts[i][s["start"] : s["end"]] for s in r["spans"] if s["rank"] == 4]
        right += want.get(i) in more
        extra += len([m for m in more if m != want.get(i)])
    assert len(want) >= 100 and right >= 0.9 * len(want) and extra <= 0.05 * right


def test_personal_data_of_a_long_list():
    judge = pii.fit([r for i in range(300) for r in pii.examples(f"call +44 2079 {10000 + i} or write to a{i}@b{i % 7}.com, see section {10_000_000 + 977 * i} of it")])
    text = " ".join(f"u{i}@h{i % 97}.example.com 0044 {i % 9000 + 1000} {i % 90000 + 10000}" for i in range(60_000))
    began = time.monotonic()
    base, found = judge.spans([text])[0]
    assert time.monotonic() - began < 60 and base == private_base(text) and set(base) <= set(found)
    ends = [(s, e) for s, r, e in found if r > 3]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir)
    out = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in out.items())
    known = [(out[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if r["doc_id"] in out and out[r["doc_id"]]["held_out"]]
    score, toxic = np.array([s for s, _ in known]), np.array([t for _, t in known])
    area = np.mean([(a > b) + 0.5 * (a == b) for a in score[toxic == 1] for b in score[toxic == 0]])
    assert area >= 0.95 and np.mean((score >= 0.5) == toxic) >= 0.93
    # held-out labels, lang, source and ids play no part
    changed = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs.withColumn("lang", F.lit("xx")), changed).collect()}
    assert all(again[i] == pytest.approx(r["score"]) for i, r in out.items())


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(28)] + [(None, 1, 1), (3, 0, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [True, True]
    for ls in (labels.limit(0), labels.where("toxic = 1")):
        assert {r["score"] for r in toxicity.score(docs, ls).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def brute_ratios(data, cls):
    """The log-ratio of each unit of (id, text) by the formula, with plain dictionaries."""
    from collections import Counter, defaultdict
    from math import log

    n, fives = [Counter(), Counter()], set()
    for i, text in data:
        for u in set(u for us in toxicity.unit_lists(text) for u in us):
            w = toxicity.whole(u)
            fives.update(w[max(0, j - 4) : j + 1] for j in range(1 if w[0] == toxicity.START else 4, len(w)))
            if cls.get(i) is not None:
                n[cls[i]].update(toxicity.grams(u))
    two, four, d = {f[-2:] for f in fives}, Counter(f[1:] for f in fives if len(f) == 5), toxicity.SHARED_DISCOUNT
    one = Counter(t[1] for t in two)
    after = defaultdict(list)
    for g, k in four.items():
        after[g[:3]].append(k)

    def shared(g):
        b = (max(one[g[-1]] - d, 0) + d * len(one) / (len(one) + 1)) / sum(one.values())
        if len(g) > 4:
            ks = after[g[-4:-1]]
            b = (max(four[g[-4:]] - d, 0) + d * len(ks) * b) / sum(ks)
        return b

    seen = [defaultdict(list), defaultdict(list)]
    for c in (0, 1):
        for g, k in n[c].items():
            seen[c][g[:-1]].append(k)

    def of_gram(g):
        h = g[:-1]
        if not (seen[0][h] or seen[1][h]):
            return 0.0
        if not (n[0][g] or n[1][g]):  # then only what the discount freed counts
            p = [sum(min(k, toxicity.DISCOUNT) for k in seen[c][h]) / sum(seen[c][h]) if seen[c][h] else 1.0 for c in (0, 1)]
        else:
            b = shared(g)
            p = [(max(n[c][g] - toxicity.DISCOUNT, 0) + sum(min(k, toxicity.DISCOUNT) for k in seen[c][h]) * b) / sum(seen[c][h]) if seen[c][h] else b for c in (0, 1)]
        return log(p[1] / p[0])

    return lambda u: sum(map(of_gram, toxicity.grams(u)))


def test_toxicity_against_brute_force(spark):
    rng = random.Random(12)
    words = ["wall", "house", "walls", "housewall", "vermin", "vermins", "tree", "trees.", "(tree", "\u4eca\u5929\u5f88\u597d", "x" * 200, "\U0001f600!", "q"]
    data = [(i, None if i == 7 else " ".join(rng.choices(words[:-1] if i % 3 else words, k=rng.randrange(25)))) for i in range(120)]
    labels = [(i, i % 2) for i in range(90)]
    docs, table = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    of = brute_ratios(data, {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)})
    want = {}
    for i, text in data:
        r = [of(u) for us in toxicity.unit_lists(text) for u in us]
        want[i] = 1000 * np.mean([np.log(1 - toxicity.SHARE + toxicity.SHARE * np.exp(np.clip(x, -30, 30))) for x in r]) if r else 0.0
    assert max(want.values()) > 0 > min(want.values())
    both = []
    for most in (1 << 25, 0):  # ratios sent to the tasks, and met by joins
        got = {r["doc_id"]: r for r in toxicity.score(docs, table, most_ratios=most).collect()}
        assert len(got) == len(data) and all(r["evidence"] == pytest.approx(want[i], rel=1e-4, abs=1e-5) for i, r in got.items())
        both.append({i: (r["evidence"], r["predicted"]) for i, r in got.items()})
    assert both[0] == both[1]  # not nearly: what is summed are whole numbers


def test_numbers_side_by_side_are_proposed_one_by_one():
    numbers = ["020 7946 0958", "(555) 010-4477", "+44 20 7946 0018", "12-34-56 12345678", "555.010.9988"]
    text = "call " + " ".join(numbers * 30) + " now " + "7" * 90
    found = {text[s:e] for s, kind, e in pii.candidates(text) if kind == 1}
    assert {n.lstrip("(+") if n.startswith("(") else n for n in numbers} <= {f.lstrip("(") for f in found}
    assert all(pii.LEAST <= len(f) <= pii.MOST for f in found) and not any("7" * 41 in f for f in found)
    groups = [m.span() for m in re.finditer("[0-9]+", text)]
    for s, kind, e in pii.candidates(text):  # no group of digits is cut
        assert not any(a < s < b or a < e < b for a, b in groups)


def test_toxicity_of_a_long_text_is_cut_nowhere(spark):
    text = "house " * 90_000 + "murderer " * 3
    assert [u for us in toxicity.unit_lists(text) for u in us] == text.split()
    assert len(list(toxicity.unit_lists(text))) > 1


ORDINARY = "the wall and a door of some house near that river with old trees under grey clouds over our quiet town".split()


def trained(spark, toxic: list[str], clean: list[str] = [], extra: list[str] = []) -> toxicity.Model:
    """A model of 200 short texts, every other one with two of the toxic expressions; the others with two of the clean ones."""
    rng = random.Random(5)
    data = []
    for i in range(200):
        words = rng.sample(ORDINARY, 8)
        for w in rng.sample(toxic, min(2, len(toxic))) if i % 2 else rng.sample(clean, min(2, len(clean))):
            words.insert(rng.randrange(len(words)), w)
        data.append((i, " ".join(words)))
    docs = spark.createDataFrame(data + [(1000 + i, x) for i, x in enumerate(extra)], "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))


def predicted(model, texts):
    return (model.score(model.evidence(texts)) >= 0.5).tolist()


def test_toxicity_of_one_word_and_all_toxic_texts(spark):
    model = trained(spark, ["vermin", "blighter"])
    assert predicted(model, ["vermin", "vermin vermin vermin", "blighter vermin blighter vermin vermin", "Vermin!"]) == [True] * 4
    assert predicted(model, ["wall", "wall wall wall", "the old house", "quiet unseen words", ""]) == [False] * 5


def test_toxicity_keeps_units_apart(spark):
    cell = lambda w: zlib.crc32(w.encode()) >> 11
    names = (a + b + c + d + "zz" for a in "bdfgklmn" for b in "aeiouy" for c in "bdfgklmnprst" for d in "aeiouybdfgklmnprst")
    names = list(names) + [x[::-1] for x in ("".join(p) for p in __import__("itertools").product("qxzvw", "aeiou", "qxzvw", "aeiou", "qxzvw", "aeiou"))]
    seen: dict[int, str] = {}
    toxic, other = next((seen[cell(w)], w) for w in names if seen.setdefault(cell(w), w) != w)  # the same of 2**21 hashed cells
    model = trained(spark, [toxic])
    assert predicted(model, [f"the {toxic} and some wall", f"the {other} and some wall"]) == [True, False]


def test_toxicity_reads_every_character(spark):
    model = trained(spark, ["gesellschaftsratte", "#$%!", "1337", "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u4f60\u662f\u7b28\u86cb"], ["gesellschaftsabend", "#$%.", "1336", "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u73a9"])
    assert predicted(model, ["a gesellschaftsratte", "old #$%! door", "old 1337 door", "\u660e\u5929\u4e5f\u4e0d\u8981\u53bb\u56e0\u4e3a\u4ed6\u662f\u7b28\u86cb"]) == [True] * 4
    assert predicted(model, ["a gesellschaftsabend", "old #$%. door", "old 1336 door", "\u4eca\u5929\u5929\u6c14\u5f88\u597d"]) == [False] * 4
