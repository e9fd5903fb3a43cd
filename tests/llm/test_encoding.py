"""Packing, BPE, WARC archives and nearest neighbours."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlspark.llm import ann, bpe, packing, warc

from .cases import awkward, by_text, documents, multiset, rows

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("which", ["tables", "awkward", "empty"])
def test_packing(spark, sf_dir, which):
    docs = {"tables": documents, "awkward": lambda s, _: awkward(s), "empty": lambda s, d: documents(s, d).limit(0)}[which](spark, sf_dir)
    t = tokenizer(WORD)
    want = multiset((i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in by_text(docs))
    pieces, sequences = [r.asDict() for r in packing.pack(docs, WORD).collect()], defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        sequences[p["sequence_id"]].append(p)
    padded = 0
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in s])
        assert [p["offset"] for p in s] == [0, *ends[:-1]] and ends[-1] <= 4096
        padded += (ends[-1] if ends[-1] & (ends[-1] - 1) == 0 else 4096) - ends[-1]
    total = sum(p["length"] for p in pieces)
    assert padded <= 0.02 * total
    # the ids of every document, put together from its pieces; rows that repeat an id are told apart by what follows on
    got, open_ = [], defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p["start"], repr(p["doc_id"]))):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        if p["start"] == 0:
            open_[p["doc_id"], p["doc_tokens"]].append(ids)
        else:
            next(x for x in open_[p["doc_id"], p["doc_tokens"]] if len(x) == p["start"]).extend(ids)
    for (i, n), each in open_.items():
        assert all(len(x) == n for x in each)
        got += [(i, x) for x in each]
    assert multiset(got) == want


def test_chunks_are_encoded_as_in_the_whole_text():
    t, e = tokenizer(WORD), packing.ChunkEncoder(WORD)
    rng = random.Random(6)
    bits = ["Wort", "ÄÖ", "İx", "K", "Å", "ẞ", "é", "e\u0301", ".", ",", "!?", "|", "12", "'s", "\u00a0", "\u3000", "日本", "😀", "-", "a" * 50, "\u0130", "ﬁ", "<|endoftext|>"]
    texts = ["".join(rng.choice([*bits, " ", " ", "\n"]) for _ in range(30)) for _ in range(400)]
    for i in range(0, 400, 40):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([x.encode() for x in texts[i : i + 40]])] == [t.encode(x, add_special_tokens=False).ids for x in texts[i : i + 40]]


def test_classes_hold_their_number_of_documents(spark):
    """Every class occurs, and a full bin holds as many rests of its class as the class says, in front of what tops it up."""
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, "x " * int(2 ** rng.uniform(4, 12.2))) for i in range(3000)], "doc_id long, text string").coalesce(1)
    bins, seen = defaultdict(list), set()
    for r in packing.pack(docs, WORD).collect():
        bins[r["sequence_id"]].append(r)
    full = [sorted(b, key=lambda r: r["offset"]) for b in bins.values() if sum(r["length"] for r in b) == 4096]
    assert len(full) > 0.9 * len(bins)
    for b in full:
        k = 4096 // b[0]["length"]
        if all(4096 // r["length"] == k and r["start"] + r["length"] == r["doc_tokens"] for r in b[:k]):
            seen.add(k)
    assert set(range(1, 12)) <= seen


@pytest.mark.parametrize("which", ["tables", "awkward", "empty"])
def test_bpe(spark, sf_dir, which):
    docs = {"tables": documents, "awkward": lambda s, _: awkward(s), "empty": lambda s, d: documents(s, d).limit(0)}[which](spark, sf_dir)
    t, want, texts = tokenizer(BYTE), [], []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, x in by_text(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(back)))
        texts.append((i, back))
    assert multiset(rows(bpe.round_trip(docs, BYTE))) == multiset(want)
    assert multiset(rows(bpe.decode(bpe.encode(docs, BYTE), BYTE))) == multiset(texts)


def test_bytes_that_are_no_text():
    v, t = bpe.Vocabulary(BYTE), tokenizer(BYTE)
    for ids in ([v.first[0xF0]], [v.first[0xE2], v.first[0x82]], [v.first[0xC3], v.first[0x28]], list(v.first)):
        assert v.decode(np.array(ids)) == t.decode([int(i) for i in ids], skip_special_tokens=False)


def pages(spark):
    big = "<p>" + "payload " * 300
    trap = "x" * 700 + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9999999\r\n\r\n" + "y" * 700
    bodies = [big, big, "small", "small", None, "", trap, trap, trap + "z", "WARC/1.0\r\n", "WARC/1.0\r\nWARC/1.0\r\n", "tail\r\n\r\n", "ü" * 500, "ü" * 499, "l" * 3_000_000, big]
    data = [(i, f"http://x/{i}\r\nInjected: 1", b, "c", "c") for i, b in enumerate(bodies)] + [(None, None, big, None, None), (6, "http://again", trap, "c", "c")]
    return spark.createDataFrame(data, "page_id long, url string, html string, record string, file string").repartition(2)


def expected(data):
    groups = defaultdict(list)
    for i, h in data:
        groups[h or ""].append(i)
    for i, h in data:
        b = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = len(b) >= 1000 and i != top
        yield i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None, True


def test_reads_that_cut_files_otherwise(spark, monkeypatch):
    """The second read of an archive may be cut into other tasks than the first."""
    first, sizes = warc._segments, iter(["1k", "3k", "700"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def segments(s, path):
        s.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return first(s, path)

    monkeypatch.setattr(warc, "_segments", segments)
    try:
        p = pages(spark)
        p = p.where("html is null or length(html) < 100000")
        want = list(expected([(r["page_id"], r["html"]) for r in p.select("page_id", "html").collect()]))
        assert multiset(rows(warc.round_trip(p))) == multiset(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("block", [None, "64k", "1k"])
def test_archives(spark, sf_dir, block):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if block:
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        for p in [pages(spark), *([table, table.limit(0)] if block != "1k" else [])]:
            want = list(expected([(r["page_id"], r["html"]) for r in p.select("page_id", "html").collect()]))
            assert multiset(rows(warc.round_trip(p))) == multiset(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def nearest(vectors, k):
    ids, x = [i for i, _ in vectors], np.array([v for _, v in vectors], np.float32).astype(np.float64)
    for i, y in zip(ids, x):
        if i % 100 == 0:
            d = np.sqrt(((x - y) ** 2).sum(1))
            yield i, sorted((a, j) for a, j in zip(d.tolist(), ids) if j != i)[:k]


def test_nearest_neighbours(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = dict(nearest([(r["vec_id"], r["embedding"]) for r in table.collect()], 10))
    got = defaultdict(list)
    for r in ann.search(table, table.where("vec_id % 100 = 0"), least=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert got.keys() == want.keys() and all(v == sorted(v) and len(v) == 10 for v in got.values())
    assert np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / 10 for q in want]) >= 0.9
    exact = defaultdict(list)
    for r in ann.search(table, table.where("vec_id % 100 = 0"), rerank=1.0, block=300).orderBy("query_id", "rank").collect():
        exact[r["query_id"]].append((pytest.approx(r["score"], abs=1e-12), r["vec_id"]))
    assert exact == want


def test_recall_at_the_parameters_of_the_query():
    """50,000 vectors in blocks as the operator makes them, judged by its own candidates."""
    import inspect

    p = {k: v.default for k, v in inspect.signature(ann.search).parameters.items()}
    rng, n, found = np.random.default_rng(3), 50_000, []
    centres = rng.normal(size=(40, 64))
    x = (centres[rng.integers(0, 40, n)] * rng.uniform(0, 0.4, (n, 1)) + rng.normal(size=(n, 64))).astype(np.float32)
    pivots, q = x[rng.choice(n, p["pivots"], replace=False)], x[:100]
    asked = ann.permutations(q, pivots, p["prefix"])
    for low in range(0, n, p["block"]):
        perm = ann.permutations(x[low : low + p["block"]], pivots, p["prefix"])
        order = np.argsort(perm.reshape(-1), kind="stable")
        at = np.searchsorted(perm.reshape(-1)[order], np.arange(len(pivots) + 1))
        width = min(len(perm), max(p["least"], int(np.ceil(p["rerank"] * len(perm)))))
        found.append([low + ann.footrule_candidates(a, at, order // p["prefix"], order % p["prefix"], len(perm), p["prefix"], width) for a in asked])
    d = ((q.astype(float)[:, None] - x[None].astype(float)) ** 2).sum(-1) if n * 100 * 64 < 1e8 else (q.astype(float) ** 2).sum(1)[:, None] - 2 * q.astype(float) @ x.T.astype(float) + (x.astype(float) ** 2).sum(1)
    near = [[j for j in np.argsort(d[i]) if j != i][:10] for i in range(100)]
    got = [set(np.concatenate([f[i] for f in found]).tolist()) for i in range(100)]
    assert np.mean([len(g.intersection(w)) / 10 for g, w in zip(got, near)]) >= 0.9


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 0.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (100, [2.0, 0.0]), (200, [0.0, 0.0])]
    v = spark.createDataFrame([(*r, "c", 1) for r in data], "vec_id long, embedding array<float>, block string, n int")
    got = rows(ann.search(v, v.where("vec_id % 100 = 0")).orderBy("query_id", "rank"))
    r2 = 2**0.5
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 1.0), (0, 4, 3, pytest.approx(r2)), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, 1.0), (100, 4, 3, pytest.approx(5**0.5))]
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


def test_queries_of_another_length_take_no_part(spark):
    """The commonest length is that of the table, whatever most queries have."""
    data = [(i, [float(i), 1.0]) for i in range(1, 60)] + [(100, [1.0, 2.0, 3.0]), (200, [3.0, 2.0, 1.0]), (300, [0.0, 1.0])]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = rows(ann.search(v, v.where("vec_id % 100 = 0"), k=2).orderBy("query_id", "rank"))
    assert got == [(300, 1, 1, 1.0), (300, 2, 2, 2.0)]


def test_a_task_merges_its_lists(spark, monkeypatch):
    """Whether lists are merged in the task or passed on early, the result is the same."""
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(900)], "vec_id long, embedding array<double>")
    a = rows(ann.search(v, v.where("vec_id % 100 = 0"), rerank=1.0, block=50).orderBy("query_id", "rank"))
    monkeypatch.setattr(ann, "MOST_HELD", 5)
    assert a == rows(ann.search(v, v.where("vec_id % 100 = 0"), rerank=1.0, block=50).orderBy("query_id", "rank")) and len(a) == 90


def test_queries_dealt_to_all_lanes_are_not_broadcast(spark):
    x = np.random.default_rng(4).normal(size=(90, 3))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.search(v, v.where("vec_id % 10 = 0"), k=2, pivots=16, prefix=4, rerank=1.0)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in out.collect()}
    far = np.linalg.norm(x[:, None] - x[None], axis=2) + 1e9 * np.eye(90)
    assert got == {(q, n + 1): int(far[q].argsort()[n]) for q in range(0, 90, 10) for n in range(2)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_pivots_are_those_of_the_smallest_hashes(spark):
    v = spark.createDataFrame([([float(i), 1.0],) for i in range(3000)], "vec array<double>").repartition(30)
    for n in (5, 1000):
        want = v.orderBy(F.xxhash64("vec")).limit(n).collect()
        assert [r["vec"] for r in ann.smallest_hashes(v, n)] == [r["vec"] for r in want]
