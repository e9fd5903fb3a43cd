"""Exact dedup, substring dedup and SimHash against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from marlspark.llm import exact_dedup, simhash, substring_dedup

from .cases import awkward, by_text, documents, multiset, rows

SMALLEST = -(1 << 63)


def lower(t: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t: str | None) -> list[bytes]:
    return (t or "").encode().split()


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(params=["tables", "awkward", "empty"])
def docs(request, spark, sf_dir):
    if request.param == "tables":
        return documents(spark, sf_dir)
    return awkward(spark) if request.param == "awkward" else documents(spark, sf_dir).limit(0)


@pytest.mark.parametrize("capacity", [4 << 20, 2000])
def test_exact_copies(docs, capacity):
    groups = defaultdict(list)
    data = by_text(docs)
    for i, t in data:
        groups[lower(t)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, keep[lower(t)], len(groups[lower(t)]), i == keep[lower(t)], sha(lower(t).encode())) for i, t in data]
    assert multiset(rows(exact_dedup.deduplicate(docs, capacity=capacity))) == multiset(want)


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    chained = exact_dedup.chained(
        spark.createDataFrame([(0, 7, bytearray(b"s1"), 1, 1, 1, bytearray(b"a")), (0, 7, bytearray(b"s2"), 1, 1, 2, bytearray(b"b")), (0, 7, bytearray(b"s1"), 1, 2, 9, bytearray(b"a"))],
                              "bucket long, h long, sha binary, n_bytes long, n long, keep_id long, text binary").coalesce(1)
    )
    assert {(bytes(r["sha"]), r["group_size"], r["keep_id"]) for r in chained.collect()} == {(b"s1", 3, 9), (b"s2", 1, 2)}


def test_directory_splits_only_overfull_buckets():
    d = exact_dedup.Directory({0: 100, 1: 100, 14: 5, 15: 5}, 4, 50)
    h = np.array([p << 60 for p in range(16)], np.uint64).view(np.int64)
    of = d.bucket(h)
    assert d.depth == 4 and of[0] != of[1] and len(set(of[8:])) == 1


def removed(data: list[tuple], size: int):
    """Brute force: rows that repeat doc_id and text are one document; order by id (null first), text hash, place."""
    order = sorted({(SMALLEST if i is None else i, t or "") for i, t in data}, key=lambda x: (x[0], x[1]))
    seen, out = set(), {}
    for i, t in order:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        out[i, t] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("cells", [28, 8])
def test_repeated_windows(docs, cells):
    data = by_text(docs)
    want = removed(data, 20)
    got = substring_dedup.remove_repeats(docs, log2_cells=cells)
    assert multiset(rows(got)) == multiset([(i, *want[SMALLEST if i is None else i, t or ""]) for i, t in data])


def test_repeated_windows_of_a_few_words(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "COUNTED", 50)
    monkeypatch.setattr(substring_dedup, "LOOKED_UP", 40)
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    want = removed(data, 7)
    got = substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), size=7, log2_cells=12)
    assert multiset(rows(got)) == multiset([(i, *want[i, t]) for i, t in data])


def fingerprint(t: str | None) -> int:
    w = words(lower(t))
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: list[tuple]):
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3 and find(a) != find(b):
                root[find(a)] = find(b)
    least: dict = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in fps}


@pytest.mark.parametrize("tile", [2048, 3])
def test_near_copies(docs, tile):
    prints = [(i, fingerprint(t)) for i, t in by_text(docs)]
    of = components(prints)
    assert multiset(rows(simhash.near_duplicates(docs, tile=tile))) == multiset([(i, f"{f:016x}", of[f]) for i, f in prints])


def test_many_links_between_two_tiles_are_spanned():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 5, dtype=np.uint64)
    x = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) for b in base]))
    a, b = simhash.spanning_links(x, x, 3)
    assert len(a) <= 2 * len(x)
    have = components([(int(k), int(k)) for k in x])
    root = {int(k): int(k) for k in x}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for p, q in zip(a.tolist(), b.tolist()):
        p, q = find(p), find(q)
        root[max(p, q)] = min(p, q)
    assert {k: find(k) for k in root} == have
