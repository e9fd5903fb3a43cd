"""Bridges between areas against a plain reading of the rules."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from marlspark.checkpoints import checkpoint
from marlspark.operators import bridges as B


def made(seed):
    r, rng = random.Random(seed), np.random.default_rng(seed)
    areas, number = [], itertools.count(1)
    vec = lambda: [float(x) for x in rng.normal(size=4)]
    words = ["toll", "bus", "rail", "fare", "lane"]
    for _ in range(3):
        top = next(number)
        areas.append((top, 1, None, vec(), r.sample(words, 3)))
        for _ in range(r.randrange(1, 5)):
            mid = next(number)
            areas.append((mid, 2, top, vec(), r.sample(words, 2)))
            for _ in range(r.randrange(1, 4)):
                areas.append((next(number), 3, mid, vec(), r.sample(words, 3)))
    leaves = [a for a, level, *_ in areas if level == 3]
    members = [(c, r.choice(leaves), r.randrange(12), vec()) for c in range(150)]
    entities = [(n, [r.randrange(170) for _ in range(r.randrange(6))] if r.random() < 0.9 else None, r.random() < 0.1) for n in range(30)]
    edges = [(e, r.randrange(32), r.randrange(32), [r.randrange(170) for _ in range(r.randrange(4))] if r.random() < 0.9 else None) for e in range(80)]
    return areas, members, edges, entities


def brute(areas, members, edges, entities):
    by = {a[0]: a for a in areas}

    def above(leaf):
        out = {}
        while leaf is not None:
            out[by[leaf][1]] = leaf
            leaf = by[leaf][2]
        return out

    unit = {a: np.array(v[3]) / np.linalg.norm(v[3]) for a, v in by.items()}
    leaf, source, vec = {c: x for c, x, _, _ in members}, {c: s for c, _, s, _ in members}, {c: np.array(v) / np.linalg.norm(v) for c, _, _, v in members}
    home = {}
    for n, chunks, _ in entities:
        count = Counter(leaf[c] for c in chunks or [] if c in leaf)
        if count:
            home[n] = min(count, key=lambda x: (-count[x], x))
    notes = {n for n, _, note in entities if note}
    said, cites = {}, {}
    for e, a, b, chunks in edges:
        if a in notes or b in notes:
            continue
        leaves = {leaf[c] for c in chunks or [] if c in leaf} | {home[n] for n in (a, b) if n in home}
        for level in (1, 2, 3):
            for x, y in itertools.combinations(sorted({above(z)[level] for z in leaves}), 2):
                if by[x][2] == by[y][2]:
                    said.setdefault((x, y), set()).add(e)
                    cites.setdefault((x, y), set()).update(source[c] for c in chunks or [] if c in source)
    pairs = set(said)
    for a in by:
        others = [b for b in by if b != a and by[b][1:3] == by[a][1:3]]
        for b in sorted(others, key=lambda b: (-round(float(unit[a] @ unit[b]), 9), b))[:3]:
            pairs.add((min(a, b), max(a, b)))
    out = []
    for a, b in pairs:
        near = [sorted((c for c in leaf if above(leaf[c]).get(by[x][1]) == x), key=lambda c: (-round(float(vec[c] @ unit[y]), 9), c))[:40] for x, y in ((a, b), (b, a))]
        both = sorted(((-round(float(vec[p] @ vec[q]), 9), p, q) for p in near[0] for q in near[1]))
        used, similar = set(), []
        for s, p, q in both:
            if ("a", p) in used or ("b", q) in used or p == q or len(similar) == 3:
                continue
            used |= {("a", p), ("b", q)}
            similar.append((p, q, round(-s, 4)))
        out.append((by[a][1], a, b, round(float(unit[a] @ unit[b]), 4), sorted(said.get((a, b), [])), len(cites.get((a, b), ())), similar, [t for t in by[a][4] if t in by[b][4]]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 4])
def test_bridges(spark, seed):
    areas, members, edges, entities = made(seed)
    got = B.bridges(
        spark.createDataFrame(areas, "area long, level int, parent long, centroid array<double>, terms array<string>"),
        spark.createDataFrame(members, "chunk_id long, leaf long, source_id long, v array<double>"),
        spark.createDataFrame(edges, "edge_id long, src long, dst long, chunks array<long>"),
        spark.createDataFrame(entities, "node long, chunks array<long>, annotation boolean"), checkpoint,
    ).collect()
    rows = sorted((r["level"], r["a"], r["b"], r["similarity"], r["edges"], r["sources"], [tuple(s) for s in r["similar"]], r["shared_terms"]) for r in got)
    want = brute(areas, members, edges, entities)
    assert rows == want and any(r[4] for r in want) and any(r[6] for r in want)
