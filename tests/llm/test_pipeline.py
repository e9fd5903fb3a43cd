"""Every stage of the pipeline on its own input, and the whole."""

from __future__ import annotations

import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from marlspark.llm import toxicity

from .cases import CLASHES, awkward, by_text, documents, multiset
from .test_dedup import components, fingerprint, lower
from .test_encoding import WORD, tokenizer
from .test_scans import secret_spans


@pytest.fixture(params=["tables", "awkward", "empty"])
def docs(request, spark, sf_dir):
    if request.param == "tables":
        return documents(spark, sf_dir)
    return awkward(spark) if request.param == "awkward" else awkward(spark).limit(0)


def test_stages_are_named_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "secret scans", "packing"]


def test_copies(spark, sf_dir, docs):
    out = P.drop_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    groups = defaultdict(list)
    for i, t in by_text(docs):
        groups[lower(t)].append(-1 << 63 if i is None else i)
    got = [(-1 << 63 if i is None else i, lower(t)) for i, t in by_text(out)]
    assert multiset(got) == multiset((max(ids), t) for t, ids in groups.items())


def test_near_copies(spark, sf_dir, docs):
    out = P.drop_near_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    prints = [(i, fingerprint(t)) for i, t in by_text(docs)]
    of = components(prints)
    assert {i for i, _ in by_text(out)} >= {i for i in of.values() if i is not None}
    assert all(i == of[fingerprint(t)] for i, t in by_text(out) if [j for j, _ in prints].count(i) == 1)


def test_redaction(spark, sf_dir, docs):
    out = P.redact_secrets(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = []
    for i, t in by_text(docs):
        at, text = 0, ""
        for s, _, e in sorted(secret_spans(t or "")[1]):
            if s >= at:
                text += (t or "")[at:s] + "[SECRET]"
            at = max(at, e)
        want.append((i, t if t is None else text + t[at:]))
    assert multiset(by_text(out)) == multiset(want)
    assert out.where("n_chars is not null and text is not null and n_chars <> char_length(text)").count() == 0


def test_toxic_documents_go_and_others_stay(spark, sf_dir, docs):
    out = P.drop_toxic(spark, docs, sf_dir)
    assert out.columns == docs.columns
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert multiset(r[0] for r in out.select("doc_id").collect()) == multiset(r[0] for r in scored.where("score < 0.5").select("doc_id").collect())


def test_clashing_columns_come_back_unchanged(spark, sf_dir):
    docs = awkward(spark)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.where(" or ".join(f"`{c}` <> 'clash'" for c in CLASHES)).count() == 0
    assert P.pack_sequences(spark, docs, sf_dir).count() > 0


def test_the_whole(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).persist()
    t = tokenizer(WORD)
    want = multiset((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in by_text(docs))
    got = P.run(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    rows = got.collect()
    assert all(r["n"] == r["m"] for r in rows) and multiset((r["doc_id"], r["n"]) for r in rows) == want
    assert "corpus_pipeline" in sys.modules
