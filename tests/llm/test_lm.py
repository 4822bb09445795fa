"""The language model against dictionaries, with parts forced small."""

from __future__ import annotations

import zlib

import brute
import numpy as np
import pytest

from cyclograin.llm import lm, queries

EDGE = [None, "", " \t", "Never Seen words here", "a a a a a", "A a"]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(("tokens", "words", "buffer"), [(1 << 21, 1 << 20, 1 << 20), (500, 300, 50)])
def test_scores_match_brute_force(spark, sf, monkeypatch, tokens, words, buffer):
    # the driver's numbers travel in the model; workers fork with the patched sizes
    monkeypatch.setattr(lm, "PART_TOKENS", tokens)
    monkeypatch.setattr(lm, "PART_WORDS", words)
    monkeypatch.setattr(lm, "BUFFER", buffer)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()][:60]
    train = texts[:45] + texts[:5] + EDGE[:3] + ["a b a b a c"] * 4
    model = lm.learn(frame(spark, [(i, t) for i, t in enumerate(train)], "n long, text string"))
    want, sums = brute.kneser_ney(train, texts + EDGE)
    assert np.allclose(sums, 1)
    got = sorted(lm.score(frame(spark, list(enumerate(texts + EDGE))), model, "text", ["doc_id"]).collect())
    assert [(r["n_tokens"], r["n_known"]) for r in got] == [w[:2] for w in want]
    assert np.allclose([r["base_score"] for r in got], [w[2] for w in want], rtol=1e-9)
    assert np.allclose([r["score"] for r in got], [w[3] for w in want], rtol=1e-6)
    if tokens == 500:
        assert len([n for _, n in model.pairs.parts if n]) > 8


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_kneser_ney(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    train = [t for d, t in docs.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    n = sum(len(brute.WORD.findall(t)) + 1 for t in train)
    assert {r["train_tokens"] for r in got} == {n} and len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 5 == 1}
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_empty_tables(spark):
    none = frame(spark, [])
    model = lm.learn(none)
    got = lm.score(frame(spark, [(1, "a b"), (2, None)]), model, "text", ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["score"]) for r in got) == [(1, 3, 0, 0.0), (2, 1, 0, 0.0)]
    assert lm.score(none, model, "text", ["doc_id"]).count() == 0


def test_discounts():
    assert lm.discounts([0, 0, 0, 0]) == (0.5, 1.0, 1.5)
    d = lm.discounts([100, 40, 20, 10])
    assert 0 < d[0] < 1 < d[1] < 2 and d[1] < d[2] < 3
