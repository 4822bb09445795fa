"""The whole pipeline against brute force, and its stages on odd rows."""

from __future__ import annotations

import hashlib
import pathlib
import sys

import brute

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from cyclograin.llm import queries  # noqa: E402


def expected(docs, items):
    """(doc_id, tokens, ids digest, text digest) of (doc_id, text, lang) rows."""
    from tokenizers import Tokenizer

    profiles = brute.profiles([(t, lang) for _, t, lang in docs])
    kept = []
    for d, text, _ in docs:
        lang, score = brute.language(text, profiles)
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            kept.append((d, text))
    groups = brute.simhash(kept)
    kept = [(d, t) for d, t in kept if groups[d][1] == d]
    bad = {r[0] for r in brute.contamination(kept, items) if r[5]}
    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    out = []
    for d, text in kept:
        if d not in bad:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            back = tokenizer.decode(ids, skip_special_tokens=False)
            out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out), len(docs) - len(kept), len(bad)


def test_run_matches_brute_force(spark, sf, tmp_path):
    docs = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text", "lang").collect()]
    items = [tuple(r) for r in queries.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    want, gone, bad = expected(docs, items)
    assert gone and bad
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want


def test_stages_on_odd_rows(spark, sf):
    odd = [(1, None, "en", 5.0, "a"), (2, "", None, None, None), (3, "12 34 !", "en", 1.0, "b"), (None, "the cat and the dog", "en", 1.0, "c")]
    odd += [(4, "the cat and the dog", "en", 1.0, "d"), (4, "the cat and the dog", "en", 1.0, "d"), (5, "der Hund und die Katze " * 2000, "de", 2.0, "e")]
    schema = "doc_id long, text string, lang string, score double, component_id string"
    docs = spark.createDataFrame(odd, schema).selectExpr("*", "1 as n_words", "2 as spans", "3 as row", "4 as _id", "5 as lang_pred", "6 as fp", "7 as count")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        if name == "language_id":
            assert sorted(str(r["doc_id"]) for r in rows) == ["4", "4", "5", "None"]
        if name == "simhash_dedup":
            assert sorted(str(r["doc_id"]) for r in rows) == ["1", "3", "4", "5", "None"]
        if name == "decontaminate":
            assert len(rows) == len(odd)
        assert stage(spark, docs.limit(0), sf).count() == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(tokens) == len(odd) and sum(r["n_tokens"] == 0 for r in tokens) == 2
