"""Operators on texts against brute force."""

from __future__ import annotations

import zlib

import brute
import pytest

from cyclograin.llm import bpe, decontamination, langid, queries, simhash

EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "one two"),
    (6, "Don't <|endoftext|>  stop!!  " * 5),
    (7, "word " * 30000),
    (8, "word " * 30000),
    (9, "x" * 70000),
    (10, "日本語 текст ελληνικά 12 ½ 🙂"),
    (11, "12345 ... !!!"),
]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def small(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_simhash_matches_brute_force(spark, small):
    rows = small + [(d + 10**6, t) for d, t in EDGE]
    got = {r["id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.simhash(rows)


def test_covering_finds_every_close_pair(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base:
        for _ in range(25):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r["a"], r["b"]) for r in simhash.fingerprint_links(frame(spark, [(f,) for f in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}
    assert got == want and want


def test_simhash_deduplicate_keeps_columns_and_smallest(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (2, "other words here now", "z"), (2, "other words here now", "z"), (None, "a b c d", "n")]
    docs = frame(spark, rows, "doc_id long, text string, component_id string")
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a b c d", "y"), (2, "other words here now", "z"), (None, "a b c d", "n")], key=str)


def test_decontamination_matches_brute_force(spark, sf, small):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, "one TWO"), (901, None), (902, "..."), (903, "текст"), (None, "three four")]
    rows = small + [(d + 10**6, t) for d, t in EDGE] + [(5_000_000, "x " + items[0][1] + " y"), (5_000_001, "three one two four")]
    docs, bench = frame(spark, rows), frame(spark, items, "item_id long, text string")
    from pyspark.sql import functions as F

    for block in (150_000, 400):
        found = decontamination.judged(
            decontamination.scan(docs, decontamination.test_windows(bench, "item_id", "text"), "text", ["doc_id"], block)
        )
        found = found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated")
        assert sorted(map(tuple, found.collect())) == sorted(brute.contamination(rows, items))


def test_decontaminate_actions(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = frame(spark, [(1, f"Intro. {item}! Outro é", 7), (2, "clean text", 8), (3, None, 9)], "doc_id long, text string, spans int")
    bench = frame(spark, [(1, item)], "item_id long, text string")
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench, action="spans").collect()}
    assert cut[2] == "clean text" and cut[3] is None
    assert cut[1].startswith("Intro. ") and cut[1].endswith("! Outro é") and "w5" not in cut[1]
    empty = decontamination.decontaminate(docs, bench.limit(0))
    assert empty.count() == 3


def test_language_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows = rows[:120] + [(d + 10**6, t, None) for d, t in EDGE]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    learned = langid.learn(docs)
    profiles = brute.profiles([(t, lang) for _, t, lang in rows])
    got = {}
    for lang, key, rank in learned:
        got.setdefault(lang, {})["".join(chr(c) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c)] = rank
    assert got == profiles
    found = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.predict(docs, learned, "text", ["doc_id"]).collect()}
    assert found == {d: (b[0], round(b[1], 9)) for d, t, _ in rows for b in [brute.language(t, profiles)]}


def test_language_pieces_and_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 1000)
    keys, counts = langid.gram_counts("abc déf " * 500, langid.letters())
    assert len(keys) and counts.sum() > 500
    sf = "/root/testdata/sf0.01"
    got = queries.op3_language_id(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_language_without_learning(spark):
    docs = frame(spark, [(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.predict(docs, langid.learn(docs), "text", ["doc_id"]).first()["lang_pred"] == "und"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


def test_bpe_round_trip_matches_library(spark, small, tokenizer):
    rows = small + [(d + 10**6, t) for d, t in EDGE]
    docs = frame(spark, rows)
    codec = bpe.Codec(docs, "text", queries.vocabulary_path(), 2000)
    ids = bpe.encode(docs, codec, "text", ["doc_id"])
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in rows}
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == want
    text = {r["doc_id"]: r["decoded"] for r in bpe.decode(ids, codec, "ids", ["doc_id"]).collect()}
    assert text == {d: tokenizer.decode(i, skip_special_tokens=False) for d, i in want.items()}


def test_bpe_random_strings_and_lexicon(tmp_path, tokenizer):
    import random

    rng = random.Random(5)
    letters = list("ab'stlrevmd  \n\t!.,19é² 　中́_\x1f​🙂")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)] + ["z" * 3000, "<|endoftext|>" * 3]
    vocabulary = bpe.Vocabulary(queries.vocabulary_path())
    words = sorted({w.encode() for t in texts[:800] for w in t.split(" ") if w})
    path = str(tmp_path / "lexicon")
    bpe.compile_lexicon(words, vocabulary, path)
    lexicon = bpe.Lexicon(path)
    assert len(lexicon.ends) < sum(map(len, words))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for encoder in (bpe.Encoder(vocabulary), bpe.Encoder(vocabulary, lexicon)):
        assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want
    bpe.compile_lexicon([], vocabulary, path)
    assert [x.tolist() for x in bpe.Encoder(vocabulary, bpe.Lexicon(path)).encode([b"ab", None])][1] == []


def test_empty_tables(spark, sf):
    docs = frame(spark, [], "doc_id long, text string, lang string")
    bench = queries.table(spark, sf, "benchmark")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.deduplicate(docs).count() == 0
    assert decontamination.decontaminate(docs, bench).count() == 0
    assert langid.predict(docs, langid.learn(docs), "text", ["doc_id"]).count() == 0
    assert bpe.round_trip(docs, bpe.Codec(docs, "text", queries.vocabulary_path()), "text", ["doc_id"]).count() == 0
