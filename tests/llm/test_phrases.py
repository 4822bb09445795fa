"""Phrase mining against dictionaries, with streams cut into many partitions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from cyclograin.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema)


def brute(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, b in cand.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if (q := p[i:j]) != p and b >= f[q]}
        found = []
        for p, a in cand.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "stream"), [(3, 50, 40), (2, None, 500_000)])
def test_phrases_match_brute_force(spark, sf, monkeypatch, least, top, stream):
    monkeypatch.setattr(phrases, "STREAM_ROWS", stream)
    monkeypatch.setattr(phrases, "PART_WORDS", 100)
    docs = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rng = random.Random(2)
    toy = [" ".join(rng.choice("a b c d".split()) for _ in range(80)) for _ in range(20)]
    docs += [(t, None) for t in toy] + [("A a a a a a, a\ta!B\x0bc", "xx")] * 3 + [(None, "en"), ("", None), (" .,", "en"), ("long word " * 30000, "de")]
    docs += docs[:4]
    got = phrases.mine(frame(spark, [(i, *d) for i, d in enumerate(docs)]), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, least, top)


def test_other_columns_and_empty_tables(spark):
    rows = [(1, "x y x y x y", None, "q", 5)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, word string, ids int")
    assert [tuple(r) for r in phrases.mine(docs, least=2).collect()] == brute([("x y x y x y", None)], 2, None)
    assert phrases.mine(docs.limit(0)).collect() == []
    assert phrases.mine(docs, least=100).collect() == []
