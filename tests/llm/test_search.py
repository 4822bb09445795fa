"""Ranked search and personal data against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cyclograin.llm import nra, pii, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def brute_search(docs, items, k=10):
    terms = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    terms = [(d, c, sum(c.values())) for d, c in terms if c]
    n_docs, total = len(terms), sum(n for *_, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        want = Counter(TERM.findall((text or "").translate(LOWER)))
        for d, c, n in terms:
            m = 25 + 75 * n * n_docs // total
            s = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, times in want.items()
                if t in c
            )
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return out


EDGE = [(10**6 + i, t) for i, t in enumerate([None, "", " .,", "one", "ONE one", "word " * 50000, "x" * 70000, "日本語 текст ½ one"])]


@pytest.mark.parametrize("size", [1 << 24, 5000])
def test_search_matches_brute_force(spark, sf, monkeypatch, size):
    monkeypatch.setattr(nra, "SEGMENT_BYTES", size)
    monkeypatch.setattr(nra, "BLOCK_TERMS", 60)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += EDGE + docs[:3] + [(None, docs[5][1])] + [(10**7 + i, docs[7][1]) for i in range(25)]
    items = [(i, docs[i][1][:300]) for i in range(0, 40, 5)] + [(3, None), (4, ""), (5, "one ONE"), (5, "one ONE"), (None, "word nowhere"), (6, "nowhere")]
    got = nra.search(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_search(docs, items)))


def test_search_other_columns_and_empty_tables(spark):
    docs = frame(spark, [(1, "a b", "x", 2)], "doc_id long, text string, item_id string, rank int")
    items = frame(spark, [(9, "B", 3)], "item_id long, text string, doc_id int")
    assert [tuple(r)[:3] for r in nra.search(docs, items).collect()] == [(9, 1, 1)]
    assert nra.search(docs.limit(0), items).count() == 0
    assert nra.search(docs, items.limit(0)).collect() == []


def test_resolve_keeps_the_best_and_their_ties(monkeypatch):
    rng = random.Random(5)
    for trial in range(200):
        monkeypatch.setattr(nra, "FIRST_DEPTH", rng.choice([1, 2, 7]))
        n, width = rng.randrange(1, 60), rng.randrange(1, 6)
        post = [(d, t, rng.choice([1, 1, 2, 9])) for d in range(n) for t in range(width) if rng.random() < 0.4]
        doc, term, tf = (np.array([p[i] for p in post], np.int32) for i in range(3))
        lists = nra.impact_lists(np.full(n, rng.randrange(1, 9)), doc, term, tf, width, n, 5 * n)
        weights = np.array([rng.randrange(1, 5) for _ in range(width)])
        total = np.zeros(n, np.int64)
        np.add.at(total, lists.docs, np.repeat(weights, np.diff(lists.starts)) * lists.impacts)
        k, floor = rng.randrange(1, 12), rng.choice([1, int(np.median(total)) + 1])
        found, scores = nra.resolve(lists, np.arange(width), weights, k, floor)
        assert (total[found] == scores).all()
        best = sorted(total.tolist(), reverse=True)
        least = max(floor, best[k - 1] if n >= k else 1)
        assert set(np.flatnonzero(total >= least)) == set(found[scores >= least]), trial


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "url": r"[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20/@?#\"<>]+@[A-Za-z0-9.-]+[^\x00-\x20\"<>]*",
}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        odd, even = digits[::-1][::2], digits[::-1][1::2]
        return 14 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute_spans(text):
    out = [(m.start(), pii.KINDS.index(k), m.end()) for k, p in RULES.items() for m in re.finditer(p, text) if valid(k, m.group())]
    for cue in pii.CUES:
        for m in re.finditer(rf"(?i:(?<![A-Za-z0-9]){cue})[ \t:=#.]{{1,4}}([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)", text):
            body = m.group(1).replace("-", "")
            if len(body) <= 34 and len(re.sub("[^0-9]", "", body)) >= 5:
                out.append((m.start(1), 5, m.end(1)))
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(set(out))]


PIECES = ["@", ".", "..", "a", "b@c.d", "x.y", "+1", " ", "-", "(743)", "555-3824", "4465758382889437", "1.2.3.4", "300", "255", "é", "日", "://", "http", "u:p", "/", "IBAN", "ssn", ": ", "#", "DE4412345", "0", "07", "account", "\n", "%", "?", "9" * 25, "1 " * 15]


def test_spans_match_the_rules():
    rng = random.Random(11)
    for _ in range(20000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14)))
        assert pii.spans(text) == brute_spans(text), text


def test_query_counts_and_digests(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op12_pii(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute_spans(docs[r["doc_id"]] or "")
        text = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r["spans"] == ",".join(text)
        base = ",".join(t for t in text if t.split(":")[0] in pii.BASE)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["n_email"] == sum(k == "email" for k, *_ in want)


def test_pii_edges_and_redaction(spark):
    long = "1 " * 200000 + "a.b@c.de"
    rows = [(1, None, "x"), (2, "", "y"), (3, "mail a@b.c, IBAN: DE44-5001 +1 (743) 555-3824!", "z"), (None, long, None), (3, "mail a@b.c", "z")]
    docs = frame(spark, rows, "doc_id long, text string, kind string")
    got = {(r["doc_id"], r["kind"]): r["spans"] for r in pii.find(docs.filter("text is null or text <> 'mail a@b.c'"), "text", ["doc_id", "kind"]).collect()}
    assert got[1, "x"] == [] and got[2, "y"] == []
    assert [tuple(s) for s in got[3, "z"]] == [("email", 5, 10), ("account", 18, 27), ("phone", 28, 45)]
    assert [tuple(s) for s in got[None, None]] == [("email", 400000, 400008)]
    clean = [r["text"] for r in pii.redact(docs).filter("doc_id = 3").collect()]
    assert sorted(clean) == ["mail <EMAIL>", "mail <EMAIL>, IBAN: <ACCOUNT> <PHONE>!"]
    assert pii.redact(docs).columns == docs.columns
    assert pii.find(docs.limit(0), "text", ["doc_id"]).count() == 0
