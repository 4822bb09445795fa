"""WARC, vectors and sharding against brute force."""

from __future__ import annotations

import gzip
import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclograin.llm import sharding, vectors, warc


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 400_000
    rows = [(1, "http://a/ b", "same"), (2, None, "same"), (7, "http://c", "same"), (3, "u", None), (4, "u", ""), (5, "x\ny", big), (6, "u", "WARC/1.1\r\n\r\n")]
    rows += [(None, "n", "same"), (9, "r", "twice"), (9, "r", "twice"), (10, "r", "twice")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    files = warc.write(pages, str(tmp_path / "warc"), chunk=100_000)
    cut = warc.to_chunks(pages, "page_id", "url", "html", chunk=100_000).filter("id = 5")
    assert cut.count() == 20 and cut.selectExpr("max(octet_length(data)) AS n").first()["n"] == 100_000
    chunks = warc.read(spark, files, 1 << 16)
    # every archive is read by a task of its own
    paths = [r["path"] for r in files.collect()]
    alone = [warc.read(spark, files.filter(F.col("path") == p), 1 << 16).count() for p in paths]
    together = [r["count"] for r in chunks.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(paths) > 1 and sorted(together) == sorted(n for n in alone if n)
    got = sorted((tuple(r) for r in warc.summary(chunks).drop("uri").collect()), key=str)
    largest = {"same": 7, "": 4, "twice": 10}
    want = []
    for i, _, text in rows:
        text = text or ""
        data = text.encode()
        first = largest.get(text)
        again = first is not None and i != first
        want.append((i, "revisit" if again else "response", first if again else None, len(data), brute.base32_sha1(data), True))
    assert got == sorted(want, key=str)
    parts = sorted((r["chunk_no"], bytes(r["data"])) for r in chunks.filter("id = 5").collect())
    assert b"".join(p for _, p in parts) == big.encode() and max(len(p) for _, p in parts) <= 1 << 16 and len(parts) > 20
    heads = b"".join(gzip.open(f["path"]).read() for f in files.collect())
    assert heads.count(b"WARC-Type: revisit") == sum(w[1] == "revisit" for w in want)


def test_warc_least_bytes_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "longer"), (4, "u", "longer")], "page_id long, url string, html string")
    got = {r["id"]: r["refers_to"] for r in warc.summary(warc.read(spark, warc.write(pages, str(tmp_path / "a"), least=3))).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    assert warc.read(spark, warc.write(pages.limit(0), str(tmp_path / "b"))).count() == 0


def brute_vectors(rows, least=0.98):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float64)
        good[i] = (label, x / np.linalg.norm(x))
    links = []
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= least:
                links.append((a, b))
    n = Counter(x for p in links for x in p)
    root = brute.roots([r[0] for r in rows if r[0] is not None], links)
    return {i: (n[i], root[i], root[i] == i) for i in root}


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors_match_brute_force(spark, sf, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    base = rng.standard_normal(64)
    rows += [(10_000 + i, [float(np.float32(x)) for x in base + rng.standard_normal(64) * 0.05], 1) for i in range(60)]
    rows += [(20_000 + i, [float(x) for x in base], 1) for i in range(3)] + [(20_010, [float(3 * x) for x in base], 1), (20_011, [float(x) for x in base], 2)]
    rows += [(30_000, None, 1), (30_001, [], 1), (30_002, [0.0] * 64, 1), (30_003, [float("nan")] * 64, 1), (30_004, [None] + [1.0] * 63, 1)]
    rows += [(30_005, [1.0] * 64, None), (30_006, [1.0] * 64, None), (30_007, [1e300] * 64, 4), (30_008, [1e-300] * 64, 4), (30_009, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows] + [(None, [1.0] * 64, 4, 0)], "vec_id long, embedding array<double>, label int, rep int")
    got = vectors.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    want = brute_vectors(rows)
    found = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["id"] is not None}
    wrong = [i for i in want if found[i] != want[i]]
    assert len(wrong) <= 2, [(i, found[i], want[i]) for i in wrong[:5]]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["id"] is None] == [(0, None, True)]


def test_vectors_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (0.9801 * a + math.sqrt(1 - 0.9801**2) * b).tolist(), 1)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.filter("n_links = 1").count() >= 0.99 * 1000
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def plain_best_fit(weights, capacity):
    room = []
    for w in sorted(weights, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= w]
        if fits:
            r, k = min(fits)
            room[k] = r - w
        else:
            room.append(max(capacity, w) - w)
    return room


def test_packing_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for capacity in (50, 97, 400):
        weights = rng.integers(1, 60, size=300).tolist()
        runs = sharding.pack(sorted(Counter(weights).items()), capacity)
        load = defaultdict(int)
        for w, first, last, b in runs:
            load[b] += w * (last - first + 1)
        assert sum(load.values()) == sum(weights)
        room = plain_best_fit(weights, capacity)
        assert sorted(max(capacity, load[b]) - load[b] for b in load) == sorted(room)


def test_shards(spark, sf, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_001, None), (10_002, ""), (10_003, None), (10_003, None), (None, "null id"), (10_004, "z" * 9000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")
    for limit in (200_000, 9):
        monkeypatch.setattr(sharding, "NUMBERED", limit)
        got = sharding.shard_documents(docs).collect()
        assert sorted(((r["id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(
            ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str
        )
        load, slots, home = Counter(), defaultdict(list), defaultdict(set)
        for r in got:
            load[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
            home[r["text_crc32"]].add(r["shard"])
        assert set(load) == set(range(8)) and all(len(s) == 1 for s in home.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 8
    fixed = sharding.assign(docs.selectExpr("text as g", "1L as w").filter("g is not null"), "g", "w", capacity=10)
    assert fixed.groupBy("bin").count().agg({"count": "max"}).first()[0] <= 10
    assert sharding.shard_documents(docs.limit(0)).count() == 0
