"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The test items are cut into windows of consecutive normalised words. Their hashes, with the
words of each window, are broadcast in blocks of bounded size; every block is one more pass
of the same scan, so a large benchmark costs time and never memory. A scan hashes every word
window of a training text with array operations, looks the hashes up, and compares the words
of each hit with the item's words before it counts.

Edge cases: null and empty texts (documents or items) have no words: no window, no hit, never
contaminated. Repeated document rows each give a row; repeated item rows count once per item id;
items with a null id are left out. Only the named columns are read, so further columns with any
name do no harm. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclograin.llm import textkit
from cyclograin.operators.attach import settled

WINDOW = 13
#: test windows in one broadcast block, about 30 MB with their words
BLOCK_WINDOWS = 150_000
RATIO = 20
_PREFILTER_BITS = 20


def test_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int = WINDOW) -> DataFrame:
    """``item, length, hash, words``: one row per distinct window of an item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in textkit.chunks(batches, "text"):
            items, lengths, hashes, words = [], [], [], []
            for item, text in zip(piece.column(0).to_pylist(), texts, strict=True):
                buf, _ = textkit.joined([text])
                starts, ends = textkit.word_spans(buf, textkit.ALNUM_WORDS)
                if len(starts) == 0:
                    continue
                size = min(n, len(starts))
                parts = [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                found = textkit.Windows(textkit.word_hashes(buf, starts, ends)).of(size)
                for k, h in enumerate(found.view(np.int64).tolist()):
                    items.append(item)
                    lengths.append(size)
                    hashes.append(h)
                    words.append(b" ".join(parts[k : k + size]))
            yield pa.RecordBatch.from_pydict(
                {
                    "item": pa.array(items, pa.string()),
                    "length": pa.array(lengths, pa.int32()),
                    "hash": pa.array(hashes, pa.int64()),
                    "words": pa.array(words, pa.binary()),
                }
            )

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("item").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(cut, "item string, length int, hash long, words binary").distinct()


class Block:
    """A bounded part of the test windows as sorted hashes with their words and items."""

    def __init__(self, rows: list):
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items: dict[bytes, list[str]] = defaultdict(list)
        by_length: dict[int, set[int]] = defaultdict(set)
        for r in rows:
            self.items[bytes(r["words"])].append(r["item"])
            by_length[r["length"]].add(r["hash"])
        for length, hashes in by_length.items():
            keys = np.unique(np.array(sorted(hashes), dtype=np.int64).view(np.uint64))
            near = np.zeros(1 << _PREFILTER_BITS, dtype=bool)
            near[(keys >> np.uint64(64 - _PREFILTER_BITS)).astype(np.int64)] = True
            self.of_length[length] = (keys, near)

    def hits(self, length: int, hashes: np.ndarray) -> np.ndarray:
        keys, near = self.of_length[length]
        at = np.flatnonzero(near[(hashes >> np.uint64(64 - _PREFILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
        return at[keys[place] == hashes[at]]


def _scan_chunk(block: Block, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Word count, byte spans (start, end) of hit words and items found, for each text."""
    buf, begins = textkit.joined(texts)
    starts, ends = textkit.word_spans(buf, textkit.ALNUM_WORDS)
    owner = np.searchsorted(begins, starts, side="right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    windows = textkit.Windows(textkit.word_hashes(buf, starts, ends))
    for length in block.of_length:
        hashes = windows.of(length)
        at = block.hits(length, hashes)
        at = at[owner[at] == owner[at + length - 1]] if len(at) else at
        for i in at.tolist():
            key = b" ".join(buf[a:b].tobytes() for a, b in zip(starts[i : i + length], ends[i : i + length], strict=True))
            found = block.items.get(key)
            if found:
                d = int(owner[i])
                items[d].update(found)
                spans[d].append((i, i + length))
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out: list[list[tuple[int, int]]] = []
    for d, pairs in enumerate(spans):
        hit = sorted({w for a, b in pairs for w in range(a, b)})
        base = int(begins[d])
        out.append([(int(starts[w]) - base, int(ends[w]) - base) for w in hit])
    return np.diff(first), out, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SCANNED = "key string, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def scan(docs: DataFrame, windows: DataFrame, text_col: str, carry: list[str], block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Add ``n_words``, ``spans`` (bytes of the hit words) and ``items`` to ``carry`` and the text.

    ``windows`` is the result of :func:`test_windows`; it is settled, numbered into blocks by
    hash and each block is fetched and broadcast on its own.
    """
    spark = docs.sparkSession
    windows = settled(windows)
    n_blocks = max(1, -(-windows.count() // block_windows))
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(n_blocks)))
    out = docs.select(*carry, F.col(text_col).alias("_text"))
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<struct<start:long,end:long>>)"), "items": F.expr("cast(array() as array<string>)")})
    for b in range(n_blocks):
        block = spark.sparkContext.broadcast(Block(numbered.filter(F.col("block") == b).collect()))
        out = out.mapInArrow(_scanner(block), out.schema)
    return out


def _scanner(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in textkit.chunks(batches, "_text"):
            counts, spans, items = _scan_chunk(block.value, texts)
            names = piece.schema.names
            before = piece.column(names.index("spans")).to_pylist()
            seen = piece.column(names.index("items")).to_pylist()
            all_spans = [
                [{"start": a, "end": e} for a, e in sorted({(s["start"], s["end"]) for s in x} | set(y))]
                for x, y in zip(before, spans, strict=True)
            ]
            cols = dict(zip(names, piece.columns, strict=True))
            cols["n_words"] = pa.array(counts, pa.int64())
            cols["spans"] = pa.array(all_spans, _SPANS)
            cols["items"] = pa.array([sorted(set(x) | y) for x, y in zip(seen, items, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([cols[n].cast(f.type) for n, f in zip(names, piece.schema, strict=True)], schema=piece.schema)

    return run


def judged(scanned: DataFrame) -> DataFrame:
    """``n_hit`` and ``contaminated`` (at least one word in twenty is hit) for scanned rows."""
    n_hit = F.size("spans").cast("long")
    return scanned.withColumns({"n_hit": n_hit, "contaminated": (n_hit > 0) & (n_hit * RATIO >= F.col("n_words"))})


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    action: str = "documents",
    n: int = WINDOW,
) -> DataFrame:
    """The documents with their own columns, cleaned.

    ``action`` "documents" removes contaminated documents; "spans" keeps every document and cuts the
    hit words out of the text.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"unknown action {action!r}")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_in"))
    found = judged(scan(packed, test_windows(benchmark, item_id, item_text, n), "_in", ["_row"]))
    if action == "documents":
        return found.filter(~F.col("contaminated")).select("_row.*")
    cut = found.select("_row", without_spans("_text", "spans").alias("_clean"))
    return cut.select(*[F.col("_clean").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])


def without_spans(text_col: str, spans_col: str):
    """The text without the bytes of the given ordered spans."""
    raw = F.col(text_col).cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans_col, lambda s: s["end"]))
    starts = F.concat(F.transform(spans_col, lambda s: s["start"]), F.array(F.octet_length(text_col).cast("long")))
    parts = F.zip_with(ends, starts, lambda a, b: F.substring(raw, a.cast("int") + 1, (b - a).cast("int")).cast("string"))
    return F.when(F.size(spans_col) == 0, F.col(text_col)).otherwise(F.array_join(parts, ""))
