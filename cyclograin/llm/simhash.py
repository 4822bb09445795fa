"""SimHash near-duplicates by anchor-point covering.

The anchors are the codewords of a product of two binary Golay codes, laid over two blocks of
23 fingerprint bits. The Golay code is perfect with radius 3: each block has exactly one anchor
within 3 bits. A fingerprint has one home anchor; it is replicated to every anchor within covering
radius plus threshold (3 + t in a block, 6 + t in both). Two fingerprints at most t bits apart
therefore meet at the home anchor of the smaller one, always, and are compared only there.

Exact copies share a fingerprint, so only distinct fingerprints are replicated and compared;
a group of copies costs one of them. About sixty replicas of sixteen bytes per distinct
fingerprint are shuffled.

Edge cases: null texts and texts without words have fingerprint zero and are linked like any
other; rows that share an id count as one document in the components, and each row is returned;
rows with a null id get a fingerprint and a null component and link with nothing; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclograin.llm import textkit
from cyclograin.llm.components import components
from cyclograin.operators.attach import settled

SHINGLE = 3
SEED = 42
THRESHOLD = 2
#: first bit of each 23-bit block
BLOCKS = (0, 23)
# Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0xC75
RADIUS = 3
_SPLIT = np.array([32, 9, 10, 11, 12, 13])


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
        n, ones = 1, np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).astype(np.int64)
    else:
        digest, n, ones = xxhash.xxh64_intdigest, len(words) - size + 1, np.zeros(64, dtype=np.int64)
        step = 1 << 16
        for at in range(0, n, step):
            pairs = zip(starts[at : min(at + step, n)].tolist(), ends[at + size - 1 : at + step + size - 1].tolist(), strict=True)
            hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype=">u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """``id, fp`` (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in textkit.chunks(batches, "text"):
            fp = np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fp)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


class Covering:
    """Home and neighbouring anchors of arrays of fingerprints."""

    def __init__(self, threshold: int):
        self.reach = 2 * RADIUS + threshold
        low = np.arange(1 << 12, dtype=np.int64)
        self.low, self.high = self._remainder(low), self._remainder(low << 12)
        patterns: list[list[int]] = [[0]]
        for _ in range(RADIUS + threshold):
            patterns.append([p | 1 << b for p in patterns[-1] for b in range(p.bit_length(), 23)])
        flat = np.array([p for group in patterns for p in group], dtype=np.int64)
        weight = np.array([w for w, group in enumerate(patterns) for _ in group], dtype=np.int8)
        syndrome = self._syndrome(flat)
        order = np.argsort(syndrome, kind="stable")
        counts = np.bincount(syndrome, minlength=1 << 11)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        #: error patterns that lead from a word with this syndrome to an anchor, lightest first
        self.pattern = np.zeros((1 << 11, counts.max()), dtype=np.int64)
        self.weight = np.full((1 << 11, counts.max()), 100, dtype=np.int8)
        self.pattern[syndrome[order], place] = flat[order]
        self.weight[syndrome[order], place] = weight[order]

    @staticmethod
    def _remainder(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(23, 10, -1):
            x ^= np.where(x >> bit & 1, GOLAY << (bit - 11), 0)
        return x

    def _syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0xFFF] ^ self.high[x >> 12]

    def _words(self, fp: np.ndarray) -> list[np.ndarray]:
        u = fp.view(np.uint64)
        return [((u >> np.uint64(b)) & np.uint64(0x7FFFFF)).astype(np.int64) for b in BLOCKS]

    @staticmethod
    def _anchor(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        # any twelve consecutive bits of a codeword of this cyclic code determine it
        return (first >> 11 << 12 | second >> 11).astype(np.int32)

    def home(self, fp: np.ndarray) -> np.ndarray:
        return self._anchor(*[w ^ self.pattern[self._syndrome(w), 0] for w in self._words(fp)])

    def around(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``fp`` and anchors, one pair per replica."""
        a, b = self._words(fp)
        sa, sb = self._syndrome(a), self._syndrome(b)
        near = self.weight[sa][:, :, None] + self.weight[sb][:, None, :] <= self.reach
        i, j, k = np.nonzero(near)
        return i, self._anchor(a[i] ^ self.pattern[sa[i], j], b[i] ^ self.pattern[sb[i], k])


def _replicas(threshold: int, home: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Covering(threshold)
        for batch in batches:
            all_fp = batch.column(0).to_numpy()
            for at in range(0, len(all_fp), 2048):
                fp = all_fp[at : at + 2048]
                if home:
                    yield pa.RecordBatch.from_arrays([pa.array(cover.home(fp)), pa.array(fp)], names=["anchor", "fp"])
                    continue
                i, anchor = cover.around(fp)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i])], names=["anchor", "fp"])

    return run


def fingerprint_links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``a, b``: every pair of the distinct fingerprints ``fp`` at most ``threshold`` bits apart, once."""
    rows = distinct.select("fp")
    home = rows.mapInArrow(_replicas(threshold, True), "anchor int, fp long").withColumnRenamed("fp", "a")
    near = rows.mapInArrow(_replicas(threshold, False), "anchor int, fp long").withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # Spark takes the replicas for no larger than the fingerprints they come from and would broadcast them
    return home.join(near.hint("merge"), "anchor").filter(close).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, size: int = SHINGLE
) -> DataFrame:
    """``id, fp, component_id`` per row: the smallest id reachable through linked fingerprints."""
    marks = settled(fingerprints(docs, id_col, text_col, size))
    known = marks.filter(F.col("id").isNotNull())
    classes = settled(known.groupBy("fp").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    links = settled(fingerprint_links(classes, threshold))
    as_rep = classes.select("fp", "rep")
    ends = links.join(as_rep.toDF("a", "ra"), "a").join(as_rep.toDF("b", "rb"), "b")
    found = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    roots = classes.join(found.toDF("rep", "root"), "rep", "left")
    # only classes of several rows or with links say more than a row knows by itself
    roots = roots.filter((F.col("rep") != F.col("last")) | F.col("root").isNotNull())
    roots = settled(roots.select("fp", F.coalesce("root", "rep").alias("root")))
    return marks.join(roots, "fp", "left").select(
        "id", "fp", F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, the one with the smallest id; columns unchanged.

    Of rows that share that id, the one with the smallest row hash stays; rows with a null id stay.
    """
    groups = near_duplicates(docs, id_col, text_col, threshold)
    lost = settled(groups.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias("_lost")).distinct())
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))
    kept = rows.join(lost, F.col("_id") == F.col("_lost"), "left_anti")
    ids = docs.select(F.col(id_col).cast("long").alias("_twice")).filter("_twice is not null")
    repeated = settled(ids.groupBy("_twice").count().filter("count > 1").select("_twice"))
    if repeated.isEmpty():  # the usual case needs no second reading of the documents
        return kept.select("_row.*")
    single = kept.join(repeated, F.col("_id") == F.col("_twice"), "left_anti")
    again = kept.join(repeated, F.col("_id") == F.col("_twice"), "left_semi")
    first = again.groupBy("_id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return single.select("_row.*").unionByName(first.select("_row.*"))
