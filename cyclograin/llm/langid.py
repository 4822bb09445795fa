"""Language identification by rank-order profiles.

A profile is the ranking of a language's most frequent character n-grams (one to three
characters, inside words padded with one space). A text's own ranking is compared with each
profile by the out-of-place distance: the sum over its n-grams of how far the ranks lie apart, at
most the profile's length; the nearest profile names the language. Counts are taken over all
learning texts: map tasks send one row per language and distinct n-gram.

Edge cases: null texts and texts without a letter are ``und`` with score 0; rows with null
language or text teach nothing; equal distances go to the smaller language name; without any
learned language every text is ``und``. Long texts are counted in pieces of bounded size.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclograin.llm import textkit

#: n-grams in a language's profile, and in a text's own ranking
PROFILE = 400
RANKED = 300
UNKNOWN = "und"
PIECE = 1 << 19


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once, on the driver."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Keys of all n-grams of padded letter codes; a key holds up to three 21-bit code points."""
    c = codes.astype(np.int64)
    space = c == 32
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    return np.concatenate((c[~space], two[~(space[:-1] & space[1:])], three[~space[1:-1]]))


def gram_counts(text: str, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys in ascending order and their counts."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = is_letter[codes]
        padded = np.full(len(codes) + 2, 32, dtype=np.uint32)
        padded[1:-1] = np.where(letter, codes, 32)
        inner = padded != 32
        # one space between words, none doubled
        kept = np.concatenate(([True], inner[1:] | inner[:-1]))
        k, n = np.unique(_grams(padded[kept]), return_counts=True)
        if len(keys):
            keys, back = np.unique(np.concatenate((keys, k)), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate((counts, n)), minlength=len(keys)).astype(np.int64)
        else:
            keys, counts = k, n
    return keys, counts


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> list[tuple[str, int, int]]:
    """``(language, n-gram key, rank)`` of every profile, at most ``size`` rows for a language.

    That is all the driver ever holds. Equal counts are ranked by key.
    """
    is_letter = docs.sparkSession.sparkContext.broadcast(letters())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in textkit.chunks(batches, "text"):
            of: dict[str, list[str]] = {}
            for lang, text in zip(piece.column(0).to_pylist(), texts, strict=True):
                of.setdefault(lang, []).append(textkit.decoded(text))
            for lang, parts in of.items():
                keys, counts = gram_counts("\n".join(parts), is_letter.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"]
                )

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    grams = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = (F.col("n").desc(), F.col("gram"))
    part = W.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order)
    best = grams.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= size).drop("_r")
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= size)
    return [(r["lang"], r["gram"], r["rank"] - 1) for r in best.select("lang", "gram", "rank").collect()]


class Profiles:
    """Profiles as one sorted key array and a matrix of ranks."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size, self.is_letter = size, letters()
        self.langs = sorted({r[0] for r in rows})
        column = {lang: i for i, lang in enumerate(self.langs)}
        self.keys = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, dtype=np.int64)
        for lang, key, rank in rows:
            self.ranks[np.searchsorted(self.keys, key), column[lang]] = rank

    def judge(self, text: str) -> tuple[str, float]:
        keys, counts = gram_counts(text, self.is_letter)
        if len(keys) == 0 or not self.langs:
            return UNKNOWN, 0.0
        top = np.argsort(-counts, kind="stable")[:RANKED]
        own = keys[top]
        at = np.searchsorted(self.keys, own)
        at = np.where((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == own), at, len(self.keys))
        ranks = self.ranks[at]
        gap = np.abs(ranks - np.arange(len(own))[:, None])
        gap = np.where(ranks < 0, self.size, np.minimum(gap, self.size)).sum(axis=0)
        best = int(np.argmin(gap))
        return self.langs[best], 1.0 - float(gap[best]) / (self.size * len(own))


def predict(docs: DataFrame, profiles: list[tuple[str, int, int]], text_col: str, carry: list[str]) -> DataFrame:
    """``carry`` with ``lang_pred`` and ``score`` (one minus the normalised distance); reads only the text."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Profiles(profiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in textkit.chunks(batches, "_text"):
            found = [model.value.judge(textkit.decoded(t)) for t in texts]
            cols = piece.columns[:-1] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=piece.schema.names[:-1] + ["lang_pred", "score"])

    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept out of learning: crc32 of its id as text picks the fold."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold
