"""Interpolated modified Kneser-Ney model of two-word sequences, counted in Spark.

Words are known by a 64-bit hash; the vocabulary is a sorted array of hashes, and a word's id is its
place in it. A pair of words is one 64-bit key of two ids. Counts are reduced by Spark's shuffle and
sort and written, in parts, as sorted key arrays with their counts into the shared folder.
Workers map these files into memory and look up all distinct words and pairs of a chunk of texts
together; only the pages touched are read, and executors on one machine share them.

A part holds a bounded share of the tokens: a context seen too often is split over several parts
by its following word, so that a word that makes up a third of the corpus does not end in one
task. Tables are summed over the parts afterwards.

The probability is max(c - D(c), 0) / c(context) plus the context's freed mass times the
continuation probability of the word, which is discounted and interpolated in the same way with the
uniform distribution over the vocabulary and one unknown word. Discounts follow the counts of counts.

Edge cases: a null or empty text is one end token; unknown words have the unknown word's probability
and lead to no context; with an empty learning table every token has the uniform probability of the
unknown word alone (score 0). Repeated rows count as often as they occur. Only the named columns are
read.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclograin.llm import textkit
from cyclograin.operators.attach import scratch_path, settled

#: tokens in a part of the pair table, and rows in a part of the vocabulary, about
PART_TOKENS = 1 << 21
PART_WORDS = 1 << 20
COUNT_CHUNK = 1 << 23
BUFFER = 1 << 20
#: the end token in place of a word's hash
END = np.int64(-0x61C8864680B583EB)
_STORED = "kind int, key long, a long, b long, c long, d long, n long, path string"
FILE, CONTEXT, FOLLOWS, LEVEL = range(4)


@dataclass
class Sorted:
    """Sorted keys with their values in files by part; ``parts[p]`` is (path, rows)."""

    parts: list[tuple[str | None, int]]
    width: int
    kind: str = "float64"
    _open: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.parts)

    def part(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        if p not in self._open:
            path, n = self.parts[p]
            if not n:
                self._open[p] = (np.empty(0, np.int64), np.empty((self.width, 0)))
            else:
                keys = mapped(f"{path}.keys", np.int64, n)
                self._open[p] = (keys, [mapped(f"{path}.{k}", self.kind, n) for k in range(self.width)])
        return self._open[p]

    def find(self, parts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Global place (-1 if absent) and values (0 if absent) of each key."""
        place = np.full(len(keys), -1, dtype=np.int64)
        values = [np.zeros(len(keys)) for _ in range(self.width)]
        starts = np.concatenate(([0], np.cumsum([n for _, n in self.parts])))
        order = np.argsort(parts, kind="stable")
        cuts = np.searchsorted(parts[order], np.arange(len(self.parts) + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            sorted_keys, columns = self.part(p)
            if not len(sorted_keys):
                continue
            at = order[cuts[p] : cuts[p + 1]]
            i = np.minimum(np.searchsorted(sorted_keys, keys[at]), len(sorted_keys) - 1)
            ok = sorted_keys[i] == keys[at]
            at, i = at[ok], i[ok]
            place[at] = starts[p] + i
            for out, column in zip(values, columns, strict=True):
                out[at] = column[i]
        return place, values


def mapped(uri: str, kind: type | str, n: int) -> np.ndarray:
    """A file of the shared folder, mapped into memory.

    A file in a store without a local path is copied to the worker's disk first; the copy is
    unlinked at once and goes with the mapping.
    """
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r", shape=(n,))
    with fs.open_input_stream(path, compression=None) as src, tempfile.NamedTemporaryFile(delete=False) as dst:
        while block := src.read(1 << 22):
            dst.write(block)
    out = np.memmap(dst.name, dtype=kind, mode="r", shape=(n,))
    os.unlink(dst.name)
    return out


class _Writer:
    """Files of one part: keys and value columns side by side."""

    def __init__(self, folder: str, part: int, width: int, kind: str):
        self.kind = kind
        name = f"part-{part:07d}-{TaskContext.get().taskAttemptId()}"
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        self.uri, self.part, self.rows = f"{folder.rstrip('/')}/{name}", part, 0
        self.out = [fs.open_output_stream(f"{path}/{name}.{k}", compression=None) for k in ("keys", *range(width))]

    def add(self, keys: np.ndarray, values: list[np.ndarray]) -> None:
        self.out[0].write(keys.astype(np.int64).tobytes())
        for out, v in zip(self.out[1:], values, strict=True):
            out.write(v.astype(self.kind).tobytes())
        self.rows += len(keys)

    def close(self) -> dict:
        for out in self.out:
            out.close()
        return {"kind": FILE, "key": self.part, "n": self.rows, "path": self.uri}


def _summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Equal neighbours added up."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], [np.add.reduceat(c, first) if len(first) else c for c in columns]


def _grouped(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    return _summed(keys[order], [c[order] for c in columns])


def _batch(**columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values())
    names = [f.split()[0] for f in _STORED.split(", ")]
    kinds = {"kind": pa.int32(), "path": pa.string()}
    arrays = [pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _pair_facts(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What finished pairs say of their contexts, of the words that follow, and of counts of counts."""
    context, word = keys >> 32, keys & 0xFFFFFFFF
    one = [(counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)]
    ctx, (total, n1, n2, n3) = _grouped(context, [counts, *one])
    yield _batch(kind=np.full(len(ctx), CONTEXT, np.int32), key=ctx, a=n1, b=n2, c=n3, n=total)
    follows, (n,) = _grouped(word, [np.ones(len(word), np.int64)])
    yield _batch(kind=np.full(len(follows), FOLLOWS, np.int32), key=follows, d=n)
    levels = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    yield _batch(kind=[LEVEL] * 4, key=[1, 2, 3, 4], n=levels)


def store(rows: DataFrame, values: list[str], folder: str, partitions: int, kind: str = "float64", facts=None) -> DataFrame:
    """Sum ``values`` by (part, key), write each part as sorted arrays, return the files and facts.

    Each task streams its sorted rows; it holds one buffer of them, however large its parts are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, files, waiting, held = None, [], [], 0

        def finished(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal writer, waiting, held
            parts, keys, *columns = (np.concatenate(c) for c in zip(*waiting, strict=True))
            end = len(keys)
            waiting, held = [], 0
            if not last:  # the last key may go on: its sum so far waits
                end -= int(np.count_nonzero((parts == parts[-1]) & (keys == keys[-1])))
                waiting, held = [[parts[end : end + 1], keys[end : end + 1], *(c[end:].sum(keepdims=True) for c in columns)]], 1
            parts, keys, columns = parts[:end], keys[:end], [c[:end] for c in columns]
            cuts = np.concatenate(([0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)])) if len(parts) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if writer is None or writer.part != parts[a]:
                    if writer is not None:
                        files.append(writer.close())
                    writer = _Writer(folder, int(parts[a]), len(columns), kind)
                k, sums = _summed(keys[a:b], [c[a:b] for c in columns])
                writer.add(k, sums)
                if facts is not None:
                    yield from facts(k, sums[0])

        for batch in batches:
            if batch.num_rows:
                waiting.append([batch.column(i).to_numpy() for i in range(batch.num_columns)])
                held += batch.num_rows
            if held >= BUFFER:
                yield from finished(False)
        if waiting:
            yield from finished(True)
        if writer is not None:
            files.append(writer.close())
        if files:
            yield _batch(**{k: [f[k] for f in files] for k in files[0]})

    placed = rows.select("part", "key", *values).repartition(partitions, "part").sortWithinPartitions("part", "key")
    return settled(placed.mapInArrow(run, _STORED))


def _files(stored: DataFrame, parts: int, width: int, kind: str = "float64") -> Sorted:
    found: list[tuple[str | None, int]] = [(None, 0)] * parts
    for r in stored.filter(F.col("kind") == FILE).select("key", "path", "n").toLocalIterator():
        found[r["key"]] = (r["path"], r["n"])
    return Sorted(found, width, kind)


def _power(n: float) -> int:
    return max(0, math.ceil(math.log2(max(1.0, n))))


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    """The part of a 64-bit key: its highest bits."""
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then one end, and where each text begins."""
    buf, begins = textkit.joined(texts)
    starts, ends = textkit.word_spans(buf, textkit.SPACE_WORDS)
    words = textkit.word_hashes(buf, starts, ends).view(np.int64)
    after = np.searchsorted(starts, begins[1:])
    tokens = np.insert(words, after, END)
    return tokens, np.concatenate(([0], after + np.arange(1, len(texts) + 1)))


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that belong to them."""

    vocabulary: Sorted
    vocabulary_bits: int
    pairs: Sorted | None
    pair_bits: int
    words: Sorted | None
    word_bits: int
    tokens: int
    texts: int
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    types: int = 0
    freed: float = 1.0

    @property
    def size(self) -> int:
        return self.vocabulary.rows

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of word hashes."""
        place, (count,) = self.vocabulary.find(_top(hashes, self.vocabulary_bits), hashes)
        return place, count

    def pair_parts(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Parts of pairs, given how often each context occurs; frequent contexts spread by word."""
        fan = np.maximum(1, np.ceil(count / PART_TOKENS)).astype(np.int64)
        return _top(textkit.mix(((context << 20) + word % fan).view(np.uint64)).view(np.int64), self.pair_bits)

    def pair_keys(self, tokens: np.ndarray, begins: np.ndarray):
        """Distinct pairs of a chunk: contexts, words, counts of the contexts, and each token's pair."""
        distinct, back = np.unique(tokens, return_inverse=True)
        ids, counts = self.ids(distinct)
        # the context of a text's first token is the begin mark
        ids, counts = np.append(ids, self.size), np.append(counts, self.texts)
        context = np.empty(len(tokens), dtype=np.int64)
        context[1:] = back[:-1]
        context[begins[:-1]] = len(distinct)
        pairs, where = np.unique(context << 32 | back, return_inverse=True)
        return ids[pairs >> 32], ids[pairs & 0xFFFFFFFF], counts[pairs >> 32], counts[pairs & 0xFFFFFFFF], where

    def log_probabilities(self, tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability under the model and the base, and whether known, of each token."""
        context, word, context_count, word_count, where = self.pair_keys(tokens, begins)
        base = np.log10((word_count + 0.5) / (self.tokens + 0.5 * (self.size + 1)))
        lower = np.full(len(word), self.freed / (self.size + 1))
        p = lower.copy()
        if self.words is not None:
            _, (n1, n2, n3, follows, total) = self._word_facts(context)
            cont = self._word_facts(word)[1][3]
            lower += np.maximum(cont - discount(cont, self.word_discounts), 0) / self.types
            seen = (context >= 0) & (total > 0)
            known = seen & (word >= 0)
            count = np.zeros(len(word))
            parts = self.pair_parts(context[known], word[known], context_count[known])
            count[known] = self.pairs.find(parts, context[known] << 32 | word[known])[1][0]
            d1, d2, d3 = self.pair_discounts
            total = np.where(seen, total, 1)
            freed = np.where(seen, (d1 * n1 + d2 * n2 + d3 * n3) / total, 1.0)
            p = np.maximum(count - discount(count, self.pair_discounts), 0) / total + freed * lower
        return np.log10(p)[where], base[where], (word_count > 0)[where]

    def _word_facts(self, ids: np.ndarray):
        keys = np.maximum(ids, 0)
        place, values = self.words.find(_top(textkit.mix(keys.view(np.uint64)).view(np.int64), self.word_bits), keys)
        return place, [np.where(ids >= 0, v, 0.0) for v in values]


def discount(count: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.where(count <= 0, 0.0, np.where(count == 1, by[0], np.where(count == 2, by[1], by[2])))


def discounts(levels: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many entries occur once to four times.

    Where these are missing (small or odd corpora) a discount is half of the least count it is for.
    """
    n1, n2, _, _ = levels
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k in (1, 2, 3):
        found = k - (k + 1) * y * levels[k] / levels[k - 1] if levels[k - 1] else 0.5 * k
        out.append(found if 0 < found < k else 0.5 * k)
    return tuple(out)


def learn(texts: DataFrame, text_col: str = "text") -> Model:
    """Count a corpus and write the model's arrays below the shared folder."""
    spark = texts.sparkSession
    rows = texts.select(F.col(text_col).alias("text"))
    folder = scratch_path(spark, "lm")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in textkit.chunks(batches, "text", COUNT_CHUNK):
            keys, n = np.unique(_tokens(chunk)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    counted = settled(rows.mapInArrow(count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    tokens, size, texts_n = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("key") == int(END), F.col("n"))), F.lit(0))).first()
    if size >= 1 << 31:
        raise ValueError("a pair key holds two 31-bit word ids; the vocabulary is larger")
    bits = _power(size / PART_WORDS)
    part = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    vocabulary = _files(store(counted.withColumn("part", part), ["n"], f"{folder}/words", 1 << bits), 1 << bits, 1)
    pair_bits = _power(tokens / PART_TOKENS) + 2 if tokens > PART_TOKENS else 0
    model = Model(vocabulary, bits, None, pair_bits, None, _power(size / PART_WORDS), tokens, texts_n)
    if not tokens:
        return model
    shared = spark.sparkContext.broadcast(model)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for _, chunk in textkit.chunks(batches, "text", COUNT_CHUNK):
            found, begins = _tokens(chunk)
            context, word, context_count, _, where = held.pair_keys(found, begins)
            n = np.bincount(where, minlength=len(word))
            parts = held.pair_parts(context, word, context_count).astype(np.int32)
            keys = context << 32 | word
            for at in range(0, len(keys), 100_000):
                end = at + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(parts[at:end]), pa.array(keys[at:end]), pa.array(n[at:end])], names=["part", "key", "n"])

    pairs = store(rows.mapInArrow(count_pairs, "part int, key long, n long"), ["n"], f"{folder}/pairs", max(1, (1 << pair_bits) // 4), "float32", _pair_facts)
    model.pairs = _files(pairs, 1 << pair_bits, 1, "float32")
    levels = dict(pairs.filter(F.col("kind") == LEVEL).groupBy("key").agg(F.sum("n")).collect())
    model.pair_discounts = discounts([levels.get(k, 0) for k in (1, 2, 3, 4)])

    facts = pairs.filter(F.col("kind").isin(CONTEXT, FOLLOWS)).groupBy("key")
    facts = settled(facts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("a", "b", "c", "d", "n")]))
    follows = facts.agg(F.sum("d"), *[F.count(F.when(F.col("d") == k, 1)) for k in (1, 2, 3, 4)], F.count(F.when(F.col("d") > 2, 1))).first()
    model.types = follows[0]
    model.word_discounts = discounts(list(follows[1:5]))
    d1, d2, d3 = model.word_discounts
    model.freed = (d1 * follows[1] + d2 * follows[2] + d3 * follows[5]) / model.types

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bits = shared.value.word_bits
        for batch in batches:
            keys = batch.column(0).to_numpy()
            part = _top(textkit.mix(keys.view(np.uint64)).view(np.int64), word_bits)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], names=["part", "key", "a", "b", "c", "d", "n"])

    placed = facts.select("key", "a", "b", "c", "d", "n").mapInArrow(place, "part int, key long, a long, b long, c long, d long, n long")
    model.words = _files(store(placed, ["a", "b", "c", "d", "n"], f"{folder}/facts", 1 << model.word_bits), 1 << model.word_bits, 5)
    return model


def score(docs: DataFrame, model: Model, text_col: str, carry: list[str]) -> DataFrame:
    """``carry`` with ``n_tokens, n_known, base_score, score`` (log10) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for piece, texts in textkit.chunks(batches, "_text"):
            tokens, begins = _tokens(texts)
            ours, base, known = held.log_probabilities(tokens, begins)
            sums = [np.add.reduceat(x, begins[:-1]) for x in (known.astype(np.int64), base, ours)]
            cols = [*piece.columns[:-1], pa.array(np.diff(begins)), *(pa.array(s) for s in sums)]
            yield pa.RecordBatch.from_arrays(cols, names=[*piece.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
