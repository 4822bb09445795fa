"""Phrases whose words occur together more often than apart, from sorted count streams.

Only phrases that occur often enough matter, and so do all their parts. Words are counted first; the
frequent ones get ids (their place in sorted arrays that workers map into memory, as the language model does),
and the texts are rewritten as runs of ids without the rare words. Pairs are counted over the runs,
then phrases of three to five words along chains of frequent pairs. Each task adds up a few million words
before it passes counts on, so a phrase that makes up a third of the corpus is a few rows.

The counts of all orders then form one stream in prefix order (range-partitioned by the words from
the first on) and one in suffix order (from the last word back). In prefix order the beginnings of
a phrase precede it and its extensions to the right follow it at once; in suffix order the same holds for
its endings and its extensions to the left. So one sequential pass over each stream lines up
all orders with each other: it gives the counts of all left (right) parts and the largest count of an
extension, and never looks anything up by hash. A part whose phrase lies in a later partition is
handed over by a table with at most five rows per partition.

A phrase drops out when an extension by one word occurs as often: a longer phrase that does so holds
such an extension.

Edge cases: a null or empty text has no words; null languages are counted as ``und``; repeated rows count as
often as they occur; texts of any length are read whole; ties in the score go to the more frequent
phrase, then to byte order; only the named columns are read; empty tables give an empty result. Ids
come from 64 bits of a word's hash and are verified with 52 bits of a second one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cyclograin.llm import lm, textkit
from cyclograin.operators.attach import scratch_path, settled

LONGEST = 5
#: words a task adds up before it passes counts on
COUNT_WORDS = 1 << 18
#: words in a row of the encoded texts, about
ROW_WORDS = 1 << 16
CHUNK = 1 << 21
#: phrases in a partition of a stream, about
STREAM_ROWS = 500_000
PART_WORDS = 1 << 20
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
PARTS = range(1, LONGEST)
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_IN_WORD = textkit.byte_table(b" \t" + _BREAKS)
_ENDS_PIECE = ~textkit.byte_table(_BREAKS)
UNKNOWN_LANGUAGE = "und"


def _words(piece: pa.RecordBatch, texts: list[bytes | None]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Words of a chunk (dictionary and codes), language of each word, and whether a piece begins with it."""
    buf, begins = textkit.joined(texts)
    starts, ends = textkit.word_spans(buf, _IN_WORD)
    words = textkit.word_array(buf, starts, ends, _IN_WORD).dictionary_encode()
    langs = piece.column(piece.schema.get_field_index("_lang")).dictionary_encode()
    of_text = langs.indices.to_numpy().astype(np.int64)
    lang = of_text[np.searchsorted(begins, starts, side="right") - 1]
    breaks = np.cumsum(_ENDS_PIECE[buf])[starts] if len(starts) else np.empty(0, np.int64)
    first = np.concatenate(([True], breaks[1:] != breaks[:-1])) if len(starts) else np.empty(0, bool)
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), lang, langs.dictionary.to_pylist(), first


def _names(word: pa.Array, lang_of: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each (language, word)."""
    one = np.empty(len(word), np.int64)
    two = np.empty(len(word))
    seeds = [xxhash.xxh3_64_intdigest(name.encode()) for name in langs]
    for i, (w, code) in enumerate(zip(word.to_pylist(), lang_of.tolist(), strict=True)):
        whole = xxhash.xxh3_128_intdigest(w, seed=seeds[code])
        one[i] = (whole & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
        two[i] = whole >> 76
    return one, two


def count_words(rows: DataFrame) -> DataFrame:
    """``_lang, word, n`` of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in textkit.chunks(batches, "_text", CHUNK):
            word, code, lang, langs, _ = _words(piece, texts)
            keys, n = np.unique(lang * max(1, len(word)) + code, return_counts=True)
            lang, code = np.divmod(keys, max(1, len(word)))
            names = pa.array(langs, pa.string()).take(pa.array(lang))
            yield pa.RecordBatch.from_arrays([names, word.take(pa.array(code)).cast(pa.binary()), pa.array(n)], names=["_lang", "word", "n"])

    return rows.mapInArrow(run, "_lang string, word binary, n long").groupBy("_lang", "word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Frequent words in sorted arrays; a word's id is its place."""

    def __init__(self, frequent: DataFrame, folder: str):
        n = frequent.count()
        self.bits = lm._power(n / PART_WORDS)
        bits = self.bits

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = batch.column(0).dictionary_encode()
                one, two = _names(batch.column(1), langs.indices.to_numpy(), langs.dictionary.to_pylist())
                part = lm._top(one, bits).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(one), pa.array(two)], names=["part", "key", "check"])

        stored = lm.store(frequent.select("_lang", "word").mapInArrow(hashed, "part int, key long, check double"), ["check"], folder, 1 << bits)
        self.words = lm._files(stored, 1 << bits, 1)

    def ids(self, word: pa.Array, lang: np.ndarray, langs: list[str]) -> np.ndarray:
        """Id of each (language, word), -1 where it is not frequent."""
        one, two = _names(word, lang, langs)
        place, (check,) = self.words.find(lm._top(one, self.bits), one)
        return np.where(check == two, place, -1)


def encode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``ids`` of the frequent words in reading order, cut by -1 at rare words and ends of pieces."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kind = "int" if vocabulary.words.rows < 1 << 31 else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, stored = shared.value, np.int32 if kind == "int" else np.int64
        for piece, texts in textkit.chunks(batches, "_text"):
            word, code, lang, langs, first = _words(piece, texts)
            keys, back = np.unique(lang * max(1, len(word)) + code, return_inverse=True)
            of_lang, of_word = np.divmod(keys, max(1, len(word)))
            ids = known.ids(word.take(pa.array(of_word)), of_lang, langs)[back]
            ids = np.insert(ids, np.flatnonzero(first), -1)
            # a word alone between two cuts begins no phrase, and one cut is enough
            cut = ids < 0
            alone = ~cut & np.append(True, cut[:-1]) & np.append(cut[1:], True)
            ids = np.where(alone, -1, ids)
            cut = ids < 0
            ids = np.append(ids[~(cut & np.append(False, cut[:-1]))], -1).astype(stored)
            # rows end at cuts, the first behind each multiple of the wanted length
            cuts = np.flatnonzero(ids < 0)
            ends = cuts[np.searchsorted(cuts, np.append(np.arange(ROW_WORDS, len(ids), ROW_WORDS), len(ids) - 1))] + 1
            places = pa.array(np.unique(np.append(0, ends)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(places, pa.array(ids))], names=["ids"])

    return settled(rows.mapInArrow(run, f"ids array<{kind}>"))


def _long_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The encoded texts of a task in pieces of ``COUNT_WORDS`` words; each ends with a cut."""
    held, size = [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            ids = batch.column(0)[row].values.to_numpy().astype(np.int64)
            while size + len(ids) >= COUNT_WORDS:
                # the next cut after the wanted length, so that no run is split
                rest = ids[max(0, COUNT_WORDS - size) :]
                cuts = np.flatnonzero(rest < 0)[:1]
                end = len(ids) - len(rest) + (int(cuts[0]) + 1 if len(cuts) else len(rest))
                whole, held, size, ids = np.concatenate([*held, ids[:end]]), [], 0, ids[end:]
                yield whole
            if len(ids):
                held.append(ids)
                size += len(ids)
    if held:
        yield np.concatenate(held)


def _emit(columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted phrases in batches; missing words are -1."""
    pad = np.full(len(n), -1, np.int64)
    columns = [*columns, *[pad] * (LONGEST - len(columns)), n.astype(np.int64)]
    for at in range(0, len(n), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=[*WORDS, "f"])


_COUNTED = ", ".join(f"{w} long" for w in [*WORDS, "f"])


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of a pair; a collision only lets a phrase be counted that is not frequent."""
    return textkit.mix(textkit.mix(a.view(np.uint64)) * np.uint64(3) + b.view(np.uint64)).view(np.int64)


def count_pairs(encoded: DataFrame, least: int) -> DataFrame:
    """Pairs that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _long_runs(batches):
            names, code = np.unique(ids, return_inverse=True)
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            keys, n = np.unique(code[both] << 32 | code[both + 1], return_counts=True)
            yield from _emit([names[keys >> 32], names[keys & 0xFFFFFFFF]], n)

    counted = encoded.mapInArrow(run, _COUNTED).groupBy("w1", "w2").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return settled(counted.select("w1", "w2", *[F.lit(-1).cast("long").alias(w) for w in WORDS[2:]], "f"))


def count_longer(encoded: DataFrame, pairs: DataFrame, folder: str, least: int) -> DataFrame:
    """Phrases of three words and more that occur ``least`` times, along chains of frequent pairs."""
    bits = lm._power(pairs.count() / PART_WORDS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pair_key(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            part = lm._top(key, bits).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key), pa.array(np.ones(len(key)))], names=["part", "key", "n"])

    stored = lm.store(pairs.select("w1", "w2").mapInArrow(keyed, "part int, key long, n double"), ["n"], folder, 1 << bits)
    shared = encoded.sparkSession.sparkContext.broadcast(lm._files(stored, 1 << bits, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for ids in _long_runs(batches):
            names, code = np.unique(ids, return_inverse=True)
            at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            keys, back = np.unique(code[at] << 32 | code[at + 1], return_inverse=True)
            key = pair_key(names[keys >> 32], names[keys & 0xFFFFFFFF])
            frequent = known.find(lm._top(key, bits), key)[0] >= 0
            linked = np.zeros(len(ids) + LONGEST, bool)
            linked[at] = frequent[back]
            # a phrase of one word more at a time: number of its beginning, and its last word
            phrase, columns = code.astype(np.int64), [names]
            at = np.arange(len(ids))
            for order in range(2, LONGEST + 1):
                kept = linked[at + order - 2]
                at, phrase = at[kept], phrase[kept]
                if not len(at):
                    break
                keys, phrase, n = np.unique(phrase << 32 | code[at + order - 1], return_inverse=True, return_counts=True)
                columns = [c[keys >> 32] for c in columns] + [names[keys & 0xFFFFFFFF]]
                if order > 2:
                    yield from _emit(columns, n)

    counted = encoded.mapInArrow(run, _COUNTED).groupBy(*WORDS).agg(F.sum("f").alias("f"))
    return settled(counted.filter(F.col("f") >= least))


def lined_up(stream: DataFrame, backwards: bool, partitions: int) -> DataFrame:
    """One pass over the counts in prefix (suffix) order.

    Adds ``p1`` to ``p4``, the counts of the phrase's first (last) 1 to 4 words where shorter than itself,
    and raises ``extended`` to the largest count of the phrase with one word more behind (before) it.
    """
    spark = stream.sparkSession
    carried = [c for c in stream.columns if c not in (*WORDS, "f", "extended")]
    # the order in which words are compared; the words that are not there come first
    size = sum((F.col(w) >= 0).cast("int") for w in WORDS)
    reading = F.array(*WORDS)
    if backwards:
        reading = F.concat(F.reverse(F.slice(reading, 1, size)), F.array_repeat(F.lit(-1).cast("long"), F.lit(LONGEST) - size))
    keys = [f"k{i}" for i in range(1, LONGEST + 1)]
    rows = stream.withColumn("_reading", reading).select(*[F.col("_reading")[i].alias(k) for i, k in enumerate(keys)], "f", "extended", *carried)
    placed = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    schema, columns_in = T.StructType(rows.schema.fields), rows.columns
    for name in [f"p{j}" for j in PARTS]:
        schema = schema.add(name, "long")
    schema = schema.add("part", "long").add("edge", "long")
    names_out = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        part = TaskContext.get().partitionId()
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        words = np.stack([table.column(k).to_numpy() for k in keys])
        f, extended = table.column("f").to_numpy(), table.column("extended").to_numpy().copy()
        n, order = len(f), (words >= 0).sum(axis=0)
        row = np.arange(n)
        # the last phrase of each order up to each row: it is the beginning of all longer ones that follow
        last = {j: np.maximum.accumulate(np.where(order == j, row, -1)) for j in range(1, LONGEST + 1)}
        parts, above = [], np.full(n, -1)
        for j in PARTS:
            longer = order > j
            parts.append(pa.array(np.where(last[j] >= 0, f[last[j]], 0), mask=~longer | (last[j] < 0)))
            np.copyto(above, last[j], where=order == j + 1)
        child = np.flatnonzero(above >= 0)
        np.maximum.at(extended, above[child], f[child])
        where = pa.array(np.full(n, part, np.int64))
        columns = [table.column(c).combine_chunks() for c in columns_in]
        columns[columns_in.index("extended")] = pa.array(extended)
        yield from pa.Table.from_arrays([*columns, *parts, where, pa.nulls(n, pa.int64())], names=names_out).to_batches(100_000)
        # what goes over the partition's borders: its last phrase of each order, and its largest
        # extension of a phrase of each order that lies before it
        edges = [(*words[:, last[j][-1]].tolist(), int(f[last[j][-1]]), 0, j) for j in PARTS if last[j][-1] >= 0]
        for j in PARTS:
            orphans = f[(order == j + 1) & (last[j] < 0)]
            if len(orphans):
                edges.append((*[-1] * LONGEST, 0, int(orphans.max()), j))
        if edges:
            facts = dict(zip([*keys, "f", "extended", "edge"], zip(*edges, strict=True), strict=True))
            facts["part"] = [part] * len(edges)
            arrow = {c: table.schema.field(c).type for c in columns_in}
            yield pa.RecordBatch.from_arrays(
                [pa.array(facts[c], arrow.get(c, pa.int64())) if c in facts else pa.nulls(len(edges), arrow.get(c, pa.int64())) for c in names_out],
                names=names_out,
            )

    walked = settled(placed.mapInArrow(run, schema))
    out = walked.filter(F.col("edge").isNull()).drop("edge")
    opened, late = _borders(walked.filter(F.col("edge").isNotNull()).orderBy("part").toLocalIterator(), partitions, keys)
    if opened:
        before = spark.createDataFrame(opened, "part long, " + ", ".join(f"b{j} long" for j in PARTS))
        out = out.join(F.broadcast(before), "part", "left")
        order = sum((F.col(k) >= 0).cast("int") for k in keys)
        out = out.withColumns({f"p{j}": F.when(order > j, F.coalesce(f"p{j}", f"b{j}")) for j in PARTS}).drop(*[f"b{j}" for j in PARTS])
    if late:
        more = spark.createDataFrame(late, ", ".join(f"{k} long" for k in [*keys, "late"]))
        out = out.join(F.broadcast(more), keys, "left").withColumn("extended", F.greatest("extended", "late")).drop("late")
    size = sum((F.col(k) >= 0).cast("int") for k in keys)
    reading = F.array(*keys)
    if backwards:
        reading = F.concat(F.reverse(F.slice(reading, 1, size)), F.array_repeat(F.lit(-1).cast("long"), F.lit(LONGEST) - size))
    out = out.withColumn("_reading", reading)
    return out.select(*[F.col("_reading")[i].alias(w) for i, w in enumerate(WORDS)], "f", "extended", *carried, *[f"p{j}" for j in PARTS])


def _borders(edges, partitions: int, keys: list[str]) -> tuple[list[tuple], list[tuple]]:
    """Counts open at the start of each partition, and extensions that a phrase has in later partitions."""
    by_part: dict[int, list] = {}
    for e in edges:
        by_part.setdefault(e["part"], []).append(e)
    open_now: dict[int, tuple] = {}
    opened, late = [], {}
    for part in sorted(by_part):
        opened.append((part, *[open_now[j][1] if j in open_now else None for j in PARTS]))
        for e in by_part[part]:
            if e["extended"]:
                phrase = open_now[e["edge"]][0]
                late[phrase] = max(late.get(phrase, 0), e["extended"])
        for e in by_part[part]:
            if e["f"]:
                open_now[e["edge"]] = (tuple(e[k] for k in keys), e["f"])
    return opened if len(opened) > 1 else [], [(*k, v) for k, v in late.items()]


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of phrases of two to five words occurring ``least`` times.

    ``top`` keeps that many per language by score; without it all phrases that no equally
    frequent longer one contains are returned.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("_text"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN_LANGUAGE)).alias("_lang"))
    folder = scratch_path(spark, "phrases")
    counted = settled(count_words(rows))
    totals = counted.groupBy("_lang").agg(F.sum("n").alias("n"))
    frequent = counted.filter(F.col("n") >= least)
    vocabulary = Vocabulary(frequent, f"{folder}/words")
    named = settled(_with_ids(spark, frequent, vocabulary))
    encoded = encode(rows, vocabulary)
    pairs = count_pairs(encoded, least)
    longer = count_longer(encoded, pairs, f"{folder}/pairs", least)
    single = named.select(F.col("id").alias("w1"), *[F.lit(-1).cast("long").alias(w) for w in WORDS[1:]], F.col("n").alias("f"))
    stream = settled(single.unionByName(pairs).unionByName(longer).withColumn("extended", F.lit(0).cast("long")))
    partitions = max(1, -(-stream.count() // STREAM_ROWS))
    left = lined_up(stream, False, partitions).withColumnsRenamed({f"p{j}": f"left{j}" for j in PARTS})
    both = lined_up(left, True, partitions)
    langs = named.select(F.col("id").alias("w1"), "_lang").join(F.broadcast(totals), "_lang")
    found = both.filter((F.col("w2") >= 0) & (F.col("extended") < F.col("f"))).join(langs, "w1")
    return _ranked(found, named, top)


def _with_ids(spark: SparkSession, frequent: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            ids = shared.value.ids(batch.column(1), langs.indices.to_numpy(), langs.dictionary.to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=["_lang", "word", "n", "id"])

    return frequent.select("_lang", "word", "n").mapInArrow(run, "_lang string, word binary, n long, id long")


def _ranked(found: DataFrame, named: DataFrame, top: int | None) -> DataFrame:
    """Score of the weakest cut, words in place of ids, and ranks within languages."""
    order = sum((F.col(w) >= 0).cast("int") for w in WORDS)

    cuts = []
    for k in PARTS:
        right = F.element_at(F.array(*[f"p{j}" for j in PARTS]), order - k)
        # decimals hold 38 digits, and the quotient is below 1000 * n / a
        value = F.expr(f"(cast(1000 as decimal(4,0)) * cast(f as decimal(15,0)) * cast(n as decimal(19,0))) div (cast(left{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)))")
        cuts.append((k, right, value))
    found = found.withColumns({f"r{k}": F.when(order > k, right) for k, right, _ in cuts})
    found = found.withColumn("best", F.least(*[F.when(order > k, F.struct(v.alias("score"), F.lit(k).alias("k"), F.col(f"left{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k, _, v in cuts]))
    found = found.select("_lang", "n", F.col("f").alias("a"), "best.score", "best.l", "best.r", F.array(*WORDS).alias("ids"))
    if top is not None:
        # ties at the limit stay until their words are known
        by_count = Window.partitionBy("_lang").orderBy(F.col("score").desc(), F.col("a").desc())
        found = found.withColumn("_place", F.rank().over(by_count)).filter(F.col("_place") <= top).drop("_place")
    spread = found.select("*", F.posexplode("ids").alias("_at", "id")).filter(F.col("id") >= 0)
    texts = spread.join(named.select("id", F.col("word").cast("string").alias("word")), "id")
    keys = ["_lang", "ids", "n", "a", "score", "l", "r"]
    phrase = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda s: s["word"]))
    phrases = texts.groupBy(*keys).agg(phrase.alias("phrase"))
    best = Window.partitionBy("_lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = phrases.withColumn("rank", F.row_number().over(best).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select(F.col("_lang").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
