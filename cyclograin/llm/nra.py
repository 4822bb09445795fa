"""Ranked lexical search by sequential reads of impact-sorted lists (no random access).

Documents are indexed in segments of a few megabytes of text. A segment holds, for every term of
the query set, its documents sorted by falling impact. A search reads the lists of its terms in
step, each step twice as deep as the last, and keeps for every document an interval: what its
seen postings add up to, and that plus what the unread part of each list where it has not been
seen could still add (the impact next to be read). A document leaves when its upper end falls
below the k-th best lower end; none enters once all unread parts together stay below it. Reading
goes on until every document left has lower and upper end equal, so membership, ties and scores
are exact. What a task has found so far in earlier segments is the floor of the next one, and
only k rows per query leave a task.

Nothing depends on how often a term occurs: a list is cut by segments, and a segment is bounded by
text. The query set is worked off in blocks of a bounded number of terms, which are what is broadcast;
each block reads all documents once. The index is written to the shared folder.

Edge cases: a null or empty text has no terms and is never found; it counts neither in N nor in L. A
query without terms, or without a document scoring above 0, returns no row. Repeated documents rank one by
one (equal scores by ascending id, null ids last); repeated queries are answered each. A text longer
than a segment is a segment of its own. Only the named columns are read; other columns may have any name.
An empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cyclograin.llm import textkit
from cyclograin.operators.attach import settled

SEGMENT_BYTES = 1 << 24
#: term occurrences of the queries that are searched together
BLOCK_TERMS = 200_000
FIRST_DEPTH = 128


def terms_of(text: str | None) -> list[bytes]:
    """Terms of one text in reading order: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    buf, _ = textkit.joined([(text or "").encode()])
    starts, ends = textkit.word_spans(buf, textkit.ALNUM_WORDS)
    return textkit.word_array(buf, starts, ends, textkit.ALNUM_WORDS).to_pylist()


def query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, Counter]]]:
    """The query set in blocks of at most ``BLOCK_TERMS`` term occurrences, one query at least."""
    block, held = [], 0
    for row in queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        terms = Counter(terms_of(row["text"]))
        if not terms:
            continue
        if block and held + len(terms) > BLOCK_TERMS:
            yield block
            block, held = [], 0
        block.append((row["id"], terms))
        held += len(terms)
    if block:
        yield block


def index(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """Segments: ids and term counts of their documents, and (document, term, occurrences) of the vocabulary."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType().add("ids", T.ArrayType(rows.schema["_id"].dataType)).add("n", T.ArrayType(T.LongType()))
    for name in ("doc", "term", "tf"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    known = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(known.value, pa.large_binary())

        def segment(ids: list[pa.Array], texts: list[bytes | None]) -> pa.RecordBatch:
            buf, begins = textkit.joined(texts)
            starts, ends = textkit.word_spans(buf, textkit.ALNUM_WORDS)
            cuts = np.searchsorted(starts, begins)
            found = pc.index_in(textkit.word_array(buf, starts, ends, textkit.ALNUM_WORDS), value_set=value_set)
            hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            term = found.fill_null(-1).to_numpy()[hit].astype(np.int64)
            owner = np.searchsorted(cuts, hit, side="right") - 1
            pairs, tf = np.unique(owner * len(value_set) + term, return_counts=True)
            lists = [np.diff(cuts), (pairs // len(value_set)).astype(np.int32), (pairs % len(value_set)).astype(np.int32), tf.astype(np.int32)]
            columns = [pa.concat_arrays(ids), *map(pa.array, lists)]
            wrapped = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            return pa.RecordBatch.from_arrays(wrapped, names=schema.names)

        ids, texts, held = [], [], 0
        for piece, chunk in textkit.chunks(batches, "_text"):
            size = sum(len(t or b"") for t in chunk)
            if texts and held + size > SEGMENT_BYTES:
                yield segment(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(piece.column(0))
            texts.extend(chunk)
            held += size
        if texts:
            yield segment(ids, texts)

    return settled(rows.mapInArrow(run, schema))


def collection_facts(segments: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, occurrences of all terms, and documents holding each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, total, df = 0, 0, np.zeros(n_terms, np.int64)
        for batch in batches:
            n = batch.column(0).flatten().to_numpy()
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(df)
        keys = np.concatenate(([-2, -1], held))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(([docs, total], df[held])))], names=["key", "n"])

    sums = segments.select("n", "term").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = {r["key"]: r["n"] for r in sums.toLocalIterator()}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(n_terms)], dtype=np.int64)


@dataclass
class Lists:
    """Impact-sorted lists of one segment."""

    docs: np.ndarray
    impacts: np.ndarray
    starts: np.ndarray
    size: int


def impact_lists(n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int, n_docs: int, total: int) -> Lists:
    lengths, back = np.unique(n, return_inverse=True)
    # Python integers: 75 * n * N may pass 64 bits
    m = np.array([100 - 75 + 75 * int(x) * n_docs // max(total, 1) for x in lengths], dtype=np.int64)[back]
    tf = tf.astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    order = np.lexsort((-impact, term))
    return Lists(doc[order], impact[order], np.searchsorted(term[order], np.arange(n_terms + 1)), len(n))


def resolve(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the k best, with exact scores; all others score below ``floor`` or the k-th.

    ``floor`` is a score that k documents elsewhere are known to reach. Ties with the k-th stay.
    """
    at, end = lists.starts[terms].copy(), lists.starts[terms + 1]
    lower = np.zeros(lists.size, np.int64)
    seen = np.zeros((lists.size, len(terms)), bool)
    live = np.ones(lists.size, bool)
    entering, depth = True, FIRST_DEPTH
    while True:
        for i in np.flatnonzero(at < end).tolist():
            stop = min(at[i] + depth, end[i])
            docs, impacts = lists.docs[at[i] : stop], lists.impacts[at[i] : stop]
            keep = live[docs]
            docs = docs[keep]
            lower[docs] += weights[i] * impacts[keep]
            seen[docs, i] = True
            at[i] = stop
        unread = at < end
        frontier = np.where(unread, weights * lists.impacts[np.minimum(at, max(len(lists.impacts) - 1, 0))], 0) if len(lists.impacts) else np.zeros(len(terms), np.int64)
        rest = int(frontier.sum())
        held = np.flatnonzero(live & (lower > 0)) if entering else np.flatnonzero(live)
        low = lower[held]
        if len(held) >= k:
            floor = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]))
        upper = low + rest - seen[held] @ frontier
        keep = upper >= floor
        if rest < floor or not rest:
            entering = False
            live[:] = False
            live[held[keep]] = True
        else:
            live[held[~keep]] = False
        held, open_ends = held[keep], (upper > low)[keep]
        if not entering and not open_ends.any():
            return held, lower[held]
        depth *= 2


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``query_id, rank, doc_id, score``: the k best documents above 0 of every query."""
    spark = docs.sparkSession
    kinds = queries.schema[query_id].dataType, docs.schema[doc_id].dataType
    names = ["query", "query_id", "doc_id", "score"]
    schema = T.StructType().add("query", "integer").add("query_id", kinds[0]).add("doc_id", kinds[1]).add("score", "long")
    parts = []
    for block in query_blocks(queries, query_id, text_col):
        vocabulary = sorted(set().union(*(t for _, t in block)))
        place = {t: i for i, t in enumerate(vocabulary)}
        segments = index(docs, vocabulary, doc_id, text_col)
        n_docs, total, df = collection_facts(segments, len(vocabulary))
        w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df]
        plans = []
        for key, terms in block:
            weighted = sorted(((n * w[place[t]], place[t]) for t, n in terms.items()), reverse=True)
            weighted = [(v, t) for v, t in weighted if v > 0]
            plans.append((key, np.array([t for _, t in weighted], np.int64), np.array([v for v, _ in weighted], np.int64)))
        shared = spark.sparkContext.broadcast((plans, len(vocabulary), n_docs, total))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            plans, n_terms, n_docs, total = shared.value
            best: list[list] = [[] for _ in plans]
            for batch in batches:
                for row in range(batch.num_rows):
                    ids, n, doc, term, tf = (batch.column(c)[row].values for c in range(5))
                    lists = impact_lists(n.to_numpy(), doc.to_numpy(), term.to_numpy(), tf.to_numpy(), n_terms, n_docs, total)
                    names_of = ids.to_pylist()
                    for q, (_, terms, weights) in enumerate(plans):
                        floor = best[q][-1][0] if len(best[q]) >= k else 1
                        found, scores = resolve(lists, terms, weights, k, floor)
                        if len(found):
                            merged = best[q] + [(s, names_of[d]) for d, s in zip(found.tolist(), scores.tolist(), strict=True)]
                            best[q] = sorted(merged, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[:k]
            out = [(q, plans[q][0], d, s) for q, rows in enumerate(best) for s, d in rows]
            if out:
                kinds = [f.type for f in pa_schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        pa_schema = _arrow(schema)
        best = segments.mapInArrow(run, schema)
        w_best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        parts.append(settled(best.withColumn("rank", F.row_number().over(w_best)).filter(F.col("rank") <= k).drop("query")))
    out = parts[0] if parts else spark.createDataFrame([], schema.add("rank", "integer")).drop("query")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("query_id").alias(query_id), "rank", F.col("doc_id").alias(doc_id), "score")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
