"""Neighbour index for many dimensions: a forest of partition trees, written once and searched by leaf.

In many dimensions the triangle inequality rules out little and an exact search compares nearly all pairs.
The index gives that up: every tree halves space by planes between the two centres of a node's rows, each row
lies in one leaf per tree, and a query reads only its leaves (and, per tree, the leaves across its narrowest
planes). What is read is ranked by true distances, so only completeness is approximate; :func:`recall` measures it
against the exact search of :mod:`neighbors`, which stays the way to full results.

Trees are fitted on a bounded sample (``SAMPLE_ROWS``, by hash of the ids); every row is indexed. Planes and the leaves'
sizes are all that is broadcast: ``2 ** depth`` per tree with ``depth`` at most ``MAX_DEPTH``. Leaves are stored as blocks
of at most ``BLOCK_ROWS`` rows and queries meet a leaf block by block, so a leaf that holds a third
of the table (many copies of one vector) is many small tasks' work.

Every tree holds every row, so the index is the largest table. Map tasks pack and write it without an exchange.
An index for at most ``k`` neighbours stores of exact copies only those with the smallest ids that some query can
find among its ``k``; an excluded value that is the id itself is not stored beside it.

Rows whose vector is NULL, of another length than the first sampled one, or with NULL or non-finite parts are neither
indexed nor answered. Equal distances go to the smaller id. Repeated ids count as one neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin.functions import hash_key
from cyclograin.operators.attach import settled
from cyclograin.operators.neighbors import _thin_copies, nearest_rows
from cyclograin.operators.ranks import top_n

SAMPLE_ROWS = 1 << 16
MAX_DEPTH = 12
BLOCK_ROWS = 1024
QUERY_ROWS = 512
#: bytes of rows that a task packs together
PACK_BYTES = 64 << 20


@dataclass
class Tree:
    """Planes level by level: normal and offset of every node; the leaf's number is the path."""

    normals: list[np.ndarray]
    offsets: list[np.ndarray]

    @classmethod
    def fitted(cls, rows: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
        normals, offsets = [], []
        groups = [np.arange(len(rows))]
        for _ in range(depth):
            w, t, halves = np.zeros((len(groups), rows.shape[1])), np.zeros(len(groups)), []
            for i, g in enumerate(groups):
                if len(g) > 1:
                    a, b = rows[rng.choice(g, 2, replace=False)]
                    for _ in range(2):  # two steps towards the centres of two halves
                        near = rows[g] @ (a - b) > (a @ a - b @ b) / 2
                        if near.all() or not near.any():
                            break
                        a, b = rows[g[near]].mean(axis=0), rows[g[~near]].mean(axis=0)
                    w[i] = a - b
                    t[i] = np.median(rows[g] @ w[i])
                right = rows[g] @ w[i] > t[i]
                halves += [g[~right], g[right]]
            normals.append(w)
            offsets.append(t)
            groups = halves
        return cls(normals, offsets)

    def leaves(self, rows: np.ndarray, probes: int = 0) -> np.ndarray:
        """Leaf of each row, then those reached by crossing its ``probes`` narrowest planes: one column each."""
        n, depth = len(rows), len(self.normals)
        path, margins = np.zeros((n, depth + 1), np.int64), np.full((n, depth), np.inf)
        for level in range(depth):
            path[:, level + 1], margins[:, level] = self._step(rows, path[:, level], level)
        out = [path[:, -1]]
        order = np.argsort(margins, axis=1, kind="stable")
        for j in range(min(probes, depth)):
            turn = order[:, j]
            node = np.zeros(n, np.int64)
            for level in range(depth):
                there, _ = self._step(rows, node, level)
                node = np.where(level < turn, path[:, level + 1], np.where(level == turn, path[np.arange(n), turn + 1] ^ 1, there))
            out.append(node)
        return np.stack(out, axis=1)

    def _step(self, rows: np.ndarray, node: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        w = self.normals[level][node]
        gap = np.einsum("ij,ij->i", rows, w) - self.offsets[level][node]
        size = np.sqrt(np.einsum("ij,ij->i", w, w))
        return 2 * node + (gap > 0), np.where(size > 0, np.abs(gap) / np.where(size > 0, size, 1), np.inf)


@dataclass
class Forest:
    """The trees, the written table of leaf blocks and that of the leaves' sizes."""

    trees: list[Tree]
    blocks: DataFrame
    sizes: DataFrame
    width: int
    rows: int
    k: int | None


def _clean(df: DataFrame, id_col: str, vec: str, exclude: str | None) -> DataFrame:
    v = F.col(vec).cast(T.ArrayType(T.DoubleType()))
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = F.col(exclude).cast("string") if exclude else F.lit(None).cast("string")
    return df.select(F.col(id_col).alias("id"), v.alias("vec"), x.alias("ex")).filter(good)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0))


def build(
    pool: DataFrame, id_col: str = "id", vec: str = "vec", exclude: str | None = None, n_trees: int = 12,
    leaf_rows: int = 64, seed: int = 0, k: int | None = None,
) -> Forest:
    """Fit the trees on a sample and write every row of the pool into its leaf of each tree.

    ``k`` is the most neighbours that will be searched for, where that is known.
    """
    spark = pool.sparkSession
    p = _clean(pool, id_col, vec, exclude)
    if k is not None:
        p = _thin_copies(p, "vec", "id", None if exclude is None else "id" if exclude == id_col else "ex", k)
    if exclude == id_col and isinstance(p.schema["id"].dataType, (T.StringType, T.IntegralType)):
        p = p.drop("ex")  # read from the id
    p = settled(p)
    n = p.count()
    sample = p.select("vec").orderBy(hash_key(seed, "forest", "id")).limit(SAMPLE_ROWS).collect()
    width = len(sample[0]["vec"]) if sample else 0
    rows = np.array([r["vec"] for r in sample if len(r["vec"]) == width], dtype=float).reshape(-1, max(1, width))
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n / leaf_rows)))), max(0, int(math.log2(max(1, len(rows)))) - 1))
    trees = [Tree.fitted(rows, depth, np.random.default_rng([seed, i])) for i in range(n_trees)]
    shared = spark.sparkContext.broadcast(trees)
    p = p.filter(F.size("vec") == width)
    # the rows are routed twice rather than written once more per tree
    sizes = settled(_leaf_sizes(p, shared).groupBy("tree", "leaf").agg(F.sum("n").alias("n")).withColumn("n_blocks", F.ceil(F.col("n") / BLOCK_ROWS)))
    n_blocks = np.zeros((n_trees, 1 << depth), np.int64)
    for r in sizes.collect():
        n_blocks[r["tree"], r["leaf"]] = r["n_blocks"]
    return Forest(trees, settled(_leaf_blocks(p, shared, spark.sparkContext.broadcast(n_blocks))), sizes, width, n, k)


def _leaf_sizes(rows: DataFrame, shared) -> DataFrame:
    """Rows of every leaf, one number per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [np.zeros(1 << len(tree.normals), np.int64) for tree in shared.value]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                for size, tree in zip(sizes, shared.value, strict=True):
                    size += np.bincount(tree.leaves(x)[:, 0], minlength=len(size))
        for t, size in enumerate(sizes):
            leaf = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf), pa.array(size[leaf])], names=["tree", "leaf", "n"])

    return rows.select("vec").mapInArrow(run, "tree int, leaf long, n long")


def _leaf_blocks(rows: DataFrame, shared, n_blocks) -> DataFrame:
    """The rows of every leaf in blocks: each task packs those it has, and the blocks of a leaf are dealt to its numbers in turn."""
    own = "ex" not in rows.columns
    kind = rows.schema["id"].dataType
    schema = T.StructType().add("tree", "integer").add("leaf", "long").add("block", "long").add("p_ids", T.ArrayType(kind))
    if not own:
        schema = schema.add("p_ex", T.ArrayType(T.StringType()))
    schema = schema.add("p_vecs", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        turn = np.random.default_rng(TaskContext.get().partitionId()).integers(1 << 30)

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            columns = {c: table.column(c).combine_chunks() for c in table.column_names}
            x = _matrix(columns.pop("vec"))
            for t, tree in enumerate(shared.value):
                leaf = tree.leaves(x)[:, 0]
                order = np.argsort(leaf, kind="stable")
                leaf = leaf[order]
                first = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
                begin = np.repeat(first, np.diff(np.append(first, len(leaf))))
                starts = np.flatnonzero((np.arange(len(leaf)) - begin) % BLOCK_ROWS == 0)
                cuts = np.append(starts, len(leaf))
                turn += 1
                block = (turn + np.arange(len(starts))) % n_blocks.value[t, leaf[starts]]
                lists = [pa.array(np.full(len(starts), t, np.int32)), pa.array(leaf[starts]), pa.array(block)]
                lists += [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), c.take(pa.array(order))) for c in columns.values()]
                lists.append(pa.ListArray.from_arrays(pa.array(cuts * x.shape[1], pa.int32()), pa.array(x[order].ravel())))
                whole = pa.RecordBatch.from_arrays(lists, names=schema.names)
                for at in range(0, len(starts), 256):
                    yield whole.slice(at, 256)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= PACK_BYTES:
                yield from packed()
        if held:
            yield from packed()

    return rows.select("id", *([] if own else ["ex"]), "vec").mapInArrow(run, schema)


def _routed(rows: DataFrame, shared, probes: int) -> DataFrame:
    """One row per tree and leaf for every vector."""
    schema = T.StructType().add("tree", "integer").add("leaf", "long")
    schema = T.StructType([*schema.fields, *rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            for t, tree in enumerate(shared.value):
                leaves = tree.leaves(x, probes)
                at, leaf = np.repeat(np.arange(len(x)), leaves.shape[1]), leaves.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), t, np.int32)), pa.array(leaf), *batch.take(pa.array(at)).columns],
                    names=["tree", "leaf", *batch.schema.names],
                )

    return rows.mapInArrow(run, schema).distinct() if probes else rows.mapInArrow(run, schema)


def _packed(routed: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows of a leaf in numbered blocks: arrays of ids and exclusion values, and one array of all vectors."""
    routed = settled(routed)
    counts = routed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / size).alias("n_blocks"))
    d = routed.join(counts, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")))
    return d.groupBy("tree", "leaf", "block", "n_blocks").agg(
        F.collect_list("id").alias(f"{prefix}_ids"),
        F.collect_list(F.coalesce("ex", F.lit(""))).alias(f"{prefix}_ex"),
        F.collect_list(F.col("ex").isNull()).alias(f"{prefix}_none"),
        F.flatten(F.collect_list("vec")).alias(f"{prefix}_vecs"),
    )


def search(
    forest: Forest, queries: DataFrame, k: int, id_col: str = "id", vec: str = "vec", exclude: str | None = None, probes: int = 2
) -> DataFrame:
    """The k nearest rows in the leaves that each query reads: (id, neighbor, dist, rank).

    ``exclude`` must have been named for the index too; rows with the same known value are no neighbours.
    """
    if forest.k is not None and k > forest.k:
        raise ValueError(f"the index was built for at most {forest.k} neighbours")
    pairs = routed_pairs(forest, queries, id_col, vec, exclude, probes)
    kinds = queries.schema[id_col].dataType, forest.blocks.schema["p_ids"].dataType.elementType
    schema = T.StructType().add("id", kinds[0]).add("neighbor", kinds[1]).add("dist", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                q_ids, q_ex, q_none, q_vecs, p_ids, p_vecs = (
                    batch.column(names.index(c))[i].values for c in ("q_ids", "q_ex", "q_none", "q_vecs", "p_ids", "p_vecs")
                )
                p_ex = batch.column(names.index("p_ex"))[i].values if "p_ex" in names else p_ids.cast(pa.string())
                ids = p_ids.take(order := pc.sort_indices(p_ids))
                order = order.to_numpy()
                # known values to bar by as whole numbers; an unknown one bars nothing
                p_none = p_ex.is_null().to_numpy(zero_copy_only=False)
                both = pa.chunked_array([q_ex, p_ex.fill_null("")]).dictionary_encode().combine_chunks().indices.to_numpy(zero_copy_only=False)
                q_key, p_key = both[: len(q_ids)].astype(np.int64), both[len(q_ids) :].astype(np.int64)
                q_key[q_none.to_numpy(zero_copy_only=False)] = -1
                p_key[p_none] = -2
                at, best, dist = nearest_rows(
                    q_vecs.to_numpy().reshape(len(q_ids), -1), p_vecs.to_numpy().reshape(len(p_ids), -1)[order], k, q_key, p_key[order]
                )
                yield pa.RecordBatch.from_arrays(
                    [q_ids.take(pa.array(at)), ids.take(pa.array(best)), pa.array(dist)], names=["id", "neighbor", "dist"]
                )

    found = pairs.mapInArrow(run, schema).groupBy("id", "neighbor").agg(F.min("dist").alias("dist"))
    return top_n(found, ["id"], [F.col("dist"), F.col("neighbor")], k)


def routed_pairs(
    forest: Forest, queries: DataFrame, id_col: str = "id", vec: str = "vec", exclude: str | None = None, probes: int = 2
) -> DataFrame:
    """Blocks of queries beside the blocks of the leaves they read."""
    q = _clean(queries, id_col, vec, exclude).filter(F.size("vec") == forest.width)
    shared = queries.sparkSession.sparkContext.broadcast(forest.trees)
    q_blocks = _packed(_routed(q, shared, probes), QUERY_ROWS, "q").drop("n_blocks").withColumnRenamed("block", "q_block")
    spread = q_blocks.join(forest.sizes.drop("n"), ["tree", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    # planning takes the spread queries for no larger than those of one block
    return spread.drop("n_blocks").hint("merge").join(forest.blocks, ["tree", "leaf", "block"])


def routed_share(
    forest: Forest, queries: DataFrame, id_col: str = "id", vec: str = "vec", exclude: str | None = None, probes: int = 2
) -> DataFrame:
    """``share``: distance computations over all pairs of queries and indexed rows."""
    n_q = queries.agg(F.count(F.lit(1)).alias("n"))
    q = _clean(queries, id_col, vec, exclude).filter(F.size("vec") == forest.width)
    asked = _routed(q, queries.sparkSession.sparkContext.broadcast(forest.trees), probes).groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("q"))
    work = asked.join(forest.sizes, ["tree", "leaf"]).agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0)).alias("w"))
    return work.crossJoin(F.broadcast(n_q)).select(F.try_divide(F.col("w"), F.col("n") * forest.rows).alias("share"))


def recall(found: DataFrame, exact: DataFrame, ids: Sequence[str] = ("id", "neighbor")) -> DataFrame:
    """``recall``: share of the exact neighbours that were found."""
    got = exact.select(*ids).join(found.select(*ids).withColumn("hit", F.lit(1)), list(ids), "left")
    return got.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
