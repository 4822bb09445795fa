"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors of the same label are normalised; each table quantises Gaussian projections of them and
joins the cells into one bucket number. Buckets with company are compared exactly: cosine in
double precision from blocks of bounded size, whatever the bucket's size. A pair that meets
in several tables counts in the first one only, so numbers of links need no table of pairs, and
a block hands on one link per vector and component instead of all its links.

At cosine 0.98 two normalised vectors lie 0.2 apart; one projection keeps them together with
probability 0.867, twelve with 0.18, and 32 tables find the pair with probability 0.998 (more
for closer pairs).

Exact copies (equal label and components) are one class; only one of them is compared, and each
copy counts as a link of the others.

Edge cases: null or empty vectors, zero vectors, vectors with null or non-finite components and
vectors without a label link with nothing and are kept; vectors of different length never
link; rows that share an id count as one vector in the components; rows with a null id link with
nothing, have a null component and are kept. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclograin.llm.components import components
from cyclograin.operators.attach import settled

COSINE = 0.98
TABLES = 32
PROJECTIONS = 12
WIDTH = 1.2
SEED = 20
#: vectors of one bucket that are compared in one step with as many others
BLOCK = 1024
_HASHED = "bucket long, tab int, rep long"
_FOUND = "a long, b long, n long"


class Hashing:
    """The bucket numbers of normalised vectors in every table."""

    def __init__(self, dims: int, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng([seed, dims])
        self.lines = rng.standard_normal((dims, tables * projections)) / width
        self.shift = rng.random(tables * projections)
        self.mix = rng.integers(1, 1 << 62, size=projections, dtype=np.int64) | 1
        self.salt = rng.integers(1, 1 << 62, size=tables, dtype=np.int64)
        self.shape = (tables, projections)

    def buckets(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        cells = np.floor(unit @ self.lines + self.shift).astype(np.int64).reshape(len(unit), *self.shape)
        with np.errstate(over="ignore"):
            return (cells * self.mix).sum(axis=2) + self.salt + label[:, None] * np.int64(0x9E3779B97F4A7C1)


def _unit(rows: np.ndarray) -> np.ndarray:
    # scaled first, so that neither very large nor very small components leave the range
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _by_width(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    sizes = np.diff(vectors.offsets.to_numpy())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.array(vectors.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), size)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: dict[int, Hashing] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            rep, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, matrix in _by_width(batch.column(2)):
                dims = matrix.shape[1]
                hashing = made.setdefault(dims, Hashing(dims))
                buckets = hashing.buckets(_unit(matrix), label[rows])
                tab = np.tile(np.arange(TABLES, dtype=np.int32), len(rows))
                cols = [pa.array(buckets.ravel()), pa.array(tab), pa.array(np.repeat(rep[rows], TABLES))]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "tab", "rep"])


def _compare_group(rep, mult, label, unit, block, tab, same_block: bool, hashing: Hashing, least: float):
    """Numbers of links and component links inside one block or between two."""
    n = len(rep)
    buckets = hashing.buckets(unit, label)
    links = np.zeros(n, dtype=np.int64)
    near = np.zeros((n, n), dtype=bool)
    for i in range(0, n, 512):
        part = unit[i : i + 512] @ unit.T >= least
        rows = np.arange(i, min(i + 512, n))
        part[np.arange(len(rows)), rows] = False
        part &= label[rows][:, None] == label[None, :]
        near[rows] = part
        count = part if same_block else part & (block[rows][:, None] != block[None, :])
        a, b = np.nonzero(count)
        if tab and len(a):
            earlier = (buckets[rows[a], :tab] == buckets[b, :tab]).any(axis=1)
            a, b = a[~earlier], b[~earlier]
        links[rows] += np.bincount(a, weights=mult[b], minlength=len(rows)).astype(np.int64)
    root = np.arange(n)
    while True:
        lower = np.minimum(root, np.where(near, root[None, :], n).min(axis=1))
        if (lower == root).all():
            break
        root = lower
    joined = np.flatnonzero(root != np.arange(n))
    counted = np.flatnonzero(links)
    return rep[counted], links[counted], rep[joined], rep[root[joined]]


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashing] = {}
        held: list[pa.RecordBatch] = []

        def flush(group: pa.Table) -> pa.RecordBatch:
            group = group.combine_chunks().to_batches()[0]
            out = {"a": [], "b": [], "n": []}
            cols = {f: group.column(i) for i, f in enumerate(group.schema.names)}
            for rows, matrix in _by_width(cols["vec"]):
                pick = {f: cols[f].to_numpy()[rows] for f in ("rep", "mult", "label", "block")}
                tab, same = cols["tab"][0].as_py(), cols["i"][0].as_py() == cols["j"][0].as_py()
                hashing = made.setdefault(matrix.shape[1], Hashing(matrix.shape[1]))
                ids, n, a, b = _compare_group(pick["rep"], pick["mult"], pick["label"], _unit(matrix), pick["block"], tab, same, hashing, least)
                out["a"] += [*ids.tolist(), *a.tolist()]
                out["b"] += [None] * len(ids) + b.tolist()
                out["n"] += [*n.tolist(), *[0] * len(a)]
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                now = tuple(key[a])
                if held and now != last:
                    yield flush(pa.Table.from_batches(held))
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def classes(rows: DataFrame) -> DataFrame:
    """``k1, k2, rep, mult, label, vec``: one row per distinct usable vector and label."""
    v = F.col("vec")
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0)
    usable &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(usable).groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = COSINE) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(label_col).alias("label_hash"),
        F.col(label_col).alias("label_in"),
        F.col(vec_col).cast("array<double>").alias("vec"),
    )
    rows = rows.withColumn("label", F.when(F.col("label_in").isNotNull(), F.col("label_hash")))
    rows = rows.withColumns({"k1": F.xxhash64("label", "vec"), "k2": F.xxhash64("vec", "label")})
    known = settled(classes(rows))
    replicas = settled(known.select("rep", "label", "vec").mapInArrow(_hash, _HASHED))
    busy = replicas.groupBy("bucket").count().filter("count > 1")
    live = replicas.join(busy, "bucket").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    live = live.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    live = live.join(known.select("rep", "mult", "label", "vec"), "rep").select(
        "bucket", "tab", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "mult", "label", "vec"
    )
    found = live.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "tab", "i", "j")
    found = settled(found.mapInArrow(_compare(least), _FOUND))
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b"))
    linked = known.select("k1", "k2", "rep", "mult").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    linked = linked.filter((F.col("mult") > 1) | F.col("n").isNotNull())
    linked = settled(
        linked.select(
            "k1",
            "k2",
            (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(linked, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
