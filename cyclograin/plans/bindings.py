"""The operators' input tables bound to the star-schema and event tables.

Every binding is a DataFrame function and the same table as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EV_KEYS, EV_ORDER = ["unit", "entity"], ["ts", "event_id"]
LI_KEYS, LI_ORDER = ["unit", "entity"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
LI_X = ["x1", "x2", "x3", "x4"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as entities, their events in time order, five units; ``g1`` has gaps."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("unit"),
        F.col("user_id").alias("entity"),
        "ts",
        "event_id",
        "event_type",
        (F.col("user_id") % 4 == 0).alias("is_test"),
        F.col("value").alias("y"),
        F.col("value").alias("x1"),
        F.get_json_object("props", "$.k").cast("double").alias("x2"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("g1"),
    )


EV = """ev AS (
  SELECT 'u' || CAST(user_id % 5 AS VARCHAR) AS unit, user_id AS entity, ts, event_id, event_type,
         user_id % 4 = 0 AS is_test, value AS y, value AS x1,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS x2,
         CASE WHEN event_id % 7 <> 0 THEN value END AS g1
  FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities, their order lines by ship date, regions as units."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
        "l_tax", "l_extendedprice", "l_shipdate",
    )
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    d = (
        li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(p, F.col("l_partkey") == F.col("p_partkey"))
    )
    return d.select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("unit"),
        F.col("l_suppkey").alias("entity"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_suppkey") % 4 == 0).alias("is_test"),
        F.col("l_quantity").alias("x1"),
        F.col("l_discount").alias("x2"),
        F.col("l_tax").alias("x3"),
        F.col("p_retailprice").alias("x4"),
        (F.col("l_extendedprice") / 100000.0).alias("y"),
    )


LI = """li AS (
  SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS unit, l_suppkey AS entity, l_shipdate, l_orderkey,
         l_linenumber, l_partkey, l_suppkey % 4 = 0 AS is_test, l_quantity AS x1, l_discount AS x2,
         l_tax AS x3, p_retailprice AS x4, l_extendedprice / 100000.0 AS y
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

EV_W = "PARTITION BY unit, entity ORDER BY ts, event_id"
EV_ALL = "PARTITION BY unit, entity"
LI_W = "PARTITION BY unit, entity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey"


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as sampled curves: one array of points per (entity, cycle).

    Current is ten times the component, voltage a falling line bent by the component,
    charge the running total of time.
    """
    e = table(spark, sf_dir, "embeddings")
    d = e.select(
        F.col("label").cast("string").alias("entity"),
        F.col("vec_id").alias("cycle"),
        F.transform(
            F.col("embedding"),
            lambda x, k: F.struct(
                (k * 10.0).alias("t"),
                (x.cast("double") * 10.0).alias("i"),
                (F.lit(4.2) - k * 0.02 + x.cast("double") * 0.001).alias("v"),
                (k * 10.0 / 360.0 + x.cast("double") * 0.01).alias("q"),
            ),
        ).alias("pts"),
    )
    return d


CU = """pt AS (
  SELECT CAST(label AS VARCHAR) AS entity, vec_id AS cycle, k, k * 10.0::DOUBLE AS t,
         x * 10.0::DOUBLE AS i, 4.2::DOUBLE - k * 0.02::DOUBLE + x * 0.001::DOUBLE AS v,
         k * 10.0::DOUBLE / 360.0::DOUBLE + x * 0.01::DOUBLE AS q
  FROM (SELECT label, vec_id, unnest(range(len(embedding))) AS k,
               unnest(embedding)::DOUBLE AS x FROM embeddings))"""


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with three length features over the whole text."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    words = F.size(F.split(F.col("text"), " "))
    digits = F.length(F.regexp_replace(F.col("text"), "[^0-9]", ""))
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("lang").alias("unit"), "source",
        F.ln(F.col("n_chars") + 1.0).alias("x1"),
        F.ln(words + 1.0).alias("x2"),
        (digits / (F.col("n_chars") + 1.0)).alias("x3"),
        F.col("quality").cast("int").alias("y"),
        F.col("toxic").cast("int").alias("toxic"),
    )


DO = """dox AS (
  SELECT d.doc_id, lang AS unit, source, ln(n_chars + 1.0::DOUBLE) AS x1,
         ln(len(string_split(text, ' ')) + 1.0::DOUBLE) AS x2,
         length(regexp_replace(text, '[^0-9]', '', 'g')) / (n_chars + 1.0::DOUBLE) AS x3,
         CAST(quality AS INTEGER) AS y, CAST(toxic AS INTEGER) AS toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two history-only predictors of the value: ``p`` (causal mean) and ``q``."""
    from cyclograin.operators.windows import causal_mean

    d = causal_mean(events(spark, sf_dir), EV_KEYS, EV_ORDER, "y", "p")
    return d.withColumn("q", 0.5 * F.col("p") + 0.25 * F.col("x2"))


PR = EV + f""", pr0 AS (SELECT *, avg(y) OVER ({EV_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS p FROM ev),
pr AS (SELECT *, 0.5 * p + 0.25 * x2 AS q FROM pr0)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result table: one score per (unit, arm, seed), aggregated from all events."""
    e = events(spark, sf_dir)
    return e.groupBy("unit", F.col("event_type").alias("arm"), (F.col("event_id") % 5).cast("int").alias("seed")).agg(
        F.avg("y").alias("rmse"), F.count(F.lit(1)).alias("n_rows")
    )


RUNS = EV + """, runs AS (SELECT unit, event_type AS arm, CAST(event_id % 5 AS INTEGER) AS seed, avg(y) AS rmse,
  count(*) AS n_rows FROM ev GROUP BY ALL)"""
