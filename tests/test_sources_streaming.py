"""File readers and sinks, and stream = batch over several micro-batches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cyclograin import sources, streaming
from cyclograin.operators import filters, joins, monotone, windows
from cyclograin.plans import catalog
from cyclograin.plans.bindings import events
from cyclograin.schema import FEATURES_16


def write_cell(folder, name, rows):
    head = ",".join([*FEATURES_16, "capacity"])
    lines = [",".join(map(str, r)) for r in rows]
    (folder / f"{name}.csv").write_text("\n".join([head, *lines]) + "\n")


def test_per_entity_csv(spark, tmp_path):
    for name in ("2C_battery-1", "2C_battery-4"):
        rows = [[float(k + j) for j in range(16)] + [2.0 - 0.01 * k] for k in range(20)]
        rows[2][3], rows[5][0] = float("nan"), float("inf")
        write_cell(tmp_path, name, rows)
    raw = sources.read_series_csv(spark, str(tmp_path))
    assert raw.count() == 40 and {r["entity"] for r in raw.select("entity").distinct().collect()} == {"2C_battery-1", "2C_battery-4"}
    cat = raw.select("entity").distinct().withColumns({"unit": F.lit("u"), "nominal": F.lit(2.0)})
    d = sources.load_series(raw, cat, filters.split_by_substring("entity", ["4", "8"]))
    assert d.count() == 36 and d.filter("record_index in (2, 5)").count() == 0
    assert d.filter("is_test").select("entity").distinct().collect()[0][0] == "2C_battery-4"
    assert d.filter("record_index = 0").select("y").distinct().collect()[0][0] == 1.0
    off = sources.load_series(raw, cat, F.lit(False), "author_offline")
    assert off.first()["reader"] == "author_offline"
    with pytest.raises(ValueError, match="reader"):
        sources.load_series(raw, cat, F.lit(False), "other")


def test_row_numbers_over_several_splits(spark, tmp_path):
    write_cell(tmp_path, "big", [[float(k)] * 16 + [1.0] for k in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = sources.read_series_csv(spark, str(tmp_path))
        assert raw.filter(F.col("record_index") != F.col("`voltage mean`")).count() == 0 and raw.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_run_archive_prefers_success_and_resumes(spark, tmp_path):
    rec = {"unit": "u", "view": "raw", "backbone": "ridge", "seed": 0, "normalize": "source"}
    bad = [{**rec, "error": "boom"}, {**rec, "seed": 1, "error": "boom"}]
    good = [{**rec, "metrics": {"rmse": 1.0}}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, good)))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, bad)))
    runs = sources.read_runs(spark, str(tmp_path))
    assert runs.count() == 2 and runs.filter("error is null").first()["metrics"] == {"rmse": 1.0}
    todo = joins.pending(runs.select("unit", "seed"), runs, ["unit", "seed"])
    assert [r["seed"] for r in todo.collect()] == [1]


def test_keyed_archive_and_manifest(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"u1|gbdt": {"rmse": 1.0, "n": 3}, "u2|ridge": {"rmse": 2.0}}))
    d = sources.read_keyed_archive(spark, str(tmp_path / "x.json"), ["unit", "arm"])
    assert d.count() == 3 and d.filter("unit = 'u2'").first()["value"] == 2.0
    import hashlib

    m = sources.file_manifest(spark, str(tmp_path)).first()
    assert m["sha256"] == hashlib.sha256((tmp_path / "x.json").read_bytes()).hexdigest()


def test_versions_are_never_overwritten(spark, tmp_path):
    d = spark.range(2)
    sources.write_summary(d, str(tmp_path), "1")
    with pytest.raises(Exception, match="exist"):
        sources.write_summary(d, str(tmp_path), "1")


@pytest.fixture(scope="module")
def replay(spark, sf, tmp_path_factory):
    """Events split into four files in time order, so the stream runs in four micro-batches."""
    e = events(spark, sf).select("entity", F.col("ts").cast("timestamp").alias("ts"), "event_id", "y", "x1", "g1")
    folder = tmp_path_factory.mktemp("stream")
    edges = e.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    part = sum((F.col("event_id") > x).cast("int") for x in edges)
    for i in range(4):
        e.filter(part == i).coalesce(1).write.mode("append").parquet(str(folder))
    return e, str(folder)


def drained(spark, replay, tmp_path, cols, made):
    e, folder = replay
    s = streaming.read_table_stream(spark, folder, "*.parquet", e.schema)
    step, outputs = made
    d = streaming.stream_scan(s, ["entity"], "ts", "event_id", cols, step, outputs)
    got = streaming.run_to_table(d, str(tmp_path / "rows"), str(tmp_path / "ck"))
    on_time, late = streaming.split_late(got)
    assert late.count() == 0 and on_time.count() == e.count()
    return on_time


def test_stream_history_equals_batch(spark, replay, tmp_path):
    on_time = drained(spark, replay, tmp_path, ["x1"], streaming.history_step(["x1"]))
    fam = [*windows.FAMILIES, "from_early"]
    batch = windows.history_features(replay[0], ["entity"], ["ts", "event_id"], ["x1"], fam)
    assert streaming.differences(batch, on_time, ["event_id"], [f"x1__{f}" for f in fam]).count() == 0


def test_stream_smoothing_equals_batch(spark, replay, tmp_path):
    on_time = drained(spark, replay, tmp_path, ["y"], streaming.smoothing_step("y"))
    k, o = ["entity"], ["ts", "event_id"]
    batch = windows.causal_cummin(replay[0], k, o, "y", "y__cummin")
    batch = windows.causal_smooth_cummin(batch, k, o, "y", "y__causal_sm")
    batch = monotone.causal_isotonic(batch, k, o, "y", "y__iso_causal")
    assert streaming.differences(batch, on_time, ["event_id"], ["y__cummin", "y__causal_sm", "y__iso_causal"]).count() == 0


def test_idle_state_leaves_by_the_watermark(spark, tmp_path):
    batches = [[(1, "2024-01-01", 1, 5.0)], [(2, "2024-03-01", 2, 1.0)], [(2, "2024-03-02", 3, 2.0)], [(2, "2024-03-03", 5, 2.0)], [(1, "2024-03-04", 4, 7.0)]]
    for rows in batches:
        d = spark.createDataFrame(rows, "entity long, s string, event_id long, x1 double")
        d.select("entity", F.to_timestamp("s").alias("ts"), "event_id", "x1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame([], "entity long, ts timestamp, event_id long, x1 double").schema
    s = streaming.read_table_stream(spark, str(tmp_path / "in"), "*.parquet", schema)
    step, out = streaming.history_step(["x1"])
    d = streaming.stream_scan(s, ["entity"], "ts", "event_id", ["x1"], step, out, "1 day", 86_400_000)
    got = {r["event_id"]: r for r in streaming.run_to_table(d, str(tmp_path / "rows"), str(tmp_path / "ck")).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and not any(r["late"] for r in got.values())
    # entity 2 stays in memory, entity 1 was forgotten and begins anew
    assert got[3]["x1__from_first"] == 1.0 and got[4]["x1__from_first"] == 0.0


def test_late_rows_are_flagged(spark, tmp_path):
    schema = "entity long, ts timestamp, event_id long, x1 double"
    for i, rows in enumerate(([(1, "2024-01-02", 1, 5.0)], [(1, "2024-01-01", 2, 9.0), (1, "2024-01-03", 3, 7.0)])):
        d = spark.createDataFrame(rows, "entity long, s string, event_id long, x1 double")
        d.select("entity", F.to_timestamp("s").alias("ts"), "event_id", "x1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streaming.read_table_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema)
    step, out = streaming.history_step(["x1"])
    d = streaming.stream_scan(s, ["entity"], "ts", "event_id", ["x1"], step, out)
    got = streaming.run_to_table(d, str(tmp_path / "rows"), str(tmp_path / "ck"))
    on_time, late = streaming.split_late(got)
    assert [r["event_id"] for r in late.collect()] == [2]
    assert on_time.filter("event_id = 3").first()["x1__from_first"] == 2.0


def test_replayed_events_keep_rows_without_a_time(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e = e.withColumn("ts", F.when(F.col("event_id") % 10 != 3, F.col("ts")))
    e.write.parquet(f"{tmp_path}/events.parquet")
    n = e.count()
    assert e.filter(F.col("ts").isNull()).count() > 10
    q = catalog.all_queries()
    got = q["x4_batch_equals_stream"].run(spark, str(tmp_path)).first()
    assert (got["n_rows"], got["n_different"]) == (n, 0)
    assert q["x2_stream_fill"].run(spark, str(tmp_path)).count() == n
