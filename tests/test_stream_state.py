"""Typed state of the stream operators: the same values however an entity's rows are cut into runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin import streaming

MAKERS = {
    "history": lambda: streaming.history_step(["a", "b"], roll=4, early=3),
    "fill": lambda: streaming.fill_step(["a", "b"], {"a": 7.0}),
    "smoothing": lambda: streaming.smoothing_step("a", width=3),
    "width one": lambda: streaming.smoothing_step("a", width=1),
}


def advanced(step, outputs, rows, cuts):
    memory, parts = None, []
    for low, high in zip([0, *cuts], [*cuts, len(rows["a"])], strict=True):
        if low == high:
            continue
        memory, out = step.advance(memory, {c: v[low:high] for c, v in rows.items()})
        assert set(memory) == {f.name for f in step.fields} and set(out) == set(outputs)
        # what Spark keeps of it: plain numbers and lists
        memory = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in memory.items()}
        parts.append(out)
    return {o: np.concatenate([p[o] for p in parts]) for o in outputs}


@pytest.mark.parametrize("name", MAKERS)
def test_cuts_change_nothing(name):
    step, outputs = MAKERS[name]()
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 40):
        for share in (0.0, 0.3, 1.0):
            rows = {c: np.where(rng.random(n) < share, np.nan, rng.normal(size=n)) for c in ("a", "b")}
            whole = advanced(step, outputs, rows, [])
            for cuts in ([n // 2], list(range(1, n)), sorted(rng.integers(0, n + 1, 3).tolist())):
                pieces = advanced(step, outputs, rows, cuts)
                for o in outputs:
                    np.testing.assert_allclose(pieces[o], whole[o], atol=1e-12)


def test_smoothing_follows_its_rules_row_by_row():
    x = np.array([np.nan, 3.0, 1.0, np.nan, 2.0, 2.5, 0.5])
    step, (low, mean, low_mean, fit) = streaming.smoothing_step("a", width=3)
    _, out = step.advance(None, {"a": x})
    np.testing.assert_allclose(out[low], np.fmin.accumulate(x))
    means = [np.nan if np.isnan(x[max(0, i - 2) : i + 1]).all() else np.nanmean(x[max(0, i - 2) : i + 1]) for i in range(len(x))]
    np.testing.assert_allclose(out[mean], means)
    np.testing.assert_allclose(out[low_mean], np.fmin.accumulate(means))
    # the last block of a non-increasing fit of the known values has the least mean of all endings
    for i, v in enumerate(x):
        known = [float(w) for w in x[: i + 1] if not np.isnan(w)]
        if not np.isnan(v):
            assert out[fit][i] == pytest.approx(min(np.mean(known[j:]) for j in range(len(known))))
    assert np.isnan(out[fit][[0, 3]]).all()


def test_unknown_order_large_ids_and_repeats(spark, tmp_path):
    """NULL times and tie-breaks come first, ids beyond 2^53 stay exact, a repeated row is late."""
    big = (1 << 60) + 1
    schema = "k string, s string, t long, v double"
    arrivals = [
        [(None, None, None, 1.0), (None, "2024-01-01", None, 2.0), (None, "2024-01-01", big, 3.0), (None, "2024-01-01", big, 9.0)],
        [(None, "2024-01-01", big + 1, 5.0), (None, "2024-01-01", big, 8.0), (None, None, 4, 7.0), ("x", None, None, None)],
        [("x", "2024-01-02", big, 4.0)],
    ]
    for rows in arrivals:
        d = spark.createDataFrame(rows, schema).withColumn("s", F.to_timestamp("s"))
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = T.StructType.fromDDL("k string, s timestamp, t long, v double")
    s = streaming.read_table_stream(spark, str(tmp_path / "in"), "*.parquet", read)
    step, outputs = streaming.history_step(["v"])
    made = streaming.stream_scan(s, ["k"], "s", "t", ["v"], step, outputs)
    assert [f.dataType for f in made.schema.fields[:3]] == [T.StringType(), T.TimestampType(), T.LongType()]
    rows = streaming.run_to_table(made, str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    assert len(rows) == 9
    none = {(r["t"], r["late"]): r["v__lag1"] for r in rows if r["k"] is None and r["s"] is not None}
    assert none[(None, False)] == 1.0 and none[(big, False)] == 2.0 and none[(big + 1, False)] == 3.0
    late = [r for r in rows if r["late"]]
    assert sorted((r["t"] for r in late)) == [4, big, big] and all(r["v__lag1"] is None for r in late)
    x = {r["t"]: r for r in rows if r["k"] == "x"}
    assert x[None]["v__lag1"] is None and x[big]["v__lag1"] is None and x[big]["v__from_roll5"] == 0.0


def test_order_ignores_the_session_time_zone(spark, tmp_path):
    """Two instants in the hour that a zone repeats in autumn keep their order."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [(1, 1729987200, 5, 0.0), (1, 1729990800, 1, 1.0), (1, 1729994400, 0, 2.0)]  # 02:00, 02:00 again, 03:00
    d = spark.createDataFrame(rows, "k long, at long, t long, v double").withColumn("s", F.timestamp_seconds("at"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        read = T.StructType.fromDDL("k long, at long, t long, v double, s timestamp")
        s = streaming.read_table_stream(spark, str(tmp_path / "in"), "*.parquet", read)
        step, outputs = streaming.history_step(["v"])
        made = streaming.stream_scan(s, ["k"], "s", "t", ["v"], step, outputs)
        got = streaming.run_to_table(made, str(tmp_path / "out"), str(tmp_path / "ck"))
        found = {r["v__from_first"]: r["at"] for r in got.withColumn("at", F.unix_seconds("s")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == {0.0: 1729987200, 1.0: 1729990800, 2.0: 1729994400}


def test_entities_that_share_a_state_get_the_same_values(spark, tmp_path):
    rng = np.random.default_rng(6)
    big = (1 << 53) + 1
    entities = [big, big + 1, None, 0, 5, 6, 7]
    rows = [(entities[int(rng.integers(7))], int(t), i, None if i % 6 == 0 else float(rng.normal())) for i, t in enumerate(rng.integers(0, 60, 240))]
    schema = "entity long, ts long, tie long, a double"
    for part in range(3):
        spark.createDataFrame(rows[part * 80 : part * 80 + 80], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    step, outputs = streaming.history_step(["a"])

    def run(name, **kw):
        src = streaming.read_table_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema)
        src = src.withColumn("ts", F.timestamp_seconds("ts"))
        d = streaming.stream_scan(src, ["entity"], "ts", "tie", ["a"], step, outputs, **kw)
        got = streaming.run_to_table(d, str(tmp_path / name / "rows"), str(tmp_path / name / "checkpoint"))
        return sorted(map(repr, got.collect()))

    alone = run("alone")
    assert len(alone) == len(rows) and any("late=True" in r for r in alone)
    assert run("shared", buckets=2) == alone
