"""Quantiles of all other units, one-pass bootstrap, and NULL labels on every route."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclograin import streaming
from cyclograin.operators import inference, monotone, ordered, ranks, sampling, windows


@pytest.mark.parametrize("limit", [None, 7])
def test_complement_quantiles(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(ordered, "MAX_ROWS_PER_TASK", limit)
        monkeypatch.setattr(ordered, "SMALL_INPUT_BYTES", 0)
    rng = np.random.default_rng(0)
    rows = [(u, float(v)) for u, n in (("a", 40), ("b", 1), ("c", 7), (None, 9)) for v in rng.integers(0, 12, n)]
    rows += [("a", None), ("empty", None)]
    d = spark.createDataFrame(rows, "unit string, v double")
    qs = {f"q{i}": ("v", q) for i, q in enumerate((0.0, 0.13, 0.5, 0.9, 1.0))}
    got = {r["unit"]: r for r in ranks.complement_quantiles(d, "unit", qs).collect()}
    assert set(got) == {"a", "b", "c", None, "empty"}
    for unit, r in got.items():
        other = [v for u, v in rows if u != unit and v is not None]
        assert np.allclose([r[k] for k in qs], [np.quantile(other, q) for _, q in qs.values()])
    one = ranks.complement_quantiles(d.filter("unit = 'a'"), "unit", qs).collect()
    assert [tuple(r) for r in one] == [("a", *[None] * 5)]
    assert ranks.complement_quantiles(d.limit(0), "unit", qs).collect() == []


def test_poisson_bootstrap(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=400)
    d = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)] + [(None, 1, 5.0), ("g", 999, None)], "g string, e int, v double")
    sums = sampling.bootstrap_sums(d, ["g"], ["e"], "v", 1000).filter("g = 'g'").toPandas()
    assert abs(sums["weight"].mean() - 400) < 3 and abs(sums["weight"].std() - 20) < 2
    means = sums["total"] / sums["weight"]
    assert abs(means.mean() - values.mean()) < 0.01 and abs(means.std() / (values.std() / 20) - 1) < 0.1
    assert abs(np.corrcoef(means[:-1], means[1:])[0, 1]) < 0.1
    share = [math.exp(-1) / math.factorial(k) for k in range(12)]
    assert np.allclose(np.diff([0, *sampling.poisson_thresholds()]) / sampling.PRIME, share, atol=1e-8)
    got = {r["g"]: r for r in inference.bootstrap_interval(d, ["g"], ["e"], "v", 500).collect()}
    assert got["g"]["ci_lo"] < values.mean() < got["g"]["ci_hi"] and got[None]["ci_lo"] == 5.0


Y = [1.0, None, 1.2, 0.4, 0.9, None, 0.3, 0.2, 0.5]


def labelled(spark):
    rows = [(k, i, v) for k in ("a", None) for i, v in enumerate(Y)] + [("n", 0, None), ("n", 1, None)]
    return spark.createDataFrame(rows, "k string, t int, y double")


def test_isotonic_leaves_unknown_labels_on_both_routes(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SMALL_INPUT_BYTES", 0)
    d = labelled(spark)
    known = [(i, v) for i, v in enumerate(Y) if v is not None]
    fit = dict(zip([i for i, _ in known], monotone.fit_decreasing(np.array([v for _, v in known])), strict=True))
    causal = {t: min(np.mean([v for i, v in known if j <= i <= t]) for j, _ in known if j <= t) for t, _ in known}
    for op, want in ((monotone.isotonic, fit), (monotone.causal_isotonic, causal)):
        for limit in (None, 2):
            got = {(r["k"], r["t"]): r["f"] for r in op(d, ["k"], ["t"], "y", "f", limit).collect()}
            assert len(got) == d.count()
            for (k, t), v in got.items():
                expected = want.get(t) if k != "n" else None
                assert (v is None or v != v) if expected is None else v == pytest.approx(expected), (op, limit, k, t)


def test_stream_smoothing_with_unknown_labels_equals_batch(spark, tmp_path):
    d = labelled(spark).withColumn("ts", F.timestamp_seconds(F.col("t") * 60)).withColumn("t", F.when(F.col("t") != 4, F.col("t")))
    for low, high in ((-1, 2), (2, 5), (5, 99)):
        part = d.filter((F.unix_timestamp("ts") / 60 > low) & (F.unix_timestamp("ts") / 60 <= high))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streaming.read_table_stream(spark, str(tmp_path / "in"), "*.parquet", d.schema)
    step, outputs = streaming.smoothing_step("y")
    got = streaming.run_to_table(streaming.stream_scan(s, ["k"], "ts", "t", ["y"], step, outputs), str(tmp_path / "rows"), str(tmp_path / "ck"))
    assert got.filter("late").count() == 0
    k, o = ["k"], ["ts", "t"]
    b = windows.causal_cummin(d, k, o, "y", "y__cummin")
    b = windows.causal_mean(b, k, o, "y", "y__causal_mean")
    b = windows.causal_smooth_cummin(b, k, o, "y", "y__causal_sm")
    b = monotone.causal_isotonic(b, k, o, "y", "y__iso_causal")
    batch = {(r["k"], r["ts"]): r for r in b.withColumn("y__iso_causal", F.nanvl("y__iso_causal", F.lit(None).cast("double"))).collect()}
    for r in got.collect():
        for c in outputs:
            want = batch[r["k"], r["ts"]][c]
            assert (r[c] is None and want is None) or r[c] == pytest.approx(want), (r, c)
