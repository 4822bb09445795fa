"""Moment algebra, neighbours and MLlib compositions against direct computations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclograin.operators import linear, models, neighbors, sampling, windows
from cyclograin.plans import evaluate
from cyclograin.plans.bindings import EV_ORDER, events

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for e in range(12):
        for t in range(30):
            x = rng.normal(size=3)
            rows.append(("u", e, t, e % 4 == 0, *map(float, x), float(2 + x[0] - 3 * x[1] + 0.1 * rng.normal())))
    d = spark.createDataFrame(rows, "unit string, entity long, t int, is_test boolean, a double, b double, c double, y double")
    return d.cache()


def solve(pdf, xs, alpha, y="y"):
    x, t = pdf[xs].to_numpy(), pdf[y].to_numpy()
    xc, tc = x - x.mean(0), t - t.mean()
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(xs)), xc.T @ tc)
    return np.append(t.mean() - beta @ x.mean(0), beta)


def test_ridge_matches_direct_solution(table):
    got = linear.fit(linear.moments(table, ["unit"], XS, "y"), 1.0).first()["beta"]
    np.testing.assert_allclose(got, solve(table.toPandas(), XS, 1.0), rtol=1e-9)


def test_wide_and_narrow_moments_agree(table, monkeypatch):
    narrow = np.array(linear.moments(table, ["unit", "entity"], XS, "y").orderBy("entity").first()["m"])
    monkeypatch.setattr(linear, "CODEGEN_WIDTH", 0)
    monkeypatch.setattr(linear, "HELD_BYTES", 500)
    wide = np.array(linear.moments(table, ["unit", "entity"], XS, "y").orderBy("entity").first()["m"])
    np.testing.assert_allclose(narrow, wide, rtol=1e-12)


@pytest.mark.parametrize("width", [0, 4])
@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_features_far_from_zero_and_gaps(spark, monkeypatch, width, offset):
    monkeypatch.setattr(linear, "CODEGEN_WIDTH", width)
    rng = np.random.default_rng(8)
    x = rng.normal(size=4000)
    y = 2.0 * x + 5.0 + 0.1 * rng.normal(size=4000)
    gap = rng.random(4000) < 0.3
    rows = [(None if i % 4 == 3 else i % 4, i % 40, None if gap[i] else float(x[i] + offset), float(y[i])) for i in range(4000)]
    d = spark.createDataFrame(rows, "unit long, entity long, x double, y double").repartition(6)
    m = linear.moments(d, ["unit", "entity"], ["x"], "y")
    whole = linear.fit(linear.pool(m, ["unit"]), 0.0).collect()
    assert sorted(str(r["unit"]) for r in whole) == ["0", "1", "2", "None"]
    for r in whole:
        ok = np.array([u == r["unit"] and v is not None for u, _, v, _ in rows])
        slope, level = np.polyfit(x[ok], y[ok], 1)
        assert r["m"][0] == ok.sum()
        assert r["beta"][1] == pytest.approx(slope, rel=1e-6) and r["beta"][0] + r["beta"][1] * offset == pytest.approx(level, rel=1e-6)
        error = np.sqrt(np.mean((y[ok] - slope * x[ok] - level) ** 2))
        if r["unit"] is not None:
            got = linear.score(m.filter(F.col("unit") == r["unit"]), linear.fit(linear.pool(m, ["unit"]), 0.0), ["unit"]).first()
            assert got["rmse_overall"] == pytest.approx(error, rel=1e-5)


def test_taking_a_part_out_leaves_the_rest():
    rng = np.random.default_rng(9)

    def matrix(z):
        g = np.empty((4, 4))
        mean = z.mean(axis=0)
        g[0, 0], g[0, 1:], g[1:, 0], g[1:, 1:] = len(z), mean, mean, (z - mean).T @ (z - mean)
        return g

    z = rng.normal(size=(50, 3)) + 1e7
    np.testing.assert_allclose(linear.merged(matrix(z[:20]), matrix(z[20:])), matrix(z), rtol=1e-9, atol=1e-6)
    np.testing.assert_allclose(linear.without(matrix(z), matrix(z[:20])), matrix(z[20:]), rtol=1e-9, atol=1e-6)


def test_singular_design_uses_the_pseudo_inverse(table):
    d = table.withColumn("c", F.col("a") - F.col("b"))
    m = linear.moments(d, ["unit", "entity"], XS, "y")
    beta = linear.fit(linear.pool(m, ["unit"]), 0.0)
    plain = linear.fit(linear.pool(linear.moments(d, ["unit", "entity"], ["a", "b"], "y"), ["unit"]), 0.0)
    r1 = linear.score(m, beta, ["unit"]).first()["rmse_overall"]
    r2 = linear.score(linear.moments(d, ["unit", "entity"], ["a", "b"], "y"), plain, ["unit"]).first()["rmse_overall"]
    assert r1 == pytest.approx(r2, rel=1e-6)


def test_leave_one_out_by_subtraction_equals_refit(table):
    m = linear.moments(table, ["unit", "entity"], XS, "y")
    got = {r["entity"]: r["rmse"] for r in linear.loco_estimate(m, ["unit"], "entity").collect()}
    pdf = table.toPandas()
    for e in (0, 5, 11):
        own, rest = pdf[pdf.entity == e], pdf[pdf.entity != e]
        b = solve(rest, XS, 1.0)
        err = own["y"] - b[0] - own[XS].to_numpy() @ b[1:]
        assert got[e] == pytest.approx(np.sqrt((err**2).mean()), rel=1e-7)
    with pytest.raises(ValueError, match="fold"):
        linear.loco_estimate(m, ["unit"], "entity", fold_free=False)


def test_anchored_scores_equal_refit_on_rows(spark, sf):
    e = events(spark, sf)
    scores, _ = evaluate.permutation_test(e, ["unit"], "entity", EV_ORDER, ["x2"], "y", 3)
    ids = e.select("unit", "entity").distinct()
    ref = sampling.derangement(ids, ["unit"], "entity", 1)
    d = windows.mispaired_lift(e, ["unit"], "entity", EV_ORDER, ["x2"], ref)
    pdf = d.toPandas()
    for unit, part in pdf.groupby("unit"):
        tr, te = part[~part.is_test], part[part.is_test]
        if not len(tr) or not len(te):
            continue
        b = solve(tr, ["x2", "x2__shuffled"], 1.0)
        err = te["y"] - b[0] - te[["x2", "x2__shuffled"]].to_numpy() @ b[1:]
        want = np.mean([np.sqrt((g**2).mean()) for _, g in err.groupby(te["entity"])])
        got = scores.filter((F.col("unit") == unit) & (F.col("draw") == 1)).first()["rmse_macro"]
        assert got == pytest.approx(want, rel=1e-6)


def test_boosting_with_three_classes(spark):
    from cyclograin.operators import models

    rng = np.random.default_rng(2)
    rows = [(i, float(i % 3 + 0.2 * rng.normal()), float(rng.normal()), i % 3) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, a double, b double, y int")
    got = models.fit_predict(d.filter("id < 200"), d.filter("id >= 200"), ["a", "b"], "y", "gbdt", proba="p").toPandas()
    assert list(got.columns) == ["id", "a", "b", "y", "pred", "p"]
    assert (got["pred"] == got["y"]).mean() > 0.9
    np.testing.assert_allclose([sum(p) for p in got["p"]], 1.0)


def brute(queries, pool, k, same=None):
    out = {}
    for qi, (qid, qv, qx) in enumerate(queries):
        c = [(float(np.sqrt(((np.array(qv) - np.array(v)) ** 2).sum())), pid) for pid, v, x in pool if same is None or x != qx]
        out[qid] = [pid for _, pid in sorted(c)[:k]]
    return out


@pytest.mark.parametrize("exclude", [None, "entity"])
def test_few_cells_are_visited_in_few_dimensions(spark, monkeypatch, exclude):
    """Entities are clusters of their own, so with exclusion the own cell holds nothing admissible."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 2)) * 50
    rows = [(i, [float(x) for x in centre[i % 60] + rng.normal(size=2)], i % 60) for i in range(2400)]
    d = spark.createDataFrame(rows, "id long, vec array<double>, entity long")
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 40)
    routed, plain = [], neighbors._block_join
    cells_of = []

    def counted(q, p, cells, *rest):
        routed.append(q.count())
        cells_of.append(len(cells.pivots))
        return plain(q, p, cells, *rest)

    monkeypatch.setattr(neighbors, "_block_join", counted)
    got = {}
    for r in neighbors.knn(d, d, 3, exclude=exclude).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"]))
    sample = rows[::97]
    want = brute(sample, rows, 3, None if exclude is None else "entity")
    assert {i: [n for _, n in sorted(got[i])] for i, _, _ in sample} == want
    assert sum(routed) <= (0.1 if exclude is None else 0.25) * len(rows) * cells_of[0]


@pytest.fixture(scope="module")
def cloud(spark):
    """Clustered points, a third of them exact copies of one vector."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        v = [1.0, 1.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=2) + 6 * (i % 4)]
        rows.append((i, v, i % 7))
    return spark.createDataFrame(rows, "id long, vec array<double>, entity long").cache()


@pytest.mark.parametrize("exclude", [None, "id", "entity"])
@pytest.mark.parametrize("block", [2000, 20])
def test_neighbours_equal_brute_force(cloud, exclude, block, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 50)
    rows = [(r["id"], r["vec"], None if exclude is None else r[exclude]) for r in cloud.collect()]
    want = brute(rows, rows, 4, exclude)
    got = neighbors.knn(cloud, cloud, 4, exclude=exclude).orderBy("id", "rank").toPandas()
    assert got.groupby("id")["neighbor"].apply(list).to_dict() == want


@pytest.mark.parametrize("block", [2000, 25])
def test_deduplication_equals_greedy_order(cloud, block, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", block)
    got = {r["id"] for r in neighbors.deduplicate(cloud, 0.4, seed=2).collect()}
    from cyclograin.functions import hash_key

    order = [(r["id"], np.array(r["vec"])) for r in cloud.orderBy(hash_key(2, "dedup", "id")).collect()]
    kept = []
    for i, v in order:
        if all(((v - w) ** 2).sum() > 0.4**2 for _, w in kept):
            kept.append((i, v))
    assert got == {i for i, _ in kept}


def test_discordance_against_brute_force(cloud):
    d = cloud.withColumn("y", F.col("vec")[0] + F.col("id") / 1000)
    rows = [(r["id"], r["vec"], r["entity"]) for r in d.collect()]
    y = {r["id"]: r["y"] for r in d.collect()}
    want = brute(rows, rows, 3, "entity")
    gaps = {i: np.mean([abs(y[j] - y[i]) for j in js]) for i, js in want.items()}
    got = neighbors.discordance(d, 3, "y").first()
    assert got["mean_gap"] == pytest.approx(np.mean(list(gaps.values())))
    assert got["median_gap"] == pytest.approx(np.median(list(gaps.values())))
    assert got["n_query"] == 240


def test_stacking_with_zero_weight_is_the_base(table):
    tr, te = table.filter("not is_test"), table.filter("is_test")
    got = models.stack_regression(tr, te, XS, "y", ["entity", "t"], "rf_reg", "rf_reg", 0.0, 2).toPandas()
    np.testing.assert_array_equal(got["pred"], got["base"])


@pytest.mark.parametrize("strategy", ["prune", "relabel", "reweight"])
def test_context_boosting(table, strategy):
    d = table.withColumn("cls", ((F.col("a") - F.col("b") > 0) != (F.col("t") % 10 == 0)).cast("int"))
    tr, te = d.filter("not is_test"), d.filter("is_test")
    got, trace = models.context_boosting(
        tr, te, XS, "cls", ["entity", "t"], "logistic", strategy, 2, n_folds=2, relabel_conf=0.6
    )
    assert got.count() == te.count() and trace[0]["n_context"] == tr.count()
    sizes = [t["n_context"] for t in trace]
    if strategy == "prune" and len(sizes) > 1:
        assert sizes[1] < sizes[0]
    if strategy == "relabel":
        assert len(set(sizes)) == 1


def test_nystroem_reproduces_the_kernel_on_landmarks(table):
    got = models.nystroem(table.limit(8), F.lit(True), XS, ["entity", "t"], 8).toPandas()
    phi, x = got[[f"rbf{i}" for i in range(8)]].to_numpy(), got[XS].to_numpy()
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 3)
    np.testing.assert_allclose(phi @ phi.T, want, atol=1e-6)


def test_ensemble_never_exceeds_the_mean_of_members(table):
    from cyclograin.operators import metrics

    d = table.withColumns({"p": F.col("a"), "q": -F.col("b")})
    assert metrics.mean_ensemble(d, ["entity"], "y", ["p", "q"]).filter("not within_bound").count() == 0


def test_early_selected_penalty_is_the_best_of_the_grid(table):
    m = linear.moments(table.filter("not is_test"), ["unit", "entity"], XS, "y")
    best = linear.select_alpha(m, ["unit"], [1e-3, 1e6]).first()
    assert best["alpha"] == 1e-3 and len(best["beta"]) == 4
