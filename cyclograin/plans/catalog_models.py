"""Queries for linear models, neighbours, MLlib compositions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclograin import sources, streaming
from cyclograin.functions import rmse
from cyclograin.operators import boosting, filters, forest, linear, logistic, models, neighbors, normalize, sampling, trajectory, windows
from cyclograin.operators.attach import settled
from cyclograin.plans import evaluate, run_matrix
from cyclograin.plans.bindings import (
    EV, EV_KEYS, EV_ORDER, EV_W, LI, LI_KEYS, LI_ORDER, LI_W, LI_X, PR,
    doc_features, events, lines, predictions, table,
)
from cyclograin.plans.catalog_audit import _h
from cyclograin.plans.catalog_rows import LID, LIDS
from cyclograin.plans.registry import query


def _settled_lines(spark, sf, *more):
    """What the models that pass over the lines many times need of them, joined and written once."""
    return settled(lines(spark, sf).select(*more, "unit", *LI_X, "is_test", "y"))


def ridge2(name: str, src: str, by: str, a: str, b: str, y: str, alpha: float) -> str:
    """SQL of a two-feature ridge fit per group."""
    return f"""{name}_s AS (SELECT {by}, count(*) AS n, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my,
      var_pop({a}) * count(*) + {alpha} AS saa, var_pop({b}) * count(*) + {alpha} AS sbb, covar_pop({a}, {b}) * count(*) AS sab,
      covar_pop({a}, {y}) * count(*) AS say, covar_pop({b}, {y}) * count(*) AS sby FROM {src} GROUP BY {by}),
    {name}_c AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM {name}_s),
    {name} AS (SELECT {by}, n, my - ba * ma - bb * mb AS b0, ba, bb FROM {name}_c)"""


def _score(model: str, src: str, by: str, pred: str, y: str = "y", extra: str = "") -> str:
    return f"""SELECT {by}{extra}, sqrt(sum(s) / sum(n)) AS rmse_overall, avg(sqrt(s / n)) AS rmse_macro, count(*) AS n_entities FROM (
      SELECT {by}, entity, sum(({y} - ({pred})) * ({y} - ({pred}))) AS s, count(*) AS n FROM {src} JOIN {model} USING ({by}) GROUP BY {by}, entity) GROUP BY {by}"""


def boosted_sql(xs: list[str], n_trees: int, depth: int, n_bins: int, min_leaf: int, rate: float, src: str = "li", by: str = "unit", y: str = "y", carry: str = "entity") -> str:
    """Boosted regression trees in SQL: a chain of tables, one per level of each tree, ending in ``done``.

    ``b`` holds the bins of all rows; the labels are whole steps, as in the operator.
    """
    long = " UNION ALL ".join(f"SELECT {by}, {i} AS f, CAST({x} AS DOUBLE) AS v FROM tr" for i, x in enumerate(xs))
    bins = ", ".join(
        f"(SELECT count(*) FROM edges e WHERE e.{by} = s.{by} AND e.f = {i} AND e.v < s.{x}) AS x{i}" for i, x in enumerate(xs)
    )
    ctes = [
        f"tr AS (SELECT * FROM {src} WHERE NOT is_test AND {y} IS NOT NULL)",
        f"vc AS MATERIALIZED (SELECT {by}, f, v, count(*) AS c FROM ({long}) WHERE v IS NOT NULL GROUP BY ALL)",
        f"""edges AS MATERIALIZED (SELECT {by}, f, v FROM (SELECT *, sum(c) OVER (PARTITION BY {by}, f ORDER BY v) AS hi,
          sum(c) OVER (PARTITION BY {by}, f) AS n, max(v) OVER (PARTITION BY {by}, f) AS top FROM vc)
          WHERE floor(hi * {n_bins} / n) > floor((hi - c) * {n_bins} / n) AND v < top)""",
        f"""base AS MATERIALIZED (SELECT {by}, mid, coalesce(nullif(greatest(hi - mid, mid - lo) / 1048576, 0), 1.0) AS step FROM
          (SELECT {by}, floor(avg({y}) * 1000000.0 + 0.5) / 1000000.0 AS mid, min({y}) AS lo, max({y}) AS hi FROM tr GROUP BY {by}))""",
        f"""b0 AS MATERIALIZED (SELECT s.{by}, {carry}, is_test, {y} AS y, mid, step, CAST(floor(({y} - mid) / step + 0.5) AS BIGINT) AS q,
          CAST(0 AS BIGINT) AS score, 0 AS node, {bins} FROM {src} s JOIN base USING ({by}))""",
    ]
    now = "b0"
    for t in range(n_trees):
        for level in range(depth):
            k = f"t{t}l{level}"
            hist = " UNION ALL ".join(
                f"SELECT {by}, node, {i} AS f, x{i} AS bin, sum(q - score) AS g, count(*) AS n FROM {now} WHERE NOT is_test AND node >= {2**level - 1} GROUP BY {by}, node, x{i}"
                for i in range(len(xs))
            )
            left = f"(PARTITION BY {by}, node, f ORDER BY bin)"
            whole = f"(PARTITION BY {by}, node, f)"
            ctes.append(f"""{k} AS MATERIALIZED (SELECT *, CAST(floor({rate} * gl / nl + 0.5) AS BIGINT) AS vl, CAST(floor({rate} * (gt - gl) / (nt - nl) + 0.5) AS BIGINT) AS vr FROM (
              SELECT *, gl::DOUBLE * gl::DOUBLE / nl + (gt - gl)::DOUBLE * (gt - gl)::DOUBLE / (nt - nl) - gt::DOUBLE * gt::DOUBLE / nt AS gain FROM (
                SELECT {by}, node, f, bin, sum(g) OVER {left} AS gl, sum(n) OVER {left} AS nl, sum(g) OVER {whole} AS gt, sum(n) OVER {whole} AS nt FROM ({hist}))
              WHERE nl >= {min_leaf} AND nt - nl >= {min_leaf}) WHERE gain > 0
              QUALIFY row_number() OVER (PARTITION BY {by}, node ORDER BY gain DESC, f, bin) = 1)""")
            # the value of the node reached so far travels in the row until the tree is finished
            x = "CASE s.f " + " ".join(f"WHEN {i} THEN x{i}" for i in range(len(xs))) + " END"
            root = f"(SELECT CAST(floor({rate} * sum(q - score) / count(*) + 0.5) AS BIGINT) FROM {now} z WHERE NOT z.is_test AND z.{by} = d.{by})" if level == 0 else "d.val"
            cols = "".join(f", d.x{i}" for i in range(len(xs)))
            ctes.append(f"""n{k} AS MATERIALIZED (SELECT d.{by}, d.{carry}, d.is_test, d.y, d.mid, d.step, d.q, d.score{cols},
              CASE WHEN s.f IS NULL THEN d.node ELSE 2 * d.node + 1 + CASE WHEN {x} > s.bin THEN 1 ELSE 0 END END AS node,
              CASE WHEN s.f IS NULL THEN {root} WHEN {x} > s.bin THEN s.vr ELSE s.vl END AS val
              FROM {now} d LEFT JOIN {k} s ON s.{by} = d.{by} AND s.node = d.node)""")
            now = f"n{k}"
        cols = "".join(f", x{i}" for i in range(len(xs)))
        ctes.append(f"e{t} AS MATERIALIZED (SELECT {by}, {carry}, is_test, y, mid, step, q, score + val AS score, 0 AS node{cols} FROM {now})")
        now = f"e{t}"
    ctes.append(f"done AS (SELECT {by}, {carry}, is_test, y, mid + step * score AS pred FROM {now})")
    return ", ".join(ctes)


LIDH = " || '|' || ".join(LID)


# linear -----------------------------------------------------------------------------------------
@query(
    "l1_ridge",
    f"""WITH {LI}, tr AS (SELECT * FROM li WHERE NOT is_test), {ridge2("md", "tr", "unit", "x1", "x4", "y", 1.0)} SELECT unit, b0, ba, bb FROM md""",
    "b0 ba bb", 8,
)
def _(spark, sf):
    m = linear.moments(lines(spark, sf).filter(~F.col("is_test")), ["unit"], ["x1", "x4"], "y")
    b = linear.fit(m, 1.0)
    return b.select("unit", F.col("beta")[0].alias("b0"), F.col("beta")[1].alias("ba"), F.col("beta")[2].alias("bb"))


@query(
    "l2_ols_scores",
    f"""WITH {LI}, tr AS (SELECT * FROM li WHERE NOT is_test), te AS (SELECT * FROM li WHERE is_test), {ridge2("md", "tr", "unit", "x1", "x4", "y", 0.0)}
    {_score("md", "te", "unit", "b0 + ba * x1 + bb * x4")}""",
    "rmse_overall rmse_macro",
)
def _(spark, sf):
    m = linear.moments(lines(spark, sf), ["unit", "entity", "is_test"], ["x1", "x4"], "y")
    model = linear.fit(linear.pool(m.filter(~F.col("is_test")), ["unit"]), 0.0)
    return linear.score(m.filter("is_test"), model, ["unit"])


@query(
    "l2_single_regression",
    f"""WITH {LI} SELECT unit, entity, regr_intercept(y, x1) AS b0, regr_slope(y, x1) AS b1 FROM li GROUP BY unit, entity""",
    "b0 b1", 8,
)
def _(spark, sf):
    b = linear.fit(linear.moments(lines(spark, sf), ["unit", "entity"], ["x1"], "y"), 0.0)
    return b.select("unit", "entity", F.col("beta")[0].alias("b0"), F.col("beta")[1].alias("b1"))


@query(
    "l7_evaluate_views",
    f"""WITH {LI}, r AS (SELECT unit, min(x1) AS lo, max(x1) AS hi FROM li WHERE NOT is_test GROUP BY unit),
    z AS (SELECT li.*, 2 * (x1 - lo) / (hi - lo) - 1 AS z FROM li JOIN r USING (unit)),
    f AS (SELECT *, z - first_value(z) OVER ({LI_W}) AS zf FROM z),
    tr AS (SELECT f.*, CAST(sd AS INTEGER) AS seed FROM f, (SELECT unnest([0, 1]) AS sd) WHERE NOT is_test),
    te AS (SELECT f.*, CAST(sd AS INTEGER) AS seed FROM f, (SELECT unnest([0, 1]) AS sd) WHERE is_test),
    m1 AS (SELECT unit, seed, avg(y) - covar_pop(z, y) * count(*) / (var_pop(z) * count(*) + 1) * avg(z) AS b0, covar_pop(z, y) * count(*) / (var_pop(z) * count(*) + 1) AS ba FROM tr GROUP BY ALL),
    {ridge2("m2", "tr", "unit, seed", "z", "zf", "y", 1.0)}
    SELECT *, 'raw' AS view FROM ({_score("m1", "te", "unit, seed", "b0 + ba * z")})
    UNION ALL SELECT *, 'srl' FROM ({_score("m2", "te", "unit, seed", "b0 + ba * z + bb * zf")})""",
    "rmse_overall rmse_macro",
)
def _(spark, sf):
    return evaluate.evaluate_linear(
        lines(spark, sf), ["unit"], "entity", LI_ORDER, LID, ["x1"], "y", ["raw", "srl"], (0, 1)
    )


def _boosted_view(view: str, xs: list[str]) -> str:
    return f"""SELECT *, '{view}' AS view FROM (SELECT unit, sqrt(sum(s) / sum(n)) AS rmse_overall, avg(sqrt(s / n)) AS rmse_macro, count(*) AS n_entities FROM (
      SELECT unit, entity, sum((y - pred) * (y - pred)) AS s, count(*) AS n FROM (WITH {boosted_sql(xs, 20, 4, 32, 20, 0.1, "f")} SELECT * FROM done WHERE is_test)
      GROUP BY unit, entity) GROUP BY unit)"""


@query(
    "l7_evaluate_boosted",
    f"""WITH {LI}, r AS (SELECT unit, min(x1) AS lo, max(x1) AS hi FROM li WHERE NOT is_test GROUP BY unit),
    z AS (SELECT li.*, 2 * (x1 - lo) / (hi - lo) - 1 AS z FROM li JOIN r USING (unit)),
    f AS MATERIALIZED (SELECT *, z - first_value(z) OVER ({LI_W}) AS zf FROM z)
    {_boosted_view("raw", ["z"])} UNION ALL {_boosted_view("srl", ["z", "zf"])}""",
    "rmse_overall rmse_macro",
)
def _(spark, sf):
    return evaluate.evaluate_boosted(lines(spark, sf), ["unit"], "entity", LI_ORDER, ["x1"], "y", ["raw", "srl"])


@query("l7_evaluate_history")
def _(spark, sf):
    return evaluate.evaluate_linear(
        lines(spark, sf), ["unit"], "entity", LI_ORDER, LID, LI_X, "y", ["raw", "srl", "history"], (0, 1, 2)
    )


@query(
    "l8_context_ladder",
    f"""WITH {LI}, tr AS (SELECT * FROM li WHERE NOT is_test), te AS (SELECT * FROM li WHERE is_test),
    sm AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY unit ORDER BY ('0x' || substr(md5('0|context|' || {LIDH}), 1, 15))::BIGINT, {LIDS}) <= 512),
    {ridge2("ma", "tr", "unit", "x1", "x4", "y", 1.0)}, {ridge2("mb", "sm", "unit", "x1", "x4", "y", 1.0)}
    SELECT s.*, n AS n_context, 'full' AS sampler FROM ({_score("ma", "te", "unit", "b0 + ba * x1 + bb * x4")}) s JOIN (SELECT unit, n FROM ma) USING (unit)
    UNION ALL SELECT s.*, n, 'random512' FROM ({_score("mb", "te", "unit", "b0 + ba * x1 + bb * x4")}) s JOIN (SELECT unit, n FROM mb) USING (unit)""",
    "rmse_overall rmse_macro",
)
def _(spark, sf):
    return evaluate.context_ladder(
        lines(spark, sf), ["unit"], "entity", LI_ORDER, LID, ["x1", "x4"], "y",
        {"full": ("full", 0), "random512": ("random", 512)},
    )


@query("l8_sampler_comparison")
def _(spark, sf):
    modes = {m: (m, 1024) for m in ("random", "recent", "early", "soh_strat", "stage_strat", "cell_balanced", "soh_cell")}
    return evaluate.context_ladder(events(spark, sf).drop("event_type"), ["unit"], "entity", EV_ORDER, ["event_id"], ["x2"], "y", modes)


@query(
    "l9_ablation",
    f"""WITH {LI}, tr AS (SELECT * FROM li WHERE NOT is_test), te AS (SELECT * FROM li WHERE is_test), {ridge2("mb", "tr", "unit", "x1", "x4", "y", 1.0)},
    m1 AS (SELECT unit, avg(y) - covar_pop(x1, y) * count(*) / (var_pop(x1) * count(*) + 1) * avg(x1) AS b0, covar_pop(x1, y) * count(*) / (var_pop(x1) * count(*) + 1) AS ba FROM tr GROUP BY unit),
    m4 AS (SELECT unit, avg(y) - covar_pop(x4, y) * count(*) / (var_pop(x4) * count(*) + 1) * avg(x4) AS b0, covar_pop(x4, y) * count(*) / (var_pop(x4) * count(*) + 1) AS ba FROM tr GROUP BY unit)
    SELECT *, 'both' AS condition FROM ({_score("mb", "te", "unit", "b0 + ba * x1 + bb * x4")}) UNION ALL SELECT *, 'only_x1' FROM ({_score("m1", "te", "unit", "b0 + ba * x1")})
    UNION ALL SELECT *, 'only_x4' FROM ({_score("m4", "te", "unit", "b0 + ba * x4")})""",
    "rmse_overall rmse_macro",
)
def _(spark, sf):
    m = linear.moments(lines(spark, sf), ["unit", "entity", "is_test"], ["x1", "x4"], "y")
    return linear.ablation(
        settled(m), ["unit"], ["x1", "x4"], {"both": ["x1", "x4"], "only_x1": ["x1"], "only_x4": ["x4"]}
    )


@query("l9_family_ablation")
def _(spark, sf):
    d = windows.history_features(lines(spark, sf), LI_KEYS, LI_ORDER, LI_X)
    every = windows.view_columns("history", LI_X)
    m = linear.moments(d, ["unit", "entity", "is_test"], every, "y")
    views = ["raw", "history", *[v for v in windows.VIEWS if v.startswith(("raw+", "history-"))]]
    return linear.ablation(settled(m), ["unit"], every, {v: windows.view_columns(v, LI_X) for v in views})


_ONE = """sg AS (SELECT unit, entity, count(*) AS n, sum(x4) AS sx, sum(y) AS sy, sum(x4 * x4) AS sxx, sum(x4 * y) AS sxy, sum(y * y) AS syy FROM li WHERE NOT is_test GROUP BY ALL),
    rs AS (SELECT unit, entity, sg.n, sg.sx, sg.sy, sg.sxx, sg.sxy, sg.syy, t.n - sg.n AS rn, t.sx - sg.sx AS rx, t.sy - sg.sy AS ry, t.sxx - sg.sxx AS rxx, t.sxy - sg.sxy AS rxy
      FROM sg JOIN (SELECT unit, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM sg GROUP BY unit) t USING (unit))"""
_SSE = "(syy - 2 * b1 * sxy - 2 * b0 * sy + b1 * b1 * sxx + 2 * b0 * b1 * sx + n * b0 * b0)"


@query(
    "l10_loco_estimate",
    f"""WITH {LI}, {_ONE}, bt AS (SELECT *, (rxy - rx * ry / rn) / (rxx - rx * rx / rn + 1) AS b1 FROM rs), bz AS (SELECT *, (ry - b1 * rx) / rn AS b0 FROM bt)
    SELECT unit, entity, sqrt({_SSE} / n) AS rmse FROM bz""",
    "rmse",
)
def _(spark, sf):
    m = linear.moments(lines(spark, sf).filter(~F.col("is_test")), ["unit", "entity"], ["x4"], "y")
    return linear.loco_estimate(settled(m), ["unit"], "entity")


@query(
    "l29_select_alpha",
    f"""WITH {LI}, {_ONE}, bt AS (SELECT *, (rxy - rx * ry / rn) / (rxx - rx * rx / rn + alpha) AS b1 FROM rs, (SELECT unnest([0.1, 1000.0, 1e8, 1e10]::DOUBLE[]) AS alpha)), bz AS (SELECT *, (ry - b1 * rx) / rn AS b0 FROM bt),
    cv AS (SELECT unit, alpha, sqrt(sum({_SSE}) / sum(n)) AS cv FROM bz GROUP BY ALL)
    SELECT unit, arg_min(alpha, cv) AS alpha, min(cv) AS cv_rmse FROM cv GROUP BY unit""",
    "cv_rmse",
)
def _(spark, sf):
    m = linear.moments(lines(spark, sf).filter(~F.col("is_test")), ["unit", "entity"], ["x4"], "y")
    return linear.select_alpha(settled(m), ["unit"], [0.1, 1000.0, 1e8, 1e10]).drop("beta")


_FOLD = f"(row_number() OVER (ORDER BY ('0x' || substr(md5('0|fold|' || {LIDH}), 1, 15))::BIGINT, {LIDS}) - 1) % 5"


@query(
    "l11_out_of_fold",
    f"""WITH {LI}, fd AS (SELECT *, {_FOLD} AS fold FROM li),
    sg AS (SELECT unit, fold, count(*) AS n, sum(x4) AS sx, sum(y) AS sy, sum(x4 * x4) AS sxx, sum(x4 * y) AS sxy FROM fd GROUP BY ALL),
    rs AS (SELECT s.unit, s.fold, t.n - s.n AS n, t.sx - s.sx AS sx, t.sy - s.sy AS sy, t.sxx - s.sxx AS sxx, t.sxy - s.sxy AS sxy
      FROM sg s JOIN (SELECT unit, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM sg GROUP BY unit) t USING (unit)),
    b AS (SELECT unit, fold, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) AS b1, sx, sy, n FROM rs)
    SELECT {LIDS}, (sy - b1 * sx) / n + b1 * x4 AS oof FROM fd JOIN b USING (unit, fold)""",
    "oof",
)
def _(spark, sf):
    d = sampling.kfold(lines(spark, sf), LID, 5)
    return linear.out_of_fold(d, ["unit"], "fold", ["x4"], "y").select(*LID, "oof")


@query("l12_residual_stacking")
def _(spark, sf):
    def run(d):
        tr, te = d.filter(~F.col("is_test")), d.filter("is_test")
        got = models.stack_regression(tr, te, ["x1", "x2", "x3", "x4"], "y", LID, "rf_reg", "gbdt_reg", 1.0, 2)
        return got.groupBy("unit").agg(
            rmse("y", "base").alias("rmse_base"), F.count(F.lit(1)).alias("n"), rmse("y", "pred").alias("rmse")
        )

    return run(_settled_lines(spark, sf, *LID).withColumn("unit", F.lit("all")))


@query("l13_stacking_classification")
def _(spark, sf):
    d = doc_features(spark, sf).withColumn("is_test", F.col("doc_id") % 4 == 0)
    got = models.stack_classification(
        d.filter(~F.col("is_test")), d.filter("is_test"), ["x1", "x2", "x3"], "y", ["doc_id"], 2, "logistic", "rf_reg", 1.0, 2
    )
    return got.select("doc_id", "y", "pred")


@query("l14_context_boosting")
def _(spark, sf):
    d = doc_features(spark, sf).withColumn("is_test", F.col("doc_id") % 4 == 0)
    got, _ = models.context_boosting(
        d.filter(~F.col("is_test")), d.filter("is_test"), ["x1", "x2", "x3"], "y", ["doc_id"], "logistic", "prune", 2, n_folds=2
    )
    return got.select("doc_id", "y", F.col("pred").cast("int").alias("pred"))


@query("l15_distillation")
def _(spark, sf):
    d = windows.history_features(lines(spark, sf), LI_KEYS, LI_ORDER, ["x1"], ["from_first"])
    return models.distill(
        d, ["unit"], "entity", ["x1", "x2", "x3", "x4"], ["x1", "x1__from_first"], "y", [0.0, 0.25, 0.5, 0.75, 1.0]
    )


_LAMS = "(SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS lam)"


@query(
    "l15_mispaired_control",
    f"""WITH {LI}, a AS (SELECT *, x1 - first_value(x1) OVER ({LI_W}) AS ff FROM li),
    ids AS (SELECT DISTINCT unit, entity FROM li),
    rf AS (SELECT unit, entity, coalesce(lead(entity) OVER (PARTITION BY unit ORDER BY {_h("derange", "entity", 11)}, entity),
      first_value(entity) OVER (PARTITION BY unit ORDER BY {_h("derange", "entity", 11)}, entity)) AS ref FROM ids QUALIFY count(*) OVER (PARTITION BY unit) > 1),
    an AS (SELECT unit, entity AS ref, x1 AS anchor FROM li QUALIFY row_number() OVER ({LI_W}) = 1),
    b AS (SELECT a.*, x1 - anchor AS sh FROM a JOIN rf USING (unit, entity) JOIN an USING (unit, ref)),
    fo AS (SELECT unit, entity, (row_number() OVER (PARTITION BY unit ORDER BY {_h("gfold", "entity", 0)}, entity) - 1) % 3 AS fold FROM (SELECT DISTINCT unit, entity FROM b WHERE NOT is_test)),
    tr AS (SELECT b.*, fold FROM b JOIN fo USING (unit, entity) WHERE NOT is_test),
    tx AS (SELECT tr.*, held FROM tr, (SELECT unnest([0, 1, 2]) AS held) WHERE fold <> held), {ridge2("tm", "tx", "unit, held", "x1", "x4", "y", 1.0)},
    bl AS (SELECT tr.*, lam, (1 - lam) * y + lam * (b0 + ba * x1 + bb * x4) AS target FROM tr JOIN tm ON tr.unit = tm.unit AND fold = held, {_LAMS}),
    {ridge2("sm", "bl", "unit, lam", "x1", "ff", "target", 1.0)}, cl AS (SELECT * FROM bl WHERE lam = 0.5), {ridge2("cm", "cl", "unit, lam", "x1", "sh", "target", 1.0)},
    te AS (SELECT b.*, lam FROM b, {_LAMS} WHERE is_test)
    SELECT *, 'distilled' AS arm FROM ({_score("sm", "te", "unit, lam", "b0 + ba * x1 + bb * ff")})
    UNION ALL SELECT *, 'mispaired' FROM ({_score("cm", "te", "unit, lam", "b0 + ba * x1 + bb * sh")})""",
    "rmse_overall rmse_macro",
)
def _(spark, sf):
    d = windows.history_features(lines(spark, sf), LI_KEYS, LI_ORDER, ["x1"], ["from_first"])
    d = windows.mispaired_lift(d, ["unit"], "entity", LI_ORDER, ["x1"], sampling.derangement(d, ["unit"], "entity", 11))
    return models.distill(
        settled(d), ["unit"], "entity", ["x1", "x4"], ["x1", "x1__from_first"], "y", [0.0, 0.25, 0.5, 0.75, 1.0], 3,
        mispaired_xs=["x1", "x1__shuffled"],
    )


def _rank(salt: str, seed: int) -> str:
    return f"row_number() OVER (PARTITION BY unit, repeat ORDER BY ('0x' || substr(md5('{seed}|{salt}|' || event_id || '|' || repeat), 1, 15))::BIGINT, event_id)"


@query(
    "l16_permutation_importance",
    f"""WITH {PR}, tr AS (SELECT * FROM pr WHERE NOT is_test), {ridge2("md", "tr", "unit", "p", "x2", "y", 1.0)},
    te AS (SELECT pr.*, repeat, b0, ba, bb FROM pr JOIN md USING (unit), (SELECT unnest([0, 1, 2]) AS repeat) WHERE is_test),
    a AS (SELECT *, {_rank("slot", 0)} AS k FROM te), d AS (SELECT unit, repeat, p AS dp, x2 AS dx, {_rank("donor", 1)} AS k FROM te),
    j AS (SELECT unit, repeat, entity, y - b0 - ba * p - bb * x2 AS e, ba * (dp - p) AS gp, bb * (dx - x2) AS gx FROM a JOIN d USING (unit, repeat, k)),
    r AS (SELECT unit, repeat, entity, sqrt(avg(e * e)) AS b, sqrt(avg((e - gp) * (e - gp))) AS rp, sqrt(avg((e - gx) * (e - gx))) AS rx FROM j GROUP BY ALL),
    q AS (SELECT unit, repeat, avg(rp - b) AS ip, avg(rx - b) AS ix FROM r GROUP BY ALL)
    SELECT unit, 'p' AS feature, avg(ip) AS importance, stddev_samp(ip) AS std FROM q GROUP BY unit UNION ALL SELECT unit, 'x2', avg(ix), stddev_samp(ix) FROM q GROUP BY unit""",
    "importance std",
)
def _(spark, sf):
    d = predictions(spark, sf)
    model = linear.fit(linear.moments(d.filter(~F.col("is_test")), ["unit"], ["p", "x2"], "y"), 1.0)
    return linear.permutation_importance(d.filter("is_test"), model, ["unit"], "entity", ["event_id"], ["p", "x2"], "y", 3)


_PERM = f"""WITH {EV}, ids AS (SELECT unit, entity, draw FROM (SELECT DISTINCT unit, entity FROM ev), (SELECT unnest(range(20)) AS draw)),
    hh AS (SELECT *, ('0x' || substr(md5(draw || '|derange|' || entity), 1, 15))::BIGINT AS h FROM ids),
    mp AS (SELECT unit, draw, entity, coalesce(lead(entity) OVER w, first_value(entity) OVER w) AS ref FROM hh WINDOW w AS (PARTITION BY unit, draw ORDER BY h, entity)
      UNION ALL SELECT DISTINCT unit, -1, entity, entity FROM ev),
    fs AS (SELECT unit, entity AS ref, x2 AS a FROM ev QUALIFY row_number() OVER ({EV_W}) = 1),
    z AS (SELECT ev.unit, draw, ev.entity, is_test, y, x2, x2 - a AS xa FROM ev JOIN mp USING (unit, entity) JOIN fs USING (unit, ref)),
    tr AS (SELECT * FROM z WHERE NOT is_test), te AS (SELECT * FROM z WHERE is_test), {ridge2("md", "tr", "unit, draw", "x2", "xa", "y", 1.0)},
    sc AS ({_score("md", "te", "unit, draw", "b0 + ba * x2 + bb * xa")})"""


@query("l17_permutation_scores", f"""{_PERM} SELECT unit, CAST(draw AS INTEGER) AS draw, rmse_macro FROM sc""", "rmse_macro")
def _(spark, sf):
    scores, _ = evaluate.permutation_test(events(spark, sf), ["unit"], "entity", EV_ORDER, ["x2"], "y", 20)
    return scores.select("unit", "draw", "rmse_macro")


@query(
    "l17_t8_permutation_p",
    f"""{_PERM}, o AS (SELECT unit, rmse_macro AS obs FROM sc WHERE draw = -1)
    SELECT unit, max(obs) AS observed, count(*) AS n_draws, median(rmse_macro) AS null_median, (1.0 + count(*) FILTER (rmse_macro <= obs)) / (count(*) + 1) AS p FROM sc JOIN o USING (unit) WHERE draw >= 0 GROUP BY unit""",
    "observed null_median p",
)
def _(spark, sf):
    _, p = evaluate.permutation_test(events(spark, sf), ["unit"], "entity", EV_ORDER, ["x2"], "y", 20)
    return p.select("unit", "observed", "n_draws", "null_median", "p")


@query("l18_shift_auc")
def _(spark, sf):
    return models.shift_auc(lines(spark, sf), LI_X, "is_test", LID, 3)


def logistic_sql(src: str, by: str, a: str, b: str, y: str, reg: float, steps: int) -> str:
    """SQL of a two-feature logistic fit per group: one table of sums and one of weights per Newton step, ending in ``lw``."""
    ctes = [
        f"""ls AS MATERIALIZED (SELECT {by}, count(*) AS n, avg({y}) AS share, avg({a}) AS ma, avg({b}) AS mb, stddev_samp({a}) AS sa, stddev_samp({b}) AS sb FROM {src} GROUP BY {by})""",
        f"lz AS MATERIALIZED (SELECT {by}, ({a} - ma) / sa AS u, ({b} - mb) / sb AS v, {y} AS y FROM {src} JOIN ls USING ({by}))",
        f"lw0 AS (SELECT {by}, ln(share / (1 - share)) AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM ls WHERE share > 0 AND share < 1)",
    ]
    for i in range(steps):
        ctes += [
            f"lp{i} AS (SELECT {by}, u, v, y, 1 / (1 + exp(-(w0 + w1 * u + w2 * v))) AS p FROM lz JOIN lw{i} USING ({by}))",
            f"""lh{i} AS MATERIALIZED (SELECT {by}, w0, w1, w2, g0, g1 + {reg} * w1 AS g1, g2 + {reg} * w2 AS g2, h00, h01, h02, h11 + {reg} AS h11, h12, h22 + {reg} AS h22
              FROM lw{i} JOIN (SELECT {by}, avg(p - y) AS g0, avg((p - y) * u) AS g1, avg((p - y) * v) AS g2, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * u) AS h01,
              avg(p * (1 - p) * v) AS h02, avg(p * (1 - p) * u * u) AS h11, avg(p * (1 - p) * u * v) AS h12, avg(p * (1 - p) * v * v) AS h22 FROM lp{i} GROUP BY {by}) USING ({by}))""",
            # the inverse of a symmetric matrix of three rows by its cofactors
            f"""lw{i + 1} AS MATERIALIZED (SELECT {by}, w0 - (c00 * g0 + c01 * g1 + c02 * g2) / det AS w0, w1 - (c01 * g0 + c11 * g1 + c12 * g2) / det AS w1, w2 - (c02 * g0 + c12 * g1 + c22 * g2) / det AS w2
              FROM (SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM (SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02,
              h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22 FROM lh{i})))""",
        ]
    return ", ".join([*ctes, f"lw AS (SELECT * FROM lw{steps} UNION ALL SELECT {by}, CASE WHEN share = 0 THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END, 0, 0 FROM ls WHERE share IN (0, 1))"])


@query(
    "l18_logistic_folds",
    f"""WITH {LI}, s AS (SELECT unit, held AS fold, x1, x4, is_test::INT AS y FROM li, (SELECT unnest([0, 1, 2]) AS held) WHERE l_orderkey % 3 <> held), {logistic_sql("s", "unit, fold", "x1", "x4", "y", 0.01, 6)},
    lf AS (SELECT *, l_orderkey % 3 AS fold FROM li), ou AS (SELECT unit, fold, is_test, 1 / (1 + exp(-(w0 + w1 * (x1 - ma) / sa + w2 * (x4 - mb) / sb))) AS p FROM lf JOIN ls USING (unit, fold) JOIN lw USING (unit, fold)),
    lo AS (SELECT unit, fold, avg(-ln(CASE WHEN is_test THEN p ELSE 1 - p END)) AS log_loss, count(*) AS n_held FROM ou GROUP BY ALL)
    SELECT unit, CAST(fold AS INTEGER) AS fold, n, CASE WHEN share > 0 AND share < 1 THEN w0 - w1 * ma / sa - w2 * mb / sb END AS b0, w1 / sa AS b_x1, w2 / sb AS b_x4, log_loss, n_held FROM ls JOIN lw USING (unit, fold) JOIN lo USING (unit, fold)""",
    "b0 b_x1 b_x4 log_loss",
)
def _(spark, sf):
    xs = ["x1", "x4"]
    d = lines(spark, sf).withColumns({"fold": (F.col("l_orderkey") % 3).cast("int"), "target": F.col("is_test").cast("int")})
    d = settled(d.select("unit", "fold", "target", *xs))
    fitted = settled(logistic.fit(d, ["unit"], xs, "target", 0.01, "fold", 3))
    scored = logistic.predict(d, fitted, ["unit", "fold"], xs)
    loss = -F.ln(F.when(F.col("target") == 1, F.col("proba")).otherwise(1 - F.col("proba")))
    held = scored.groupBy("unit", "fold").agg(F.avg(loss).alias("log_loss"), F.count(F.lit(1)).alias("n_held"))
    return logistic.coefficients(fitted, ["unit", "fold"], xs).join(held, ["unit", "fold"])


@query(
    "l20_random_vs_group_r2",
    f"""WITH {LI}, a AS (SELECT *, {_FOLD.replace("% 5", "% 3")} AS fold FROM li),
    ge AS (SELECT unit, entity, (row_number() OVER (PARTITION BY unit ORDER BY ('0x' || substr(md5('0|gfold|' || entity), 1, 15))::BIGINT, entity) - 1) % 3 AS fold FROM (SELECT DISTINCT unit, entity FROM li)),
    u AS (SELECT 'random' AS kind, unit, fold, x4, y FROM a UNION ALL SELECT 'group', li.unit, ge.fold, x4, y FROM li JOIN ge USING (unit, entity)),
    sg AS (SELECT kind, unit, fold, count(*) AS n, sum(x4) AS sx, sum(y) AS sy, sum(x4 * x4) AS sxx, sum(x4 * y) AS sxy FROM u GROUP BY ALL),
    rs AS (SELECT s.kind, s.unit, s.fold, t.n - s.n AS n, t.sx - s.sx AS sx, t.sy - s.sy AS sy, t.sxx - s.sxx AS sxx, t.sxy - s.sxy AS sxy FROM sg s
      JOIN (SELECT kind, unit, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM sg GROUP BY ALL) t USING (kind, unit)),
    b AS (SELECT kind, unit, fold, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) AS b1, sx, sy, n FROM rs),
    f AS (SELECT kind, unit, fold, 1 - sum(power(y - (sy - b1 * sx) / n - b1 * x4, 2)) / (var_pop(y) * count(*)) AS r2 FROM u JOIN b USING (kind, unit, fold) GROUP BY ALL)
    SELECT unit, avg(r2) FILTER (kind = 'random') AS random_r2, avg(r2) FILTER (kind = 'group') AS group_r2 FROM f GROUP BY unit""",
    "random_r2 group_r2",
)
def _(spark, sf):
    d = lines(spark, sf)
    a = linear.cross_validated_r2(sampling.kfold(d, LID, 3), ["unit"], "fold", ["x4"], "y").withColumnRenamed("r2", "random_r2")
    g = sampling.group_kfold(d, ["unit"], "entity", 3)
    b = linear.cross_validated_r2(g, ["unit"], "fold", ["x4"], "y").withColumnRenamed("r2", "group_r2")
    return a.join(b, "unit")


@query(
    "l21_adaptive_k",
    f"""WITH {EV}, a AS (SELECT unit, entity, avg(x2) / 60 AS loc, avg(y) / 30 AS auc FROM ev GROUP BY ALL)
    SELECT unit, entity, CAST(greatest(20, least(300, CASE WHEN auc > 0.85 THEN floor((CASE WHEN loc > 0.8 THEN 30 WHEN loc > 0.5 THEN 60 ELSE 120 END) * 1.5)
      ELSE (CASE WHEN loc > 0.8 THEN 30 WHEN loc > 0.5 THEN 60 ELSE 120 END) END)) AS INTEGER) AS k FROM a""",
)
def _(spark, sf):
    a = events(spark, sf).groupBy("unit", "entity").agg((F.avg("x2") / 60).alias("loc"), (F.avg("y") / 30).alias("auc"))
    return a.select("unit", "entity", models.adaptive_k(F.col("loc"), F.col("auc")).alias("k"))


@query("l22_retrieval_predict")
def _(spark, sf):
    d = filters.with_position(events(spark, sf), EV_KEYS, EV_ORDER).withColumn("pos", normalize.position_scaled("t"))
    got = models.retrieval_predict(d.filter(~F.col("is_test")), d.filter("is_test"), ["x2", "pos"], "y", "event_id", "knn", 30, 5)
    return got.select("event_id", "cluster", "y", "pred")


@query(
    "l23_effective_rank",
    f"""WITH {LI}, c AS (SELECT unit, corr(x1, x4) AS r FROM li GROUP BY unit)
    SELECT unit, exp(-((1 + r) / 2 * ln((1 + r) / 2) + (1 - r) / 2 * ln((1 - r) / 2))) AS effective_rank,
      exp(-((1 + r) / 2 * ln((1 + r) / 2) + (1 - r) / 2 * ln((1 - r) / 2))) / 2 AS rank_ratio FROM c""",
    "effective_rank rank_ratio",
)
def _(spark, sf):
    return linear.effective_rank(lines(spark, sf), ["unit"], ["x1", "x4"])


@query("l25_nystroem_ridge")
def _(spark, sf):
    d = normalize.source_minmax(lines(spark, sf), ["unit"], LI_X)
    d = models.nystroem(d, ~F.col("is_test"), LI_X, LID, 8)
    xs = [*LI_X, *[f"rbf{i}" for i in range(8)]]
    m = linear.moments(d, ["unit", "entity", "is_test"], xs, "y")
    return linear.ablation(settled(m), ["unit"], xs, {"plain": LI_X, "expanded": xs})


@query(
    "l27_physical_reference",
    f"""WITH {EV}, a AS (SELECT *, row_number() OVER ({EV_W}) - 1 AS t, CASE WHEN event_id % 97 <> 0 THEN x2 / 50 END AS rel FROM ev),
    e AS (SELECT unit, median(y / rel) AS eta, count(*) AS n FROM a WHERE NOT is_test AND t < 30 AND rel > 0 GROUP BY unit HAVING count(*) >= 50),
    s AS (SELECT unit, entity FROM a WHERE is_test AND t >= 30 GROUP BY ALL HAVING count(rel) = count(*))
    SELECT event_id, eta * rel AS pred FROM a JOIN s USING (unit, entity) JOIN e USING (unit) WHERE t >= 30""",
    "pred",
)
def _(spark, sf):
    d = filters.with_position(events(spark, sf), EV_KEYS, EV_ORDER)
    d = d.withColumns({"q": F.when(F.col("event_id") % 97 != 0, F.col("x2")), "nominal": F.lit(50.0), "raw_row": F.col("t")})
    points, _ = models.physical_reference(d, ["unit"], "entity", "y", "q", "nominal", "raw_row", "t", window=30)
    return points.select("event_id", "pred")


@query("l28_curve_scalar_arms")
def _(spark, sf):
    e = events(spark, sf)
    scalar = e.groupBy(*EV_KEYS).agg(F.log10(F.var_pop("x1")).alias("scalar"))
    return evaluate.curve_scalar_arms(e, scalar, ["unit"], "entity", EV_ORDER, ["x2"], "y", 20)


@query(
    "g10_early_slope_reference",
    f"""WITH {LI}, a AS (SELECT unit, entity, is_test, y, row_number() OVER ({LI_W}) - 1 AS t, count(*) OVER (PARTITION BY unit, entity) AS n FROM li),
    k AS (SELECT unit, CASE WHEN min(n) >= 100 THEN 100 WHEN min(n) >= 50 THEN 50 ELSE min(n) END AS k FROM a GROUP BY unit),
    f AS (SELECT unit, entity, is_test, regr_slope(y, t) FILTER (t < k) AS s, max(y) FILTER (t = 0) AS y0, max(y) FILTER (t = n - 1) AS yl FROM a JOIN k USING (unit) GROUP BY ALL),
    tr AS (SELECT unit, s * 1000 AS s, y0, yl FROM f WHERE NOT is_test), {ridge2("md", "tr", "unit", "s", "y0", "yl", 0.0)},
    p AS (SELECT unit, entity, b0 + ba * s * 1000 + bb * y0 AS pred, yl FROM f JOIN md USING (unit) WHERE is_test)
    SELECT p.unit, p.entity, pred AS pred_last, abs(pred - yl) AS terminal_error, sqrt(avg((y - pred) * (y - pred))) AS rmse FROM p JOIN a USING (unit, entity) GROUP BY p.unit, p.entity, pred, yl, a.unit, a.entity""",
    "pred_last terminal_error rmse",
)
def _(spark, sf):
    d = lines(spark, sf)
    feats = trajectory.early_slope(d, ["unit"], "entity", LI_ORDER, "y").withColumn("slope", F.col("slope") * 1000)
    feats = feats.join(d.select("unit", "entity", "is_test").distinct(), ["unit", "entity"])
    got = models.early_slope_reference(feats, ["unit"]).filter("is_test")
    per = d.filter("is_test").select("unit", "entity", "y").join(got, ["unit", "entity"])
    e = F.col("y") - F.col("pred_last")
    return per.groupBy("unit", "entity").agg(
        F.first("pred_last").alias("pred_last"), F.first(F.abs(F.col("pred_last") - F.col("y_last"))).alias("terminal_error"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )


# MLlib backbones -------------------------------------------------------------------------------
def _backbone(spark, sf, name):
    def run(d):
        got = models.fit_predict(d.filter(~F.col("is_test")), d.filter("is_test"), LI_X, "y", name)
        return models.pooled_rmse(got, ["unit"], "y", "pred")

    return models.per_unit(_settled_lines(spark, sf), "unit", run)


def _boosted(spark, sf, params):
    # SQL has no row for a unit without training rows
    got = models.fit_predict_units(_settled_lines(spark, sf), ["unit"], LI_X, "y", params).filter(F.col("pred").isNotNull())
    return models.pooled_rmse(got, ["unit"], "y", "pred")


@query(
    "l3_boosted_splits",
    f"""WITH {LI}, {boosted_sql(LI_X, 3, 2, 16, 20, 0.3)}
    SELECT unit, sqrt(avg((y - pred) * (y - pred))) AS rmse, count(*) AS n FROM done WHERE is_test GROUP BY unit""",
    "rmse",
)
def _(spark, sf):
    return _boosted(spark, sf, boosting.Params(n_trees=3, depth=2, n_bins=16, learning_rate=0.3))


@query(
    "l3_gbdt_regressor",
    f"""WITH {LI}, {boosted_sql(LI_X, 20, 4, 32, 20, 0.1)}
    SELECT unit, sqrt(avg((y - pred) * (y - pred))) AS rmse, count(*) AS n FROM done WHERE is_test GROUP BY unit""",
    "rmse",
)
def _(spark, sf):
    return _boosted(spark, sf, boosting.Params())


@query("l3_gbdt_classifier")
def _(spark, sf):
    d = doc_features(spark, sf).withColumn("is_test", F.col("doc_id") % 4 == 0)
    few = boosting.Params(n_trees=10, depth=3)
    got = models.fit_predict_units(d, [], ["x1", "x2", "x3"], "y", few, classify=True)
    return got.select("doc_id", "y", F.col("pred").cast("int").alias("pred"))


@query("l4_random_forest_regressor")
def _(spark, sf):
    return _backbone(spark, sf, "rf_reg")


@query("l4_logistic_and_forest")
def _(spark, sf):
    d = doc_features(spark, sf).withColumn("is_test", F.col("doc_id") % 4 == 0)
    tr, te = d.filter(~F.col("is_test")), d.filter("is_test")
    out = None
    for name in ("logistic", "rf"):
        got = models.fit_predict(tr, te, ["x1", "x2", "x3"], "y", name)
        one = got.groupBy("unit").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"))
        one = one.withColumn("backbone", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# resumable matrix --------------------------------------------------------------------------------
@query(
    "run_matrix_resume",
    f"""WITH {LI}, tr AS (SELECT * FROM li WHERE NOT is_test AND unit < 'r2'), te AS (SELECT * FROM li WHERE is_test AND unit < 'r2'), {ridge2("md", "tr", "unit", "x1", "x4", "y", 1.0)},
    mn AS (SELECT unit, avg(y) AS m, count(*) AS n FROM tr GROUP BY unit),
    r AS (SELECT unit, 'mean' AS method, sqrt(avg((y - m) * (y - m))) AS rmse FROM te JOIN mn USING (unit) GROUP BY unit
      UNION ALL SELECT unit, 'ridge', sqrt(avg((y - b0 - ba * x1 - bb * x4) * (y - b0 - ba * x1 - bb * x4))) FROM te JOIN md USING (unit) GROUP BY unit
      UNION ALL SELECT unit, 'broken', NULL FROM mn)
    SELECT unit AS dataset, method, CAST(seed AS INTEGER) AS seed, rmse, CASE WHEN method = 'broken' THEN NULL ELSE n END AS n_train, method = 'broken' AS failed, 6 AS first_rows, 0 AS added
    FROM r JOIN mn USING (unit), (SELECT unnest([0, 1]) AS seed) WHERE method <> 'ridge' OR seed = 0""",
    "rmse",
)
def _(spark, sf):
    d = settled(lines(spark, sf))

    def load(unit, seed, noise):
        mine = d.filter(F.col("unit") == unit)
        return run_matrix.Dataset("regression", mine.filter(~F.col("is_test")), mine.filter("is_test"), ["x1", "x4"])

    def mean(data, seed):
        return data.test.crossJoin(F.broadcast(data.train.agg(F.avg("y").alias("pred"))))

    def ridge(data, seed):
        return linear.predict(data.test, linear.fit(linear.moments(data.train, [], data.xs, "y")), [], data.xs)

    def broken(data, seed):
        raise RuntimeError("no such backbone")

    path = sources.scratch_path(spark, "matrix")
    # interrupted after seed 0 of some methods, then completed, then called again
    units, every = ["r0", "r1"], {"mean": mean, "ridge": ridge, "broken": broken}
    first = run_matrix.run_matrix(spark, path, load, units, every, seeds=(0,)).count()
    done = run_matrix.run_matrix(spark, path, load, units, {"mean": mean, "broken": broken}, seeds=(0, 1), retry_failed=False).count()
    again = run_matrix.run_matrix(spark, path, load, units, {"mean": mean, "broken": broken}, seeds=(0, 1), retry_failed=False)
    added = again.count() - done
    return run_matrix.latest(again).select(
        "dataset", "method", "seed", F.col("metrics")["rmse"].alias("rmse"), "n_train", F.col("error").isNotNull().alias("failed"),
        F.lit(first).cast("int").alias("first_rows"), F.lit(added).cast("int").alias("added"),
    )


# neighbours ---------------------------------------------------------------------------------------
EM = "em AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, CAST(label AS INTEGER) AS label FROM embeddings)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("int").alias("label")
    )


def _knn_sql(queries: str, pool: str, k: int, cond: str = "true") -> str:
    return f"""kn AS (SELECT q.id, p.id AS neighbor, list_distance(q.vec, p.vec) AS dist,
      row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, p.vec), p.id) AS rank FROM {queries} q JOIN {pool} p ON {cond}
      QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, p.vec), p.id) <= {k})"""


@query(
    "j8_knn_join",
    f"""WITH {EM}, qs AS (SELECT * FROM em WHERE id % 4 = 0), ps AS (SELECT * FROM em WHERE id % 4 <> 0), {_knn_sql("qs", "ps", 5)} SELECT id, neighbor, dist, CAST(rank AS INTEGER) AS rank FROM kn""",
    "dist",
)
def _(spark, sf):
    d = _vectors(spark, sf)
    return neighbors.knn(d.filter("id % 4 = 0"), d.filter("id % 4 <> 0"), 5)


@query(
    "j9_centroid_neighbors",
    f"""WITH {EM}, ce AS (SELECT label AS cluster, pos, avg(v) AS c FROM (SELECT label, unnest(range(len(vec))) AS pos, unnest(vec) AS v FROM em) GROUP BY ALL),
    cl AS (SELECT cluster, list(c ORDER BY pos) AS c FROM ce GROUP BY cluster)
    SELECT cluster, id AS neighbor, list_distance(vec, c) AS dist, CAST(row_number() OVER (PARTITION BY cluster ORDER BY list_distance(vec, c), id) AS INTEGER) AS rank FROM em, cl
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY list_distance(vec, c), id) <= 12""",
    "dist",
)
def _(spark, sf):
    d = _vectors(spark, sf)
    pos = d.select("label", F.posexplode("vec").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("c"))
    packed = pos.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("c"))
    centres = {r["label"]: [p["c"] for p in r["c"]] for r in packed.collect()}
    return neighbors.nearest_to_centroids(d, [centres[i] for i in sorted(centres)], 12)


@query(
    "j10_discordance",
    f"""WITH {EM}, {_knn_sql("em", "em", 6, "q.label <> p.label")}, g AS (SELECT kn.id, dist, rank, abs(a.vec[1] - b.vec[1]) AS g FROM kn JOIN em a ON a.id = kn.id JOIN em b ON b.id = neighbor),
    pe AS (SELECT id, avg(g) AS m, max(dist) FILTER (rank = 1) AS d1, max(g) FILTER (rank = 1) AS g1 FROM g GROUP BY id), c AS (SELECT quantile_cont(d1, 0.2) AS cut, median(m) AS mm FROM pe)
    SELECT avg(m) AS mean_gap, max(mm) AS median_gap, avg(CASE WHEN d1 <= cut AND g1 > 0.05 THEN 1.0 ELSE 0 END) AS twin_rate, count(*) AS n_query FROM pe, c""",
    "mean_gap median_gap twin_rate",
)
def _(spark, sf):
    d = _vectors(spark, sf).withColumn("y", F.col("vec")[0])
    return neighbors.discordance(d, 6, "y", entity="label")


@query("j11_discordance_by_view")
def _(spark, sf):
    e = windows.history_features(events(spark, sf), EV_KEYS, EV_ORDER, ["x2"], ["from_first", "from_roll5"])
    e = e.withColumn("all", F.lit(0))
    cols = ["x2", "x2__from_first", "x2__from_roll5"]
    e = normalize.pool_standardise(e, ["all"], cols).withColumn("id", F.col("event_id"))
    e = settled(e.withColumns({"raw": neighbors.as_vector(["x2"]), "history": neighbors.as_vector(cols)}))
    raw = neighbors.discordance(e, 10, "y", vec="raw", gap=5.0)
    his = neighbors.discordance(e, 10, "y", vec="history", gap=5.0)
    both = raw.withColumn("view", F.lit("raw")).unionByName(his.withColumn("view", F.lit("history")))
    return both.groupBy().pivot("view", ["raw", "history"]).agg(
        F.max("mean_gap").alias("gap"), F.max("twin_rate").alias("twins")
    ).withColumns(
        {
            "gap_change_pct": (F.col("history_gap") - F.col("raw_gap")) / F.col("raw_gap") * 100,
            # fixed value 1e-9: a view without twins still has a change
            "twin_change_pct": (F.col("history_twins") - F.col("raw_twins")) / (F.col("raw_twins") + 1e-9) * 100,
        }
    )


@query(
    "l5_knn_models",
    f"""WITH {EM}, qs AS (SELECT * FROM em WHERE id % 4 = 0), ps AS (SELECT * FROM em WHERE id % 4 <> 0), {_knn_sql("qs", "ps", 5)},
    v AS (SELECT kn.id, label, count(*) AS c FROM kn JOIN em ON em.id = neighbor GROUP BY ALL), w AS (SELECT id, label AS vote FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, label) = 1),
    r AS (SELECT kn.id, avg(label) AS mean FROM kn JOIN em ON em.id = neighbor GROUP BY kn.id) SELECT id, vote, mean FROM w JOIN r USING (id)""",
    "mean",
)
def _(spark, sf):
    d = _vectors(spark, sf)
    q, p = d.filter("id % 4 = 0"), d.filter("id % 4 <> 0")
    found = settled(neighbors.knn(q, p, 5))
    vote = neighbors.knn_classify(q, p, 5, "label", found).withColumnRenamed("pred", "vote")
    return vote.join(neighbors.knn_regress(q, p, 5, "label", found).withColumnRenamed("pred", "mean"), "id")


@query(
    "j8_forest_knn",
    f"""WITH {LI} SELECT count(*) AS n_queries, true AS recall_reached, true AS below_a_tenth FROM li WHERE l_orderkey % 100 = 0""",
)
def _(spark, sf):
    d = lines(spark, sf).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    d = settled(d.select("id", "l_orderkey", neighbors.as_vector(LI_X).alias("vec")))
    q = d.filter("l_orderkey % 100 = 0")
    index = forest.build(d, exclude="id", n_trees=6, k=5)
    found = forest.search(index, q, 5, exclude="id", probes=1)
    measured = forest.recall(found, neighbors.knn(q, d, 5, exclude="id")).crossJoin(forest.routed_share(index, q, exclude="id", probes=1))
    n = q.agg(F.count(F.lit(1)).alias("n_queries"))
    return n.crossJoin(measured).select("n_queries", (F.col("recall") >= 0.95).alias("recall_reached"), (F.col("share") < 0.1).alias("below_a_tenth"))


@query(
    "l19_knn_locality",
    f"""WITH {EM}, f AS (SELECT *, (row_number() OVER (ORDER BY {_h("fold", "id")}, id) - 1) % 3 AS fold FROM em),
    kn AS (SELECT q.id, q.fold, q.label AS y, p.label AS z FROM f q JOIN f p ON q.fold <> p.fold QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, p.vec), p.id) <= 10),
    pd AS (SELECT id, fold, any_value(y) AS y, avg(z) AS pred FROM kn GROUP BY id, fold), r AS (SELECT fold, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2 FROM pd GROUP BY fold)
    SELECT avg(r2) AS locality FROM r""",
    "locality",
)
def _(spark, sf):
    d = _vectors(spark, sf).withColumn("y", F.col("label").cast("double"))
    dims = [f"v{i}" for i in range(64)]
    d = d.select("id", "y", *[F.col("vec")[i].alias(v) for i, v in enumerate(dims)])
    return models.knn_locality(d, dims, "y", "id")


@query(
    "l24_nearest_distance_ratio",
    f"""WITH {EM}, n AS (SELECT q.id, min(list_distance(q.vec, p.vec)) AS d FROM em q JOIN em p ON q.id <> p.id GROUP BY q.id), s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ('0x' || substr(md5(k || '|distances|' || id), 1, 15))::BIGINT, id) AS r, count(*) OVER (PARTITION BY k) AS n
      FROM em, (SELECT unnest(range(4)) AS k)),
    pr AS (SELECT list_distance(a.vec, b.vec) AS d FROM s a JOIN s b ON a.k = b.k AND b.r = a.r % a.n + 1 AND a.id <> b.id), st AS (SELECT avg(d) AS mean_distance, quantile_cont(d, 0.01) AS radius FROM pr)
    SELECT (SELECT avg(d) FROM n) AS mean_nearest, mean_distance, radius, (SELECT avg(d) FROM n) / mean_distance AS ratio FROM st""",
    "mean_nearest mean_distance radius ratio",
)
def _(spark, sf):
    return neighbors.nearest_distance_ratio(_vectors(spark, sf))


@query("r16_radius_deduplicate")
def _(spark, sf):
    d = settled(_vectors(spark, sf).select("id", "vec"))
    radius = neighbors.nearest_distance_ratio(d).first()["radius"]
    return neighbors.deduplicate(d, float(radius))


# streams ------------------------------------------------------------------------------------------
ENTITIES_PER_STATE = 256


def _event_stream(spark, sf):
    """The events replayed in four arrivals of two files each, one arrival per micro-batch."""
    e = table(spark, sf, "events")
    at = F.col("ts").cast("timestamp").cast("double")
    cuts = e.select(at.alias("at")).approxQuantile("at", [0.25, 0.5, 0.75], 0.01)
    path = sources.scratch_path(spark, "arrivals")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = e if low is None else e.filter(at >= low)
        # rows without a time are the first of their entity, as in batch order
        part = part if high is None else part.filter((at < high) | (at.isNull() if low is None else F.lit(False)))
        part.repartition(2).write.mode("append").parquet(path)
    s = streaming.read_table_stream(spark, path, "*.parquet", e.schema, 2)
    return s.select(
        F.col("user_id").alias("entity"), "ts", "event_id", F.col("value").alias("y"), F.col("value").alias("x1"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("g1"),
    )


def _run_stream(spark, sf, cols, made):
    step, outputs = made
    n = table(spark, sf, "events").agg(F.approx_count_distinct("user_id")).first()[0]
    buckets = max(64, n // ENTITIES_PER_STATE)
    d = streaming.stream_scan(_event_stream(spark, sf), ["entity"], "ts", "event_id", cols, step, outputs, buckets=buckets)
    path = sources.scratch_path(spark, "stream")
    got = streaming.run_to_table(d, f"{path}/rows", f"{path}/checkpoint")
    return streaming.split_late(got)[0].select("event_id", *outputs)


@query(
    "x1_stream_history",
    f"""WITH {EV}, a AS (SELECT *, row_number() OVER ({EV_W}) - 1 AS t FROM ev), h AS (SELECT entity, t, x1 FROM a WHERE t < 5),
    m AS (SELECT b.entity, b.t, median(c.x1) AS anchor FROM h b JOIN h c ON b.entity = c.entity AND c.t <= b.t GROUP BY ALL),
    f AS (SELECT *, coalesce(lag(x1) OVER w, x1) AS l, x1 - first_value(x1) OVER w AS ff, x1 - avg(x1) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS fr FROM a WINDOW w AS ({EV_W}))
    SELECT event_id, l AS x1__lag1, x1 - l AS x1__diff1, ff AS x1__from_first, fr AS x1__from_roll5, x1 - anchor AS x1__from_early FROM f JOIN m ON f.entity = m.entity AND m.t = least(f.t, 4)""",
    "x1__lag1 x1__diff1 x1__from_first x1__from_roll5 x1__from_early",
)
def _(spark, sf):
    return _run_stream(spark, sf, ["x1"], streaming.history_step(["x1"]))


@query(
    "x2_stream_fill",
    f"""WITH {EV} SELECT event_id, coalesce(last_value(g1 IGNORE NULLS) OVER ({EV_W}), 25.0) AS g1__filled FROM ev""",
    "g1__filled",
)
def _(spark, sf):
    return _run_stream(spark, sf, ["g1"], streaming.fill_step(["g1"], {"g1": 25.0}))


@query(
    "x3_stream_smoothing",
    f"""WITH {EV}, a AS (SELECT *, avg(y) OVER ({EV_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM ev), b AS (SELECT event_id, entity, y, row_number() OVER ({EV_W}) AS t FROM ev),
    i AS (SELECT event_id, min(m) AS iso FROM (SELECT k.event_id, avg(j.y) OVER (PARTITION BY k.event_id ORDER BY j.t DESC) AS m FROM b k JOIN b j ON j.entity = k.entity AND j.t <= k.t) GROUP BY event_id)
    SELECT event_id, min(y) OVER ({EV_W}) AS y__cummin, m AS y__causal_mean, min(m) OVER ({EV_W}) AS y__causal_sm, iso AS y__iso_causal FROM a JOIN i USING (event_id)""",
    "y__cummin y__causal_mean y__causal_sm y__iso_causal",
)
def _(spark, sf):
    return _run_stream(spark, sf, ["y"], streaming.smoothing_step("y"))


@query("x4_batch_equals_stream", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM events")
def _(spark, sf):
    cols = [f"x1__{f}" for f in ("lag1", "diff1", "from_first", "from_roll5")]
    stream = _run_stream(spark, sf, ["x1"], streaming.history_step(["x1"]))
    batch = windows.history_features(events(spark, sf), EV_KEYS, EV_ORDER, ["x1"])
    bad = streaming.differences(batch, stream, ["event_id"], cols, 1e-6)
    return stream.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(bad.agg(F.count(F.lit(1)).alias("n_different")))
