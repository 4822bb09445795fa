"""Queries for row filters, splits, normalisation and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclograin.functions import clip, ieee_log
from cyclograin.operators import filters, normalize, windows
from cyclograin.operators import sampling
from cyclograin.operators.ordered import Ordered, ordinal
from cyclograin.plans.bindings import (
    EV, EV_ALL, EV_KEYS, EV_ORDER, EV_W, LI, LI_KEYS, LI_ORDER, LI_W, LI_X, events, lines, table,
)
from cyclograin.plans.registry import query

ID = ["event_id"]
LID = ["l_orderkey", "l_linenumber", "l_partkey", "entity"]
LIDS = ", ".join(LID)


# filters and splits ---------------------------------------------------------------
@query(
    "p1_label_from_nominal",
    f"""WITH {EV}, nom AS (SELECT unit, max(y) AS nominal FROM ev GROUP BY unit)
    SELECT event_id, y / nominal AS soh FROM ev JOIN nom USING (unit)""",
    "soh",
)
def _(spark, sf):
    e = events(spark, sf)
    nominal = e.groupBy("unit").agg(F.max("y").alias("nominal"))
    return filters.with_label(e, nominal, "y", "soh").select("event_id", "soh")


@query(
    "p2_strict_rows",
    f"""WITH {EV} SELECT event_id, entity,
    CAST(row_number() OVER ({EV_W}) - 1 AS INTEGER) AS t FROM ev WHERE g1 IS NOT NULL""",
)
def _(spark, sf):
    d = filters.strict_rows(events(spark, sf), ["g1", "x2"])
    return filters.with_position(d, EV_KEYS, EV_ORDER).select("event_id", "entity", "t")


@query(
    "p3_three_sigma_rows",
    f"""WITH {EV}, s AS (SELECT *, avg(x1) OVER ({EV_ALL}) AS m1, stddev_samp(x1) OVER ({EV_ALL}) AS s1,
      avg(x2) OVER ({EV_ALL}) AS m2, stddev_samp(x2) OVER ({EV_ALL}) AS s2,
      row_number() OVER ({EV_W}) - 1 AS record_index FROM ev)
    SELECT event_id, CAST(record_index AS INTEGER) AS record_index FROM s
    WHERE coalesce(abs(x1 - m1) <= 3 * s1, true) AND coalesce(abs(x2 - m2) <= 3 * s2, true)""",
)
def _(spark, sf):
    d = filters.with_position(events(spark, sf), EV_KEYS, EV_ORDER, "record_index")
    kept = filters.three_sigma_rows(d, EV_KEYS, EV_ORDER, ["x1", "x2"])
    return kept.select("event_id", "record_index")


@query(
    "p4_split_by_substring",
    """SELECT s_name, (s_name LIKE '%4%' OR s_name LIKE '%8%') AS is_test FROM supplier""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_name", filters.split_by_substring("s_name", ["4", "8"]).alias("is_test"))


@query(
    "p5_split_by_index",
    """SELECT s_nationkey, s_name,
      (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name)) % 10 IN (3, 7) AS is_test
    FROM supplier""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey", "s_name")
    return filters.split_by_index(s, "s_nationkey", "s_name", 10, [3, 7])


@query("p6_split_by_ids", "SELECT n_name, n_name IN ('FRANCE', 'CHINA', 'nation_3') AS is_test FROM nation")
def _(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_name", filters.split_by_ids("n_name", ["FRANCE", "CHINA", "nation_3"]).alias("is_test"))


@query(
    "p7_split_by_trailing_number",
    """SELECT c_name, CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) % 5 = 0 AS is_test,
      CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) % 5 = 4 AS is_test_shifted FROM customer""",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_name",
        filters.split_by_trailing_number("c_name", 5).alias("is_test"),
        filters.split_by_trailing_number("c_name", 5, 4).alias("is_test_shifted"),
    )


@query(
    "p8_select_batch",
    "SELECT p_type, count(*) AS n FROM part WHERE p_type LIKE '%S%' GROUP BY p_type",
)
def _(spark, sf):
    d = filters.select_batch(table(spark, sf, "part"), "p_type", "S")
    return d.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p9_plausible",
    f"""WITH {EV}, a AS (SELECT *, count(*) OVER ({EV_ALL}) AS n0 FROM ev),
    b AS (SELECT *, count(*) OVER ({EV_ALL}) AS n1 FROM a WHERE n0 >= 40 AND y > 1 AND y < 100)
    SELECT event_id, entity FROM b WHERE n1 >= 40""",
)
def _(spark, sf):
    d = filters.plausible(events(spark, sf), EV_KEYS, EV_ORDER, "y", 1.0, 100.0, 40)
    return d.select("event_id", "entity")


@query(
    "p10_drop_first",
    f"""WITH {EV}, a AS (SELECT *, row_number() OVER ({EV_W}) - 1 AS t, count(*) OVER ({EV_ALL}) AS n FROM ev)
    SELECT unit, sum(CASE WHEN n - 45 >= 20 AND t >= 45 THEN 1 ELSE 0 END)::BIGINT AS kept,
      count(DISTINCT CASE WHEN n - 45 < 20 THEN entity END) AS skipped FROM a GROUP BY unit""",
)
def _(spark, sf):
    kept, skipped = filters.drop_first(events(spark, sf), EV_KEYS, EV_ORDER, 45)
    k = kept.groupBy("unit").agg(F.count(F.lit(1)).alias("kept"))
    s = skipped.groupBy("unit").agg(F.count(F.lit(1)).alias("skipped"))
    return k.join(s, "unit", "full").na.fill(0, ["kept", "skipped"])


@query(
    "p11_scoring_window",
    f"""WITH {LI}, a AS (SELECT *, row_number() OVER ({LI_W}) - 1 AS t FROM li)
    SELECT unit, count(*) AS n, sum(y) AS total FROM a WHERE t >= 100 GROUP BY unit""",
    "total", 3,
)
def _(spark, sf):
    d = filters.with_position(lines(spark, sf), LI_KEYS, LI_ORDER)
    d = filters.scoring_window(d, "t", 100)
    return d.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))


@query(
    "p12_common_columns",
    f"""WITH {EV} SELECT event_id, x1, g1 FROM ev WHERE g1 IS NOT NULL""",
)
def _(spark, sf):
    e = events(spark, sf).withColumn("h1", F.when(F.col("entity") % 2 == 0, F.col("x2")))
    d = filters.keep_common(e, ["unit", "entity"], ["x1", "g1", "h1"])
    return d.select("event_id", *[c for c in ("x1", "g1", "h1") if c in d.columns])


@query(
    "p13_parse_conditions",
    """WITH n AS (SELECT p_partkey, 'CY' || CAST(25 + p_size AS VARCHAR) || '-0' || CAST(p_size AS VARCHAR)
       || '_' || CAST(1 + p_partkey % 3 AS VARCHAR) || '-#' || CAST(p_partkey AS VARCHAR) AS name FROM part)
    SELECT p_partkey, 25 + p_size AS temperature, (1 + p_partkey % 3)::DOUBLE AS discharge_rate,
      CAST('0' || CAST(p_size AS VARCHAR) AS DOUBLE) / power(10.0, length(CAST(p_size AS VARCHAR))) AS charge_rate
    FROM n JOIN part USING (p_partkey)""",
    "charge_rate discharge_rate",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    name = F.format_string(
        "CY%d-0%d_%d-#%d", F.col("p_size") + 25, "p_size", F.col("p_partkey") % 3 + 1, "p_partkey"
    )
    got = filters.parse_conditions("name")
    return p.withColumn("name", name).select(
        "p_partkey", *[got[c].alias(c) for c in ("temperature", "charge_rate", "discharge_rate")]
    )


@query(
    "p16_missing_flags",
    f"""WITH {EV} SELECT event_id, CASE WHEN g1 IS NULL THEN 1.0 ELSE 0.0 END AS g1__missing,
    CASE WHEN x2 IS NULL THEN 1.0 ELSE 0.0 END AS x2__missing,
    (CASE WHEN g1 IS NULL THEN 1.0 ELSE 0.0 END + CASE WHEN x2 IS NULL THEN 1.0 ELSE 0.0 END) / 2 AS missing_share
    FROM ev""",
    "g1__missing x2__missing missing_share",
)
def _(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", *[c.alias(n) for n, c in filters.missing_flags(["g1", "x2"]).items()])


@query(
    "p18_scalar_projections",
    """SELECT event_id, greatest(least(value, 50.0), 5.0) AS clipped, log10(value) AS lg, sqrt(value) AS root,
    abs(value - 25) AS dev, ln(value) AS nat, exp(-value / 100) AS decay FROM events""",
    "clipped lg root dev nat decay",
)
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", clip(v, 5.0, 50.0).alias("clipped"), ieee_log(v, F.log10).alias("lg"), F.sqrt(v).alias("root"),
        F.abs(v - 25).alias("dev"), ieee_log(v).alias("nat"), F.exp(-v / 100).alias("decay"),
    )


@query(
    "p19_wide_and_long",
    """WITH a AS (SELECT user_id AS entity, event_type, avg(value) AS m FROM events GROUP BY ALL),
    w AS (SELECT entity, max(CASE WHEN event_type='click' THEN m END) AS click,
      max(CASE WHEN event_type='view' THEN m END) AS "view", max(CASE WHEN event_type='error' THEN m END) AS "error"
      FROM a GROUP BY entity)
    SELECT entity, 'click' AS arm, click AS m FROM w UNION ALL SELECT entity, 'view', "view" FROM w
    UNION ALL SELECT entity, 'error', "error" FROM w""",
    "m",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    a = e.groupBy(F.col("user_id").alias("entity"), "event_type").agg(F.avg("value").alias("m"))
    wide = filters.to_wide(a, ["entity"], "event_type", "m", ["click", "view", "error"])
    return filters.to_long(wide, ["entity"], ["click", "view", "error"], "arm", "m")


# normalisation --------------------------------------------------------------------
@query(
    "n1_entity_minmax",
    f"""WITH {EV}, s AS (SELECT event_id, x1, x2, min(x1) OVER ({EV_ALL}) AS a1, max(x1) OVER ({EV_ALL}) AS b1,
      min(x2) OVER ({EV_ALL}) AS a2, max(x2) OVER ({EV_ALL}) AS b2 FROM ev)
    SELECT event_id, 2 * (x1 - a1) / (CASE WHEN b1 = a1 THEN 1 ELSE b1 - a1 END) - 1 AS x1,
      2 * (x2 - a2) / (CASE WHEN b2 = a2 THEN 1 ELSE b2 - a2 END) - 1 AS x2 FROM s""",
    "x1 x2",
)
def _(spark, sf):
    d = normalize.entity_minmax(events(spark, sf), EV_KEYS, EV_ORDER, ["x1", "x2"])
    return d.select("event_id", "x1", "x2")


@query(
    "n2_source_minmax",
    f"""WITH {LI}, s AS (SELECT unit, min(x1) AS a1, max(x1) AS b1, min(x4) AS a4, max(x4) AS b4
      FROM li WHERE NOT is_test GROUP BY unit)
    SELECT {LIDS}, 2 * (x1 - a1) / (CASE WHEN b1 = a1 THEN 1 ELSE b1 - a1 END) - 1 AS x1,
      2 * (x4 - a4) / (CASE WHEN b4 = a4 THEN 1 ELSE b4 - a4 END) - 1 AS x4 FROM li JOIN s USING (unit)""",
    "x1 x4",
)
def _(spark, sf):
    return normalize.source_minmax(lines(spark, sf), ["unit"], ["x1", "x4"]).select(*LID, "x1", "x4")


@query(
    "n3_pool_standardise",
    f"""WITH {LI}, s AS (SELECT unit, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x4) AS m4, stddev_pop(x4) AS s4
      FROM li WHERE NOT is_test GROUP BY unit)
    SELECT {LIDS}, (x1 - m1) / (s1 + 1e-9) AS x1, (x4 - m4) / (s4 + 1e-9) AS x4 FROM li JOIN s USING (unit)""",
    "x1 x4",
)
def _(spark, sf):
    d = normalize.pool_standardise(lines(spark, sf), ["unit"], ["x1", "x4"], ~F.col("is_test"))
    return d.select(*LID, "x1", "x4")


@query(
    "n4_entity_scalar_zscore",
    f"""WITH {EV}, e AS (SELECT unit, entity, is_test, max(x1) AS v FROM ev GROUP BY ALL),
    s AS (SELECT unit, avg(v) AS m, stddev_pop(v) AS sd FROM e WHERE NOT is_test GROUP BY unit)
    SELECT unit, entity, (v - m) / (sd + 1e-12) AS z FROM e JOIN s USING (unit)""",
    "z",
)
def _(spark, sf):
    e = events(spark, sf).groupBy("unit", "entity", "is_test").agg(F.max("x1").alias("v"))
    return normalize.entity_scalar_zscore(e, ["unit"], "entity", "v", "z").select("unit", "entity", "z")


@query(
    "n5_n6_n7_positions",
    f"""WITH {EV}, a AS (SELECT event_id, row_number() OVER ({EV_W}) - 1 AS t, count(*) OVER ({EV_ALL}) AS n FROM ev)
    SELECT event_id, t / 200.0 AS scaled, 2.0 * t / greatest(n - 1, 1) - 1 AS pos_minmax,
      t::DOUBLE / greatest(n - 1, 1) AS stage FROM a""",
    "scaled pos_minmax stage",
)
def _(spark, sf):
    d = filters.with_position(events(spark, sf), EV_KEYS, EV_ORDER)
    d = normalize.with_position_minmax(d, EV_KEYS, EV_ORDER, "pos_minmax")
    d = normalize.with_stage(d, EV_KEYS, EV_ORDER)
    return d.select("event_id", normalize.position_scaled("t").alias("scaled"), "pos_minmax", "stage")


# window features -------------------------------------------------------------------
_HIST = ", ".join(
    f"""coalesce(lag({c}) OVER w, {c}) AS {c}__lag1, {c} - coalesce(lag({c}) OVER w, {c}) AS {c}__diff1,
    {c} - first_value({c}) OVER w AS {c}__from_first,
    {c} - avg({c}) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {c}__from_roll5"""
    for c in ("x1", "x2")
)


def _hist_names(cols):
    return [f"{c}__{f}" for c in cols for f in windows.FAMILIES]


@query(
    "w1_w4_history_features",
    f"WITH {EV} SELECT event_id, {_HIST} FROM ev WINDOW w AS ({EV_W})",
    " ".join(_hist_names(["x1", "x2"])),
)
def _(spark, sf):
    d = windows.history_features(events(spark, sf), EV_KEYS, EV_ORDER, ["x1", "x2"])
    return d.select("event_id", *_hist_names(["x1", "x2"]))


@query(
    "w3_self_referenced_lift",
    f"""WITH {LI} SELECT {LIDS}, {", ".join(f"{c} - first_value({c}) OVER w AS {c}__from_first" for c in LI_X)}
    FROM li WINDOW w AS ({LI_W})""",
    " ".join(f"{c}__from_first" for c in LI_X),
)
def _(spark, sf):
    d = windows.history_features(lines(spark, sf), LI_KEYS, LI_ORDER, LI_X, ["from_first"])
    return d.select(*LID, *[f"{c}__from_first" for c in LI_X])


@query(
    "w5_robust_anchor",
    f"""WITH {EV}, a AS (SELECT *, row_number() OVER ({EV_W}) - 1 AS t FROM ev),
    h AS (SELECT unit, entity, t, x1 FROM a WHERE t < 5),
    m AS (SELECT b.unit, b.entity, b.t, median(c.x1) AS anchor FROM h b JOIN h c
      ON b.unit = c.unit AND b.entity = c.entity AND c.t <= b.t GROUP BY ALL)
    SELECT event_id, x1 - anchor AS x1__from_early FROM a JOIN m
      ON a.unit = m.unit AND a.entity = m.entity AND m.t = least(a.t, 4)""",
    "x1__from_early",
)
def _(spark, sf):
    d = windows.history_features(events(spark, sf), EV_KEYS, EV_ORDER, ["x1"], ["from_early"])
    return d.select("event_id", "x1__from_early")


@query(
    "w6_view_history",
    f"""WITH {LI}, p AS (SELECT *, 'x' AS dummy FROM li)
    SELECT {LIDS}, CAST(row_number() OVER w - 1 AS DOUBLE) / 200.0 AS pos, {", ".join(f'''
    {c}, coalesce(lag({c}) OVER w, {c}) AS {c}__lag1, {c} - coalesce(lag({c}) OVER w, {c}) AS {c}__diff1,
    {c} - first_value({c}) OVER w AS {c}__from_first,
    {c} - avg({c}) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {c}__from_roll5''' for c in LI_X)}
    FROM p WINDOW w AS ({LI_W})""",
    "pos " + " ".join([*LI_X, *_hist_names(LI_X)]),
)
def _(spark, sf):
    d = filters.with_position(lines(spark, sf), LI_KEYS, LI_ORDER).withColumn(
        "pos", normalize.position_scaled("t")
    )
    d = windows.build_view(d, LI_KEYS, LI_ORDER, LI_X, "history", "pos")
    return d.select(*LID, *windows.view_columns("history", LI_X, "pos"))


@query(
    "w7_mispaired_lift",
    f"""WITH {EV}, ids AS (SELECT DISTINCT unit, entity,
      ('0x' || substr(md5('11|derange|' || CAST(entity AS VARCHAR)), 1, 15))::BIGINT AS h FROM ev),
    m AS (SELECT unit, entity, coalesce(lead(entity) OVER (PARTITION BY unit ORDER BY h, entity),
      first_value(entity) OVER (PARTITION BY unit ORDER BY h, entity)) AS ref FROM ids),
    f AS (SELECT unit, entity AS ref, arg_min(x1, event_id) AS anchor FROM (
      SELECT * FROM ev QUALIFY row_number() OVER ({EV_W}) = 1) GROUP BY ALL)
    SELECT event_id, x1 - anchor AS x1__shuffled FROM ev JOIN m USING (unit, entity) JOIN f USING (unit, ref)""",
    "x1__shuffled",
)
def _(spark, sf):
    e = events(spark, sf)
    ref = sampling.derangement(e, ["unit"], "entity", 11)
    return windows.mispaired_lift(e, ["unit"], "entity", EV_ORDER, ["x1"], ref).select("event_id", "x1__shuffled")


@query(
    "w8_population_lift",
    f"""WITH {EV}, f AS (SELECT * FROM ev WHERE NOT is_test QUALIFY row_number() OVER ({EV_W}) = 1),
    a AS (SELECT unit, avg(x1) AS a1, avg(x2) AS a2 FROM f GROUP BY unit)
    SELECT event_id, x1 - a1 AS x1__pop, x2 - a2 AS x2__pop FROM ev JOIN a USING (unit)""",
    "x1__pop x2__pop",
)
def _(spark, sf):
    d = windows.population_lift(events(spark, sf), ["unit"], "entity", EV_ORDER, ["x1", "x2"])
    return d.select("event_id", "x1__pop", "x2__pop")


@query(
    "w9_weighted_anchor_lift",
    f"""WITH {EV}, a AS (SELECT *, row_number() OVER ({EV_W}) AS r FROM ev),
    h AS (SELECT unit, entity, sum(x1 * [0.5, 0.3, 0.2][r]) / sum([0.5, 0.3, 0.2][r]) AS anchor
      FROM a WHERE r <= 3 GROUP BY ALL)
    SELECT event_id, x1 - anchor AS x1__wlift FROM a JOIN h USING (unit, entity)""",
    "x1__wlift",
)
def _(spark, sf):
    d = windows.weighted_lift(events(spark, sf), EV_KEYS, EV_ORDER, ["x1"], [0.5, 0.3, 0.2])
    return d.select("event_id", "x1__wlift")


@query(
    "w10_retained_index",
    f"""WITH {EV}, a AS (SELECT *, row_number() OVER ({EV_W}) - 1 AS record_index FROM ev)
    SELECT event_id, CAST(record_index AS INTEGER) AS record_index,
      CAST(row_number() OVER ({EV_W}) - 1 AS INTEGER) AS t FROM a WHERE g1 IS NOT NULL""",
)
def _(spark, sf):
    d = filters.with_position(events(spark, sf), EV_KEYS, EV_ORDER, "record_index")
    d = filters.strict_rows(d, ["g1"])
    return filters.with_position(d, EV_KEYS, EV_ORDER).select("event_id", "record_index", "t")


@query(
    "w11_forward_fill",
    f"""WITH {EV} SELECT event_id, last_value(g1 IGNORE NULLS) OVER w AS g1__ff, g1 IS NULL AS g1__was_missing,
    last_value(g1 IGNORE NULLS) OVER w IS NULL AS g1__still_missing FROM ev WINDOW w AS ({EV_W})""",
)
def _(spark, sf):
    d = windows.forward_fill(events(spark, sf), EV_KEYS, EV_ORDER, ["g1"])
    return d.select("event_id", "g1__ff", "g1__was_missing", "g1__still_missing")


@query(
    "w12_impute_history_only",
    f"""WITH {EV}, m AS (SELECT unit, median(g1) AS med FROM ev WHERE NOT is_test GROUP BY unit)
    SELECT event_id, coalesce(last_value(g1 IGNORE NULLS) OVER w, med, 0.0) AS g1__filled,
      g1 IS NULL AS g1__was_missing FROM ev JOIN m USING (unit) WINDOW w AS ({EV_W})""",
    "g1__filled",
)
def _(spark, sf):
    d = windows.impute_history_only(events(spark, sf), ["unit"], EV_KEYS, EV_ORDER, ["g1"])
    return d.select("event_id", "g1__filled", "g1__was_missing")


@query(
    "w13_w15_causal_smoothing",
    f"""WITH {EV}, a AS (SELECT *, avg(y) OVER ({EV_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS causal_mean FROM ev)
    SELECT event_id, min(y) OVER w AS cummin, causal_mean, min(causal_mean) OVER w AS smooth_cummin
    FROM a WINDOW w AS ({EV_W})""",
    "cummin causal_mean smooth_cummin",
)
def _(spark, sf):
    d = windows.causal_cummin(events(spark, sf), EV_KEYS, EV_ORDER, "y", "cummin")
    d = windows.causal_mean(d, EV_KEYS, EV_ORDER, "y", "causal_mean")
    d = windows.causal_smooth_cummin(d, EV_KEYS, EV_ORDER, "y", "smooth_cummin")
    return d.select("event_id", "cummin", "causal_mean", "smooth_cummin")


@query(
    "w16_rolling_median",
    f"""WITH {EV}, a AS (SELECT *, count(*) OVER ({EV_ALL}) AS n,
      first_value(y) OVER ({EV_W}) AS fy, last_value(y) OVER ({EV_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ly
      FROM ev)
    SELECT event_id, CASE WHEN n < 5 THEN y ELSE list_sort([coalesce(lag(y, 2) OVER w, fy), coalesce(lag(y) OVER w, fy), y,
      coalesce(lead(y) OVER w, ly), coalesce(lead(y, 2) OVER w, ly)])[3] END AS med5 FROM a WINDOW w AS ({EV_W})""",
    "med5",
)
def _(spark, sf):
    return windows.rolling_median5(events(spark, sf), EV_KEYS, EV_ORDER, "y", "med5").select("event_id", "med5")


@query(
    "w20_shift_control",
    f"""WITH {EV}, a AS (SELECT *, y - min(y) OVER ({EV_W}) AS gap FROM ev)
    SELECT event_id, y - avg(gap) OVER ({EV_ALL}) AS shifted FROM a""",
    "shifted",
)
def _(spark, sf):
    return windows.shift_control(events(spark, sf), EV_KEYS, EV_ORDER, "y", "shifted").select("event_id", "shifted")


# ordering, limits and sets -----------------------------------------------------------
@query(
    "o1_o2_entity_order",
    f"""WITH {EV} SELECT event_id, dense_rank() OVER (PARTITION BY unit ORDER BY entity) AS entity_no,
    row_number() OVER ({EV_W}) AS row_no FROM ev""",
)
def _(spark, sf):
    e = events(spark, sf)
    names = Ordered(e.select("unit", "entity").distinct(), ["unit"], ["entity"]).with_scans(k=ordinal())
    d = filters.attach(e, names, ["unit", "entity"])
    d = filters.with_position(d, EV_KEYS, EV_ORDER)
    return d.select("event_id", (F.col("k") + 1).alias("entity_no"), (F.col("t") + 1).alias("row_no"))


@query(
    "o6_first_entities",
    f"""WITH {EV}, e AS (SELECT DISTINCT unit, entity FROM ev QUALIFY dense_rank() OVER (PARTITION BY unit ORDER BY entity) <= 3)
    SELECT unit, entity, count(*) AS n FROM ev JOIN e USING (unit, entity) GROUP BY ALL""",
)
def _(spark, sf):
    e = events(spark, sf)
    heads = sampling.first_entities(e, ["unit"], "entity", 3)
    return e.join(heads, ["unit", "entity"]).groupBy("unit", "entity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u1_u5_set_operations",
    """WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 100),
    b AS (SELECT DISTINCT user_id, event_type FROM events WHERE value < 1)
    SELECT 'only_a' AS part, user_id, event_type FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'both', user_id, event_type FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'any', user_id, event_type FROM (SELECT * FROM a UNION SELECT * FROM b)""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    a = e.filter("value > 100").select("user_id", "event_type").distinct()
    b = e.filter("value < 1").select("user_id", "event_type").distinct()
    keys = ["user_id", "event_type"]
    only = a.join(b, keys, "left_anti").withColumn("part", F.lit("only_a"))
    both = a.join(b, keys, "left_semi").withColumn("part", F.lit("both"))
    either = a.unionByName(b).distinct().withColumn("part", F.lit("any"))
    return only.unionByName(both).unionByName(either, allowMissingColumns=True)
