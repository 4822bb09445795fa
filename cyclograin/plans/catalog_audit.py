"""Queries for curves, joins, alignment, sampling, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclograin import sources
from cyclograin.functions import hash_key
from cyclograin.operators import align, curves, filters, joins, normalize, sampling, trajectory
from cyclograin.operators.attach import settled
from cyclograin.operators.ordered import Ordered, ordinal
from cyclograin.operators.ranks import quantiles
from cyclograin.plans import bindings
from cyclograin.plans.bindings import (
    CU, DO, EV, EV_ALL, EV_KEYS, EV_ORDER, EV_W, LI, PR, RUNS,
    doc_features, events, lines, predictions, runs, table,
)
from cyclograin.plans.registry import query

C_W = "PARTITION BY entity, cycle ORDER BY k"
ISLANDS = """isl AS (SELECT *, k - row_number() OVER (PARTITION BY entity, cycle, {c} ORDER BY k) AS g FROM pt),
  ru AS (SELECT entity, cycle, min(k) AS s, max(k) + 1 AS e FROM isl WHERE {c} GROUP BY entity, cycle, g),
  lr AS (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY entity, cycle ORDER BY e - s DESC, s) = 1)"""


def _h(salt: str, key: str, seed: int = 0) -> str:
    return f"('0x' || substr(md5('{seed}|{salt}|' || {key}), 1, 15))::BIGINT"


def _curves(spark, sf):
    return bindings.curves(spark, sf)


def _numbered(spark, sf):
    d = Ordered(_curves(spark, sf), ["entity"], ["cycle"]).with_scans(no=ordinal())
    return d.withColumn("no", F.col("no") + 1)


# curves -------------------------------------------------------------------------------------
@query(
    "c1_longest_run",
    f"""WITH {CU}, {ISLANDS.format(c="(i > 0)")} SELECT entity, cycle, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS stop FROM lr""",
)
def _(spark, sf):
    mask = F.transform("pts", lambda p: p["i"] > 0)
    d = _curves(spark, sf).withColumn("r", curves.longest_run(mask))
    return d.select("entity", "cycle", "r.start", "r.stop")


@query(
    "c2_c3_charge_and_duration",
    f"""WITH {CU}, s AS (SELECT *, (i + lag(i) OVER ({C_W})) / 2 * (t - lag(t) OVER ({C_W})) AS a FROM pt)
    SELECT entity, cycle, sum(a) / 3600 AS ah, CASE WHEN count(*) FILTER (i > 1) >= 2 THEN max(t) FILTER (i > 1) - min(t) FILTER (i > 1) END AS s FROM s GROUP BY ALL""",
    "ah s",
)
def _(spark, sf):
    return _curves(spark, sf).select(
        "entity", "cycle", curves.charge_ah("pts").alias("ah"), curves.masked_duration("pts", lambda p: p["i"] > 1).alias("s")
    )


@query(
    "c4_low_current_window",
    f"""WITH {CU}, {ISLANDS.format(c="(i <= 0.5)")}, w AS (SELECT pt.*, row_number() OVER (PARTITION BY entity, cycle ORDER BY k) AS r FROM pt JOIN lr USING (entity, cycle) WHERE k >= s AND k < e),
    a AS (SELECT *, (i + lag(i) OVER ({C_W})) / 2 * (t - lag(t) OVER ({C_W})) AS a FROM w)
    SELECT entity, cycle, CASE WHEN count(*) >= 2 THEN sum(a) / 3600 END AS ah, CASE WHEN count(*) >= 2 THEN max(t) - min(t) END AS s,
      CASE WHEN count(*) >= 2 THEN avg(i) END AS i_mean FROM a GROUP BY ALL""",
    "ah s i_mean",
)
def _(spark, sf):
    return _curves(spark, sf).withColumn("w", curves.low_current_window("pts")).select("entity", "cycle", "w.*")


@query(
    "c5_positive_segments",
    f"""WITH {CU}, s AS (SELECT *, CASE WHEN i > 0 AND lag(i) OVER ({C_W}) > 0 THEN (i + lag(i) OVER ({C_W})) / 2 * (t - lag(t) OVER ({C_W})) ELSE 0 END AS a FROM pt)
    SELECT entity, cycle, CASE WHEN max(i) > 0 AND count(*) >= 2 THEN sum(a) / 3600 END AS ah FROM s GROUP BY ALL""",
    "ah",
)
def _(spark, sf):
    return _curves(spark, sf).select("entity", "cycle", curves.positive_segments_ah("pts").alias("ah"))


GRID = [3.0 + 0.05 * i for i in range(21)]


@query(
    "c6_resample_grid",
    f"""WITH {CU}, gr AS (SELECT unnest(range(21)) AS gi), u AS (SELECT entity, cycle, v, arg_min(q, k) AS q FROM pt GROUP BY ALL),
    z AS (SELECT entity, cycle, gi, 3.0::DOUBLE + 0.05::DOUBLE * gi AS g FROM (SELECT DISTINCT entity, cycle FROM pt), gr),
    b AS (SELECT z.entity, z.cycle, gi, g, max(CASE WHEN v <= g THEN v END) AS v0, arg_max(CASE WHEN v <= g THEN q END, CASE WHEN v <= g THEN v END) AS q0,
      min(CASE WHEN v >= g THEN v END) AS v1, arg_min(CASE WHEN v >= g THEN q END, CASE WHEN v >= g THEN v END) AS q1
      FROM z JOIN u ON z.entity = u.entity AND z.cycle = u.cycle GROUP BY ALL)
    SELECT entity, cycle, CAST(gi AS INTEGER) AS gi, CASE WHEN v0 IS NULL OR v1 IS NULL THEN NULL WHEN v1 = v0 THEN q0 ELSE q0 + (q1 - q0) * (g - v0) / (v1 - v0) END AS q FROM b""",
    "q",
)
def _(spark, sf):
    d = curves.resample(_curves(spark, sf), "pts", GRID)
    return d.select("entity", "cycle", F.posexplode("grid").alias("gi", "q"))


TIMES = [60.0, 120.0, 180.0, 240.0, 300.0]


@query(
    "c7_interpolate_times",
    f"""WITH {CU}, z AS (SELECT unnest([65.0, 125.0, 300.0, 700.0]::DOUBLE[]) AS g)
    SELECT entity, cycle, g, CASE WHEN max(t) < g THEN NULL ELSE
      arg_max(i, t) FILTER (t <= g) + (arg_min(i, t) FILTER (t >= g) - arg_max(i, t) FILTER (t <= g)) *
      (CASE WHEN min(t) FILTER (t >= g) = max(t) FILTER (t <= g) THEN 0 ELSE (g - max(t) FILTER (t <= g)) / (min(t) FILTER (t >= g) - max(t) FILTER (t <= g)) END) END AS v
    FROM pt, z GROUP BY entity, cycle, g""",
    "g v",
)
def _(spark, sf):
    times = [65.0, 125.0, 300.0, 700.0]
    vals = curves.interpolate_at("pts", "i", times)
    pairs = F.arrays_zip(F.array(*[F.lit(t) for t in times]).alias("g"), vals.alias("v"))
    d = _curves(spark, sf).withColumn("z", F.explode(pairs))
    return d.select("entity", "cycle", "z.g", "z.v")


@query(
    "c8_early_stats",
    f"""WITH {CU} SELECT entity, cycle, avg(i) AS mean, stddev_pop(i) AS std, regr_slope(i, t) AS slope FROM pt WHERE t <= 300 GROUP BY ALL""",
    "mean std slope",
)
def _(spark, sf):
    head = F.filter("pts", lambda p: p["t"] <= 300)
    return _curves(spark, sf).withColumn("s", curves.early_stats(head, "i")).select("entity", "cycle", "s.*")


@query(
    "c9_early_layout",
    f"""WITH {CU}, h AS (SELECT * FROM pt WHERE t <= 300)
    SELECT entity, cycle, {", ".join(f"max({c}) FILTER (t = {int(g)}) AS {c}_at_{int(g)}" for c in "ivq" for g in TIMES)},
      {", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, regr_slope({c}, t) AS {c}_slope" for c in "ivq")},
      cycle / 200.0 AS position, CAST(entity AS DOUBLE) AS condition_1 FROM h GROUP BY ALL""",
    " ".join([f"{c}_at_{int(g)}" for c in "ivq" for g in TIMES] + [f"{c}_{s}" for c in "ivq" for s in ("mean", "std", "slope")] + ["position", "condition_1"]),
)
def _(spark, sf):
    d = curves.early_layout(
        _curves(spark, sf), "pts", ["i", "v", "q"], TIMES, 300.0, F.col("cycle"), [F.col("entity").cast("double")]
    )
    return d.drop("pts")


@query(
    "c10_difference_scalar",
    f"""WITH {CU}, cy AS (SELECT entity, cycle, row_number() OVER (PARTITION BY entity ORDER BY cycle) AS no FROM (SELECT DISTINCT entity, cycle FROM pt)),
    n AS (SELECT entity, count(*) AS n_cycles FROM cy GROUP BY entity), z AS (SELECT 3.0::DOUBLE + 0.05::DOUBLE * unnest(range(21)) AS g),
    b AS (SELECT pt.entity, no, g, max(v) FILTER (v <= g) AS v0, arg_max(q, v) FILTER (v <= g) AS q0, min(v) FILTER (v >= g) AS v1, arg_min(q, v) FILTER (v >= g) AS q1
      FROM pt JOIN cy USING (entity, cycle), z WHERE no IN (10, 40) GROUP BY ALL),
    q AS (SELECT entity, no, g, CASE WHEN v1 = v0 THEN q0 ELSE q0 + (q1 - q0) * (g - v0) / (v1 - v0) END AS q FROM b),
    d AS (SELECT a.entity, var_pop(b.q - a.q) AS vr FROM q a JOIN q b ON a.entity = b.entity AND a.g = b.g WHERE a.no = 10 AND b.no = 40 GROUP BY a.entity)
    SELECT entity, CAST(n_cycles AS INTEGER) AS n_cycles, CASE WHEN n_cycles >= 40 THEN log10(vr) END AS scalar, CASE WHEN n_cycles < 40 THEN 'too_few_cycles' END AS reason FROM n LEFT JOIN d USING (entity)""",
    "scalar",
)
def _(spark, sf):
    return curves.difference_scalar(_numbered(spark, sf), ["entity"], "no", "pts", GRID, 10, 40).drop("share")


@query(
    "c11_charge_windows",
    f"""WITH {CU}, cc AS (SELECT *, (i + lag(i) OVER ({C_W})) / 2 * (t - lag(t) OVER ({C_W})) AS a FROM pt WHERE v <= 3.6 AND i >= 0.4),
    cv AS (SELECT *, (i + lag(i) OVER ({C_W})) / 2 * (t - lag(t) OVER ({C_W})) AS a FROM pt WHERE v >= 3.6),
    x AS (SELECT entity, cycle, sum(a) / 3600 AS ah, CASE WHEN count(*) >= 2 THEN max(t) - min(t) END AS s FROM cc GROUP BY ALL),
    y AS (SELECT entity, cycle, sum(a) / 3600 AS ah, CASE WHEN count(*) >= 2 THEN max(t) - min(t) END AS s FROM cv GROUP BY ALL)
    SELECT y.entity, median(x.ah) AS cc_ah, median(x.s) AS cc_s, median(y.ah) AS cv_ah, median(y.s) AS cv_s FROM y LEFT JOIN x ON x.entity = y.entity AND x.cycle = y.cycle GROUP BY y.entity""",
    "cc_ah cc_s cv_ah cv_s",
)
def _(spark, sf):
    got = curves.charge_windows("pts", 3.6, 0.4)
    d = _curves(spark, sf).select("entity", "cycle", *[c.alias(n) for n, c in got.items()])
    return curves.entity_medians(d, ["entity"], list(got))


@query(
    "c12_charge_readings",
    f"""WITH {CU}, s AS (SELECT *, CASE WHEN i > 0 AND lag(i) OVER ({C_W}) > 0 THEN (i + lag(i) OVER ({C_W})) / 2 * (t - lag(t) OVER ({C_W})) ELSE 0 END AS a FROM pt),
    c AS (SELECT entity, cycle, sum(a) / 3600 AS ah FROM s GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cycle) AS no FROM c)
    SELECT entity, max(ah) FILTER (no = 10) AS ah_early, max(ah) FILTER (no = 40) AS ah_late, median(ah) AS ah_median FROM n GROUP BY entity""",
    "ah_early ah_late ah_median",
)
def _(spark, sf):
    d = _numbered(spark, sf).select("entity", "no", curves.positive_segments_ah("pts").alias("ah"))
    return curves.charge_readings(d, ["entity"], "no", "ah", 10, 40)


@query(
    "c13_reconcile",
    f"""WITH {CU}, m AS (SELECT entity, median(i) AS a, median(q) AS b FROM pt GROUP BY entity), r AS (SELECT entity, avg(i) AS a, avg(q) AS b FROM pt GROUP BY entity)
    SELECT entity, abs(m.a - r.a) / abs(r.a) AS a_dev, abs(m.b - r.b) / abs(r.b) AS b_dev,
      abs(m.a - r.a) / abs(r.a) <= 0.5 AND abs(m.b - r.b) / abs(r.b) <= 0.5 AS reconciled FROM m JOIN r USING (entity)""",
    "a_dev b_dev",
)
def _(spark, sf):
    p = _curves(spark, sf).select("entity", F.explode("pts").alias("p")).select("entity", F.col("p.i").alias("a"), F.col("p.q").alias("b"))
    ours = curves.entity_medians(p, ["entity"], ["a", "b"])
    rel = p.groupBy("entity").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return curves.reconcile(ours, rel, ["entity"], ["a", "b"], 0.5)


@query(
    "c14_closure",
    f"""WITH {CU}, s AS (SELECT *, (i + lag(i) OVER ({C_W})) / 2 * (t - lag(t) OVER ({C_W})) AS a FROM pt),
    c AS (SELECT entity, cycle, abs(sum(a) / 3600 - arg_max(q, k)) AS gap FROM s GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cycle) AS no FROM c)
    SELECT entity, max(gap) AS max_gap, count(*) AS n_checked FROM n WHERE no IN (10, 20, 40) GROUP BY entity""",
    "max_gap",
)
def _(spark, sf):
    return curves.closure(_numbered(spark, sf), ["entity"], "no", "pts", [10, 20, 40])


@query(
    "c15_coverage",
    """WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), s AS (SELECT label % 2 AS lib, CASE WHEN n >= 50 THEN 'ok' ELSE 'insufficient_cycles' END AS st FROM n)
    SELECT lib, count(*) AS n, count(*) FILTER (st = 'ok') AS n_ok, count(*) FILTER (st <> 'ok') AS n_insufficient, avg(CASE WHEN st = 'ok' THEN 1.0 ELSE 0 END) AS share_ok FROM s GROUP BY lib""",
    "share_ok",
)
def _(spark, sf):
    d = curves.difference_scalar(_numbered(spark, sf), ["entity"], "no", "pts", GRID, 10, 50)
    d = d.withColumns({"status": curves.scalar_status("scalar", "reason"), "lib": (F.col("entity").cast("int") % 2)})
    return curves.coverage_by_status(d, ["lib"], "status")


@query(
    "p14_p15_units_and_gate",
    f"""WITH {CU}, s AS (SELECT entity, cycle, max(t * 60) FILTER (i * 1.1 > 0) - min(t * 60) FILTER (i * 1.1 > 0) AS sp FROM pt GROUP BY ALL),
    a AS (SELECT *, (i + lag(i) OVER ({C_W})) * 1.1 / 2 * (t - lag(t) OVER ({C_W})) * 60 AS a FROM pt)
    SELECT entity, cycle, CASE WHEN max(sp) <= 37000 THEN sum(a) / 3600 END AS ah, max(sp) AS span FROM a JOIN s USING (entity, cycle) GROUP BY entity, cycle""",
    "ah span",
)
def _(spark, sf):
    d = _curves(spark, sf).withColumn("pts", filters.to_seconds("pts", 1.1))
    d = d.withColumns({"span": filters.charge_span("pts"), "kept": filters.gate_long_charge("pts", 37000.0)})
    return d.select("entity", "cycle", curves.charge_ah("kept").alias("ah"), "span")


# joins ------------------------------------------------------------------------------------------
@query(
    "j1_j6_pending_grid",
    f"""WITH {RUNS}, g AS (SELECT u.unit, a.arm, s.seed FROM (SELECT DISTINCT unit FROM runs) u, (SELECT DISTINCT arm FROM runs) a, (SELECT unnest(range(6)) AS seed) s),
    r AS (SELECT unit, arm, seed FROM runs WHERE n_rows % 5 <> 0)
    SELECT unit, arm, CAST(seed AS INTEGER) AS seed FROM g ANTI JOIN r USING (unit, arm, seed)""",
)
def _(spark, sf):
    r = runs(spark, sf).withColumn("error", F.when(F.col("n_rows") % 5 == 0, "failed"))
    seeds = r.select(F.explode(F.sequence(F.lit(0), F.lit(5))).alias("seed")).distinct()
    g = joins.grid(r.select("unit").distinct(), r.select("arm").distinct(), seeds)
    return joins.pending(g, r, ["unit", "arm", "seed"])


@query(
    "j2_pair_arms",
    f"""WITH {RUNS} SELECT unit, seed, max(rmse) FILTER (arm = 'click') AS click, max(rmse) FILTER (arm = 'view') AS "view" FROM runs GROUP BY unit, seed
    HAVING count(*) FILTER (arm = 'click') > 0 AND count(*) FILTER (arm = 'view') > 0""",
    "click view",
)
def _(spark, sf):
    return joins.pair_arms(runs(spark, sf), ["unit", "seed"], "arm", "rmse", ["click", "view"])


def _mapping(spark, sf):
    """Raw series = all events; processed series = events whose hash keeps them."""
    e = filters.with_position(events(spark, sf), EV_KEYS, EV_ORDER, "raw_row")
    kept = e.filter(hash_key(1, "kept", "event_id") % 10 > 0)
    kept = filters.with_position(kept, EV_KEYS, EV_ORDER, "proc_row")
    return kept.select("unit", "entity", "proc_row", "raw_row", "event_id")


MAPPING = f"""rw AS (SELECT *, row_number() OVER ({EV_W}) - 1 AS raw_row FROM ev),
  mp AS (SELECT unit, entity, event_id, raw_row, row_number() OVER ({EV_W}) - 1 AS proc_row FROM rw WHERE {_h("kept", "event_id", 1)} % 10 > 0)"""


@query(
    "j3_map_rows",
    f"""WITH {EV}, {MAPPING} SELECT rw.event_id, CASE WHEN mp.raw_row < 60 THEN CAST(mp.raw_row AS INTEGER) ELSE -1 END AS raw_row FROM rw LEFT JOIN mp ON rw.unit = mp.unit AND rw.entity = mp.entity AND rw.raw_row = mp.proc_row""",
)
def _(spark, sf):
    e = filters.with_position(events(spark, sf), EV_KEYS, EV_ORDER, "t").withColumn("n_raw", F.lit(60))
    d = joins.map_rows(e, _mapping(spark, sf), EV_KEYS, "t", "proc_row", "raw_row", "n_raw")
    return d.select("event_id", F.coalesce("raw_row", F.lit(-1)).alias("raw_row"))


@query(
    "j4_p6_exclude_with_audit",
    f"""WITH {EV}, b AS (SELECT entity, count(*) AS n, max(y) AS m FROM ev GROUP BY entity)
    SELECT 'kept' AS part, count(*) AS n, '' AS reasons FROM ev JOIN b USING (entity) WHERE n >= 60 AND m < 300
    UNION ALL SELECT 'dropped', count(*), CASE WHEN n < 60 AND m >= 300 THEN 'extreme,short' WHEN n < 60 THEN 'short' ELSE 'extreme' END AS r FROM b WHERE n < 60 OR m >= 300 GROUP BY r""",
)
def _(spark, sf):
    e = events(spark, sf)
    per = e.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("m"))
    kept, audit = joins.exclude(e, ["entity"], {"short": per.filter("n < 60"), "extreme": per.filter("m >= 300")})
    a = kept.agg(F.lit("kept").alias("part"), F.count(F.lit(1)).alias("n"), F.lit("").alias("reasons"))
    b = audit.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.lit("dropped").alias("part"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


@query(
    "j5_reference_rows",
    f"""WITH {EV}, ids AS (SELECT DISTINCT unit, entity, {_h("derange", "entity", 5)} AS h FROM ev),
    m AS (SELECT unit, entity, coalesce(lead(entity) OVER (PARTITION BY unit ORDER BY h, entity), first_value(entity) OVER (PARTITION BY unit ORDER BY h, entity)) AS ref FROM ids),
    f AS (SELECT unit, entity AS ref, x1 AS x1__first FROM ev QUALIFY row_number() OVER ({EV_W}) = 1)
    SELECT unit, entity, ref, x1__first FROM m JOIN f USING (unit, ref)""",
)
def _(spark, sf):
    from cyclograin.operators import windows

    e = events(spark, sf)
    ref = sampling.derangement(e, ["unit"], "entity", 5)
    firsts = windows.first_rows(e, EV_KEYS, EV_ORDER, ["x1"]).withColumnRenamed("entity", "ref")
    return ref.join(firsts, ["unit", "ref"])


@query(
    "j7_leave_one_out",
    f"""WITH {LI}, s AS (SELECT unit, entity, sum(y) AS s, count(*) AS n FROM li WHERE NOT is_test GROUP BY ALL)
    SELECT a.unit, a.entity, sum(b.s) / sum(b.n) AS mean_others FROM s a JOIN s b ON a.unit = b.unit AND a.entity <> b.entity GROUP BY ALL""",
    "mean_others",
)
def _(spark, sf):
    d = lines(spark, sf).filter(~F.col("is_test"))
    s = joins.leave_one_out(d, ["unit"], "entity", {"s": F.col("y"), "n": F.lit(1)})
    return s.filter("n > 0").select("unit", "entity", (F.col("s") / F.col("n")).alias("mean_others"))


@query(
    "j14_gap_list",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE value > 200), b AS (SELECT DISTINCT user_id FROM events WHERE value < 0.2)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'missing in raw' ELSE 'missing in processed' END AS reason
    FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    return joins.gap_list(e.filter("value > 200"), e.filter("value < 0.2"), ["user_id"], "raw", "processed")


def _aligned(spark, sf):
    e = filters.with_position(events(spark, sf), EV_KEYS, EV_ORDER, "raw_row")
    kept = e.filter(hash_key(1, "kept", "event_id") % 10 > 0)
    kept = filters.with_position(kept, EV_KEYS, EV_ORDER, "proc_row")
    # one entity in ten is rescaled, so the identity check has something to find
    gain = F.when(F.col("entity") % 10 == 9, 1.2).otherwise(1.0)
    kept = kept.withColumn("value", F.col("y") * gain)
    return align.align(
        e.withColumn("value", F.col("y")).select(*EV_KEYS, "raw_row", "value"),
        kept.select(*EV_KEYS, "proc_row", "value"), EV_KEYS, "raw_row", "proc_row", "value",
    )


@query(
    "j12_align",
)
def _(spark, sf):
    return _aligned(spark, sf).select("unit", "entity", "proc_row", "raw_row", "tol")


@query("j13_j15_identity_gate")
def _(spark, sf):
    v = align.verdict(_aligned(spark, sf), EV_KEYS)
    return joins.release_gate(v).select(*EV_KEYS, "matched", "matched_ratio", "ratio_median", "identity_status", "status", "gate")


@query(
    "j16_availability_audit",
    f"""WITH {EV}, {MAPPING}, sc AS (SELECT unit, entity, proc_row, CASE WHEN event_id % 397 <> 0 THEN raw_row END AS raw_row FROM mp WHERE proc_row >= 20),
    p AS (SELECT unit, entity, count(*) AS n_scored, count(raw_row) AS n_mapped, min(raw_row) AS raw_min, max(raw_row) AS raw_max FROM sc GROUP BY ALL)
    SELECT unit, entity, n_scored, n_mapped, CAST(raw_min AS INTEGER) AS raw_min, CAST(raw_max AS INTEGER) AS raw_max,
      CASE WHEN n_scored > n_mapped OR raw_min <= 22 THEN 'violation' ELSE 'ok' END AS status,
      concat_ws(',', CASE WHEN n_scored > n_mapped THEN 'unmapped_rows=' || (n_scored - n_mapped) END, CASE WHEN raw_min <= 22 THEN 'min_raw_cycle=' || raw_min END) AS violations FROM p""",
)
def _(spark, sf):
    m = _mapping(spark, sf).withColumn("raw_row", F.when(F.col("event_id") % 397 != 0, F.col("raw_row")))
    rows = m.select(*EV_KEYS, F.col("proc_row").alias("t")).filter("t >= 20")
    scored = joins.map_rows(rows, m, EV_KEYS, "t", "proc_row", "raw_row")
    return joins.availability_audit(events(spark, sf), scored, EV_KEYS, "raw_row", 22)


@query(
    "j17_prefix_agreement",
    f"""WITH {EV}, a AS (SELECT unit, entity, y, row_number() OVER ({EV_W}) AS t FROM ev), b AS (SELECT unit, entity, y, row_number() OVER ({EV_W}) AS t FROM ev WHERE g1 IS NOT NULL),
    p AS (SELECT a.unit, a.entity, a.y AS x, b.y AS z FROM a JOIN b ON a.unit = b.unit AND a.entity = b.entity AND a.t = b.t),
    r AS (SELECT *, rank() OVER (PARTITION BY unit, entity ORDER BY x) + (count(*) OVER (PARTITION BY unit, entity, x) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY unit, entity ORDER BY z) + (count(*) OVER (PARTITION BY unit, entity, z) - 1) / 2.0 AS rz FROM p)
    SELECT unit, entity, count(*) AS n, corr(rx, rz) AS rho, max(abs(x - z) / greatest(abs(z), 1e-12)) AS max_dev FROM r GROUP BY ALL""",
    "rho max_dev",
)
def _(spark, sf):
    e = events(spark, sf)
    return joins.prefix_agreement(e, e.filter(F.col("g1").isNotNull()), EV_KEYS, EV_ORDER, "y")


@query(
    "j18_l30_cost_scenarios",
    f"""WITH {EV}, c AS (SELECT unit, sum(y) / count(DISTINCT entity) AS per_entity FROM ev GROUP BY unit)
    SELECT unit, per_entity * 10000 AS cpu_s, p.w AS power_w, g.c AS g_per_kwh, per_entity * 10000 * p.w / 3.6e6 AS kwh, per_entity * 10000 * p.w / 3.6e6 * g.c / 1000 AS kg_co2
    FROM c, (VALUES (15.0::DOUBLE), (65.0)) p(w), (VALUES (50.0::DOUBLE), (400.0), (700.0)) g(c)""",
    "cpu_s kwh kg_co2 power_w g_per_kwh", 3,
)
def _(spark, sf):
    c = events(spark, sf).groupBy("unit").agg((F.sum("y") / F.count_distinct("entity") * 10000).alias("cpu_s"))
    return joins.scenarios(c, "cpu_s", [15.0, 65.0], [50.0, 400.0, 700.0])


@query(
    "j19_gain_with_statistics",
    f"""WITH {PR}, s AS (SELECT *, p - lag(p) OVER ({EV_W}) AS d FROM pr),
    e AS (SELECT unit, entity, CASE WHEN count(d) >= 2 THEN stddev_pop(d) ELSE 0 END AS roughness, sqrt(avg((y - q) * (y - q))) - sqrt(avg((y - p) * (y - p))) AS gain FROM s GROUP BY ALL),
    r AS (SELECT unit, rank() OVER (PARTITION BY unit ORDER BY roughness) AS a, rank() OVER (PARTITION BY unit ORDER BY gain) AS b FROM e)
    SELECT unit, count(*) AS n, CASE WHEN count(*) >= 4 THEN corr(a, b) END AS rho FROM r GROUP BY unit""",
    "rho",
)
def _(spark, sf):
    from cyclograin.functions import rmse

    p = predictions(spark, sf)
    stats = trajectory.violation_ratio(p, EV_KEYS, EV_ORDER, "p")
    gains = p.groupBy(*EV_KEYS).agg((rmse("y", "q") - rmse("y", "p")).alias("gain"))
    return joins.gain_with_statistics(gains, stats, EV_KEYS, "gain", "roughness", ["unit"])


@query(
    "j20_against_published",
    f"""WITH {RUNS}, o AS (SELECT unit, avg(rmse) AS ours FROM runs GROUP BY unit), p AS (SELECT unit, median(y) AS published FROM ev GROUP BY unit)
    SELECT unit, ours, published, (ours - published) / published * 100 AS delta, ours < published AS better FROM o JOIN p USING (unit)""",
    "ours published delta",
)
def _(spark, sf):
    published = quantiles(events(spark, sf), ["unit"], {"pub": ("y", 0.5)})
    return joins.against_published(runs(spark, sf), published, ["unit"], "rmse", "pub")


# sampling -----------------------------------------------------------------------------------------
@query(
    "r1_context_sample",
    f"""WITH {EV} SELECT event_id FROM ev QUALIFY row_number() OVER (PARTITION BY unit ORDER BY {_h("context", "event_id", 4)}, event_id) <= 512""",
)
def _(spark, sf):
    return sampling.context_sample(events(spark, sf), ["unit"], ["event_id"], 512, 4).select("event_id")


@query(
    "r2_end_sample",
    f"""WITH {EV}, a AS (SELECT *, row_number() OVER (PARTITION BY unit, entity ORDER BY ts DESC, event_id DESC) AS pos, {_h("end-recent", "event_id", 4)} AS h, count(*) OVER (PARTITION BY unit) AS n,
      greatest(1, floor(700.0 / (SELECT count(DISTINCT entity) FROM ev b WHERE b.unit = ev.unit))) AS budget FROM ev)
    SELECT event_id FROM a QUALIFY row_number() OVER (PARTITION BY unit ORDER BY (pos > budget AND n > 700), h, event_id) <= 700""",
)
def _(spark, sf):
    d = sampling.end_sample(events(spark, sf).drop("event_type"), ["unit"], "entity", EV_ORDER, ["event_id"], "recent", 700, 4)
    return d.select("event_id")


_QUOTA = """ QUALIFY row_number() OVER (PARTITION BY unit ORDER BY (r > quota AND n > {cap}), h, event_id) <= {cap}"""


def _quota_sql(group: str, seed: int, cap: int, src: str) -> str:
    return f"""q1 AS (SELECT *, {_h("quota", "event_id", seed)} AS h, count(*) OVER (PARTITION BY unit) AS n FROM {src}),
    q2 AS (SELECT *, row_number() OVER (PARTITION BY unit, {group} ORDER BY h, event_id) AS r FROM q1),
    gc AS (SELECT unit, greatest(1, floor({cap}.0 / count(*))) AS quota FROM (SELECT DISTINCT unit, {group} FROM q1) GROUP BY unit)
    SELECT event_id FROM q2 JOIN gc USING (unit) {_QUOTA.format(cap=cap)}"""


@query(
    "r3_r4_label_stratified",
    f"""WITH {EV}, ed AS (SELECT unit, quantile_cont(y, [{", ".join(f"{i / 10}" for i in range(1, 10))}]) AS ed FROM ev GROUP BY unit),
    b AS (SELECT ev.*, len(list_filter(ed, lambda e: e <= y)) AS bin FROM ev JOIN ed USING (unit)), {_quota_sql("bin", 2, 500, "b")}""",
)
def _(spark, sf):
    return sampling.coverage_sample(events(spark, sf), ["unit"], "entity", ["event_id"], "soh_strat", 500, 2).select("event_id")


@query(
    "r5_stage_stratified",
    f"""WITH {EV}, s AS (SELECT *, (row_number() OVER ({EV_W}) - 1)::DOUBLE / greatest(count(*) OVER ({EV_ALL}) - 1, 1) AS stage FROM ev),
    b AS (SELECT *, least(9, CAST(floor(stage * 10 / (1 + 1e-9)) AS INTEGER)) AS bin FROM s), {_quota_sql("bin", 2, 500, "b")}""",
)
def _(spark, sf):
    d = normalize.with_stage(events(spark, sf), EV_KEYS, EV_ORDER)
    return sampling.coverage_sample(d, ["unit"], "entity", ["event_id"], "stage_strat", 500, 2).select("event_id")


@query("r6_entity_balanced", f"""WITH {EV}, {_quota_sql("entity", 2, 500, "ev")}""")
def _(spark, sf):
    return sampling.coverage_sample(events(spark, sf), ["unit"], "entity", ["event_id"], "cell_balanced", 500, 2).select("event_id")


@query(
    "r7_label_by_entity",
    f"""WITH {EV}, ed AS (SELECT unit, quantile_cont(y, [0.2, 0.4, 0.6, 0.8]) AS ed FROM ev GROUP BY unit),
    b AS (SELECT ev.*, len(list_filter(ed, lambda e: e <= y)) AS bin FROM ev JOIN ed USING (unit)), {_quota_sql("entity, bin", 2, 500, "b")}""",
)
def _(spark, sf):
    return sampling.coverage_sample(events(spark, sf), ["unit"], "entity", ["event_id"], "soh_cell", 500, 2).select("event_id")


@query(
    "r8_coverage_diagnostics",
    f"""WITH {EV}, s AS (SELECT *, (row_number() OVER ({EV_W}) - 1)::DOUBLE / greatest(count(*) OVER ({EV_ALL}) - 1, 1) AS stage FROM ev),
    c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY unit ORDER BY {_h("context", "event_id", 9)}, event_id) <= 400),
    fr AS (SELECT [{", ".join(f"{i / 20}" for i in range(21))}] AS f),
    qa AS (SELECT unit, quantile_cont(y, [{", ".join(f"{i / 20}" for i in range(21))}]) AS qa, max(y) - min(y) AS ra, count(DISTINCT entity) AS ea FROM s GROUP BY unit),
    qs AS (SELECT unit, quantile_cont(y, [{", ".join(f"{i / 20}" for i in range(21))}]) AS qs, max(y) - min(y) AS rs, count(DISTINCT entity) AS es, stddev_pop(stage) AS stage_std FROM c GROUP BY unit)
    SELECT unit, list_avg(list_transform(range(21), lambda i: abs(qs[i + 1] - qa[i + 1]))) AS label_distance, rs / (ra + 1e-9) AS range_ratio, es::DOUBLE / ea AS entity_coverage, stage_std FROM qa JOIN qs USING (unit)""",
    "label_distance range_ratio entity_coverage stage_std",
)
def _(spark, sf):
    d = normalize.with_stage(events(spark, sf), EV_KEYS, EV_ORDER)
    s = sampling.context_sample(d, ["unit"], ["event_id"], 400, 9)
    return sampling.coverage_diagnostics(s, d, ["unit"], "entity")


@query(
    "r9_entity_subset",
    f"""WITH {EV} SELECT unit, entity FROM (SELECT DISTINCT unit, entity FROM ev) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY {_h("entities", "entity", 6)}, entity) <= 8""",
)
def _(spark, sf):
    return sampling.entity_subset(events(spark, sf), ["unit"], "entity", 8, 6)


@query(
    "r10_derangements",
    f"""WITH {EV}, ids AS (SELECT unit, entity, m FROM (SELECT DISTINCT unit, entity FROM ev), (SELECT unnest(range(20)) AS m)),
    h AS (SELECT *, ('0x' || substr(md5(m || '|derange|' || entity), 1, 15))::BIGINT AS h FROM ids)
    SELECT unit, CAST(m AS INTEGER) AS m, entity, coalesce(lead(entity) OVER w, first_value(entity) OVER w) AS ref FROM h WINDOW w AS (PARTITION BY unit, m ORDER BY h, entity)""",
)
def _(spark, sf):
    return sampling.derangements(events(spark, sf), ["unit"], "entity", 20)


@query(
    "r11_stratified_split",
    f"""WITH {DO} SELECT doc_id, row_number() OVER (PARTITION BY y ORDER BY {_h("split", "doc_id", 8)}, doc_id) - 1 < round(count(*) OVER (PARTITION BY y) * 0.3) AS is_test FROM dox""",
)
def _(spark, sf):
    return sampling.stratified_split(doc_features(spark, sf), ["y"], ["doc_id"], 0.3, 8).select("doc_id", "is_test")


def _largest_remainder(name: str, src: str, size: str, quota: str, out: str) -> str:
    """SQL of a total shared out over strata by largest remainder."""
    return f"""{name}_a AS (SELECT *, sum({size}) OVER () AS total, {quota} AS q FROM {src}),
    {name}_b AS (SELECT *, ({size} * q) // total AS fl, ({size} * q) % total AS rest FROM {name}_a),
    {name} AS (SELECT * EXCLUDE (total, q, fl, rest), CAST(fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, unit NULLS FIRST, y NULLS FIRST) <= q - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS {out} FROM {name}_b)"""


@query(
    "r11_capped_split",
    f"""WITH {DO}, s0 AS (SELECT unit, y, count(*) AS n FROM dox GROUP BY ALL),
    {_largest_remainder("s1", "s0", "n", "ceil(sum(n) OVER () * 0.3::DOUBLE)::BIGINT", "k")}, s2 AS (SELECT *, n - k AS r FROM s1),
    {_largest_remainder("s3", "s2", "k", "least(sum(k) OVER (), 100)", "t")}, {_largest_remainder("s4", "s3", "r", "least(sum(r) OVER (), 200)", "l")},
    d AS (SELECT doc_id, dox.y, k, t, l, row_number() OVER (PARTITION BY dox.unit, dox.y ORDER BY {_h("split", "doc_id", 8)}, doc_id) - 1 AS p
      FROM dox JOIN s4 ON dox.unit IS NOT DISTINCT FROM s4.unit AND dox.y IS NOT DISTINCT FROM s4.y),
    e AS (SELECT doc_id, y, p < k AS is_test FROM d WHERE CASE WHEN p < k THEN p < t ELSE p - k < l END),
    n AS (SELECT *, row_number() OVER (PARTITION BY is_test ORDER BY {_h("noise", "doc_id", 3)}, doc_id) - 1 < round(count(*) OVER (PARTITION BY is_test) * 0.2) AS hit FROM e)
    SELECT doc_id, is_test, CAST(CASE WHEN hit AND NOT is_test THEN (y + 1 + {_h("class", "doc_id", 3)} % 1) % 2 ELSE y END AS INTEGER) AS y_noisy FROM n""",
)
def _(spark, sf):
    d = sampling.capped_split(doc_features(spark, sf), ["unit", "y"], ["doc_id"], 0.3, 200, 100, 8)
    d = settled(d.select("doc_id", "is_test", "y"))
    noisy = sampling.label_noise(d.filter("NOT is_test"), ["doc_id"], "y", 2, 0.2, 3)
    both = noisy.unionByName(d.filter("is_test").withColumn("y_noisy", F.col("y")))
    return both.select("doc_id", "is_test", "y_noisy")


@query(
    "r12_label_noise",
    f"""WITH n AS (SELECT vec_id, label, row_number() OVER (ORDER BY {_h("noise", "vec_id", 3)}, vec_id) - 1 < round(count(*) OVER () * 0.2) AS hit FROM embeddings)
    SELECT vec_id, CAST(CASE WHEN hit THEN (label + 1 + {_h("class", "vec_id", 3)} % 9) % 10 ELSE label END AS INTEGER) AS y_noisy FROM n""",
)
def _(spark, sf):
    return sampling.label_noise(table(spark, sf, "embeddings"), ["vec_id"], "label", 10, 0.2, 3).select("vec_id", "y_noisy")


@query(
    "r13_target_noise",
    f"""WITH {EV}, n AS (SELECT event_id, y, row_number() OVER (ORDER BY {_h("target", "event_id", 3)}, event_id) - 1 < round(count(*) OVER () * 0.1) AS hit, stddev_pop(y) OVER () AS sd,
      ({_h("gauss-a", "event_id", 3)} % 1000000007) / 1000000007.0::DOUBLE AS u1, ({_h("gauss-b", "event_id", 3)} % 1000000007) / 1000000007.0::DOUBLE AS u2 FROM ev)
    SELECT event_id, CASE WHEN hit THEN y + 2 * sd * sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2) ELSE y END AS y_noisy FROM n""",
    "y_noisy",
)
def _(spark, sf):
    return sampling.target_noise(events(spark, sf), ["event_id"], "y", 0.1, 3).select("event_id", "y_noisy")


@query(
    "r14_folds",
    f"""WITH {DO}, g AS (SELECT s_suppkey AS k, CAST((row_number() OVER (PARTITION BY s_nationkey ORDER BY {_h("gfold", "s_suppkey", 2)}, s_suppkey) - 1) % 4 AS INTEGER) AS f FROM supplier)
    SELECT 'plain' AS kind, doc_id AS k, CAST((row_number() OVER (ORDER BY {_h("fold", "doc_id", 2)}, doc_id) - 1) % 5 AS INTEGER) AS f FROM dox
    UNION ALL SELECT 'strata', doc_id, CAST((row_number() OVER (PARTITION BY y ORDER BY {_h("fold", "doc_id", 2)}, doc_id) - 1) % 5 AS INTEGER) FROM dox
    UNION ALL SELECT 'group', k, f FROM g""",
)
def _(spark, sf):
    d = doc_features(spark, sf)
    a = sampling.kfold(d, ["doc_id"], 5, 2).select(F.lit("plain").alias("kind"), F.col("doc_id").alias("k"), F.col("fold").alias("f"))
    b = sampling.kfold(d, ["doc_id"], 5, 2, ["y"]).select(F.lit("strata").alias("kind"), F.col("doc_id").alias("k"), F.col("fold").alias("f"))
    s = sampling.group_kfold(table(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey", 4, 2)
    return a.unionByName(b).unionByName(s.select(F.lit("group").alias("kind"), F.col("s_suppkey").alias("k"), F.col("fold").alias("f")))


# sources and sinks -----------------------------------------------------------------------------------
@query(
    "s1_s2_csv_series",
    f"""WITH {EV}, a AS (SELECT unit AS entity, event_id, y, CAST(row_number() OVER (PARTITION BY unit ORDER BY ts, event_id) - 1 AS INTEGER) AS record_index FROM ev)
    SELECT entity, event_id, record_index, y / 50.0 AS y, 'strict_online' AS reader FROM a WHERE event_id % 7 <> 0""",
    "y",
)
def _(spark, sf):
    from pyspark.sql import types as T

    e = events(spark, sf)
    path = sources.scratch_path(spark, "series")
    out = e.select("unit", F.col("event_id").cast("double").alias("event_id"), "g1", "y", "ts")
    out = out.repartition("unit").sortWithinPartitions("unit", "ts", "event_id").drop("ts")
    out.write.partitionBy("unit").csv(path, header=True)
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in ("event_id", "g1", "y")])
    raw = sources.read_series_csv(spark, path, schema, r"unit=([^/]+)/")
    cat = raw.select("entity").distinct().withColumns({"unit": F.col("entity"), "nominal": F.lit(50.0)})
    d = sources.load_series(raw, cat, F.col("entity") == "u0", "strict_online", ["g1"], "y")
    return d.select("entity", F.col("event_id").cast("bigint").alias("event_id"), "record_index", "y", "reader")


@query("s3_label_only", "SELECT user_id, event_id, value FROM events")
def _(spark, sf):
    return sources.label_only(table(spark, sf, "events"), ["user_id", "event_id"], "value")


@query(
    "s4_s6_run_archive",
    f"""WITH {RUNS} SELECT unit, arm AS backbone, seed, rmse FROM runs""",
    "rmse",
)
def _(spark, sf):
    path = sources.scratch_path(spark, "runs")
    r = runs(spark, sf).select(
        "unit", F.lit("raw").alias("view"), F.col("arm").alias("backbone"), "seed", F.lit("source").alias("normalize"),
        F.create_map(F.lit("rmse"), F.col("rmse")).alias("metrics"), F.lit(None).cast("string").alias("error"),
    )
    failed = r.withColumns({"metrics": F.lit(None).cast("map<string,double>"), "error": F.lit("failed")})
    sources.append_runs(failed, path)
    sources.append_runs(r, path)
    return sources.read_runs(spark, path).select("unit", "backbone", "seed", F.col("metrics")["rmse"].alias("rmse"))


@query(
    "s5_keyed_archive",
    f"""WITH {RUNS} SELECT unit, arm, 'mean' AS metric, avg(rmse) AS value FROM runs GROUP BY unit, arm UNION ALL SELECT unit, arm, 'worst', max(rmse) FROM runs GROUP BY unit, arm""",
    "value",
)
def _(spark, sf):
    path = sources.scratch_path(spark, "archive")
    r = runs(spark, sf).groupBy("unit", "arm").agg(F.avg("rmse").alias("mean"), F.max("rmse").alias("worst"))
    doc = r.select(
        F.to_json(
            F.create_map(F.concat_ws("|", "unit", "arm"), F.create_map(F.lit("mean"), F.col("mean"), F.lit("worst"), F.col("worst")))
        ).alias("value")
    )
    # every file of the archive is one JSON document
    doc.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.expr("substring(value, 2, length(value) - 2)")), ","), F.lit("}")).alias("value")).write.text(path)
    return sources.read_keyed_archive(spark, path, ["unit", "arm"])


@query(
    "s7_export_csv",
    f"""WITH {RUNS} SELECT unit, arm, seed, rmse, CASE WHEN arm <> 'click' THEN n_rows::DOUBLE END AS n_rows FROM runs""",
    "rmse n_rows",
)
def _(spark, sf):
    path = sources.scratch_path(spark, "export")
    m = F.create_map(F.lit("rmse"), F.col("rmse"))
    more = F.create_map(F.lit("rmse"), F.col("rmse"), F.lit("n_rows"), F.col("n_rows").cast("double"))
    r = runs(spark, sf).withColumn("metrics", F.when(F.col("arm") == "click", m).otherwise(more))
    sources.export_csv(r, ["unit", "arm", "seed"], path)
    return spark.read.csv(path, header=True, schema="unit string, arm string, seed int, n_rows double, rmse double")


@query(
    "s8_versioned_summary",
    f"""WITH {RUNS} SELECT unit, median(rmse) AS median FROM runs GROUP BY unit""",
    "median",
)
def _(spark, sf):
    s = runs(spark, sf).groupBy("unit").agg(F.percentile("rmse", F.lit(0.5)).alias("median"))
    path = sources.write_summary(s, sources.scratch_path(spark, "summary"), "1")
    return spark.read.schema("unit string, median double").json(path)


@query("s9_file_manifest")
def _(spark, sf):
    return sources.file_manifest(spark, sf, "*.parquet")


@query(
    "s10_scored_points",
    f"""WITH {PR} SELECT unit, entity, event_id, y, p FROM pr""",
    "y p",
)
def _(spark, sf):
    path = sources.scratch_path(spark, "points")
    sources.write_scored_points(predictions(spark, sf).select("unit", "entity", "event_id", "y", "p"), path)
    return spark.read.parquet(path).select("unit", "entity", "event_id", "y", "p")


@query(
    "s11_curve_table",
    f"""WITH {CU} SELECT entity, CAST(cycle AS INTEGER) AS cycle, count(*) AS n_points, sum(i) AS total FROM pt GROUP BY ALL""",
    "total",
)
def _(spark, sf):
    path = sources.scratch_path(spark, "curves")
    _curves(spark, sf).select("entity", F.col("cycle").cast("int").alias("cycle"), "pts").write.parquet(path)
    d = sources.read_curves(spark, path)
    total = F.aggregate("pts", F.lit(0.0), lambda a, p: a + p["i"])
    return d.select("entity", "cycle", F.size("pts").cast("bigint").alias("n_points"), total.alias("total"))


@query(
    "s12_dataset_summary",
    f"""WITH {LI}, e AS (SELECT unit, entity, count(*) AS n, min(y) AS y, bool_or(is_test) AS t FROM li GROUP BY ALL)
    SELECT unit, count(*) AS n_entities, count(*) FILTER (t) AS n_held_out, min(n) AS min_rows, max(n) AS max_rows, min(y) AS min_y FROM e GROUP BY ROLLUP (unit)""",
    "min_y",
)
def _(spark, sf):
    return sources.dataset_summary(lines(spark, sf), "unit", "entity", "y")


@query(
    "s13_official_splits",
    f"""WITH {LI} SELECT unit, is_test, entity, row_number() OVER (PARTITION BY unit, is_test ORDER BY entity) - 1 AS position FROM (SELECT DISTINCT unit, is_test, CAST(entity AS VARCHAR) AS entity FROM li)""",
)
def _(spark, sf):
    return sources.official_splits(lines(spark, sf).withColumn("entity", F.col("entity").cast("string")), "unit", "entity")
