"""Column formulas, classes and per-row guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import gaps
from .base import CLEAN, FRAME, KEYS, LOG, clean, frame, log, query, table

query("hourly_frame", "series h", "v bz n by_gsm dst", f"{FRAME}, res AS (SELECT * FROM frame)")(frame)
query("clean_frame", "series h quality", "v bz n by_gsm dst pdyn bs theta_c bt pressure dst_star", f"{CLEAN}, res AS (SELECT * FROM clean)")(clean)


@query(
    "physics_columns", "series h", "dst_back newell d_burton d_burton_full d_obrien",
    f"""{CLEAN}, x AS (SELECT *, sin(theta_c / 2) AS s, v * bs AS vb FROM clean),
res AS (SELECT series, h, dst_star + 7.26 * sqrt(greatest(pressure, 0.0)) - 11.0 AS dst_back, pow(v, 4.0 / 3) * pow(bt, 2.0 / 3) * pow(greatest(s, 0.0), 8.0 / 3) AS newell,
  -5.4e-3 * v * bs - dst_star / 7.7 AS d_burton, CASE WHEN vb > 500 THEN -5.4e-3 * (vb - 500) WHEN vb IS NOT NULL THEN 0.0 END - dst_star / 7.7 AS d_burton_full,
  CASE WHEN vb / 1000 > 0.49 THEN -4.4 * (vb / 1000 - 0.49) WHEN vb IS NOT NULL THEN 0.0 END - dst_star / (2.4 * exp(9.74 / (4.69 + vb / 1000))) AS d_obrien
  FROM x WHERE quality = 1 AND by_gsm IS NOT NULL)""",
)
def physics_columns(spark, sf_dir):
    rows = clean(spark, sf_dir).where("quality = 1 and by_gsm is not null")
    return rows.select(
        "series", "h", P.dst_from_star("dst_star", "pressure").alias("dst_back"), P.newell("v", "by_gsm", "bz").alias("newell"), P.burton("v", "bs", "dst_star").alias("d_burton"),
        P.burton_full("v", "bs", "dst_star").alias("d_burton_full"), P.obrien("v", "bs", "dst_star").alias("d_obrien"),
    )


_TERMS = "one v bs n pdyn dst_star v_2 bs_2 n_2 v_bs n_v n_bs pdyn_bs n_v_bs n_v_2 sin_half sin_half_2 sin_half_4 sin_half_8_3 v_sin_half_2 newell"


@query(
    "term_library", "series h", _TERMS,
    f"""{CLEAN}, x AS (SELECT *, sin(theta_c / 2) AS s FROM clean WHERE quality = 1 AND by_gsm IS NOT NULL),
res AS (SELECT series, h, 1.0 AS one, v, bs, n, pdyn, dst_star, v * v AS v_2, bs * bs AS bs_2, n * n AS n_2, v * bs AS v_bs, n * v AS n_v, n * bs AS n_bs, pdyn * bs AS pdyn_bs, n * v * bs AS n_v_bs, n * v * v AS n_v_2,
 s AS sin_half, s * s AS sin_half_2, pow(s, 4) AS sin_half_4, pow(greatest(s, 0), 8.0 / 3) AS sin_half_8_3, v * s * s AS v_sin_half_2, pow(v, 4.0 / 3) * pow(bt, 2.0 / 3) * pow(greatest(s, 0.0), 8.0 / 3) AS newell FROM x)""",
)
def term_library(spark, sf_dir):
    rows = clean(spark, sf_dir).where("quality = 1 and by_gsm is not null")
    return rows.select("series", "h", *[e.alias(name) for name, e in P.library(n_v2=True)])


@query(
    "issue_features", "series h", "bsouth vbsouth bperp clock_sin2 sqrt_pdyn",
    f"""{CLEAN}, res AS (SELECT series, h, bs AS bsouth, 1e-3 * v * bs AS vbsouth, bt AS bperp, CASE WHEN bt = 0 THEN 0.0 ELSE least(greatest((1.0 - bz / bt) / 2, 0.0), 1.0) END AS clock_sin2,
  sqrt(greatest(pdyn, 0.0)) AS sqrt_pdyn FROM clean WHERE quality = 1 AND by_gsm IS NOT NULL)""",
)
def issue_features(spark, sf_dir):
    rows = clean(spark, sf_dir).where("quality = 1 and by_gsm is not null")
    clock = F.when(F.col("bt") == 0, 0.0).otherwise(P.clamp((1.0 - F.try_divide("bz", "bt")) / 2, 0.0, 1.0))
    return rows.select("series", "h", F.col("bs").alias("bsouth"), (1e-3 * F.col("v") * F.col("bs")).alias("vbsouth"), F.col("bt").alias("bperp"), clock.alias("clock_sin2"), F.sqrt(P.positive(F.col("pdyn"))).alias("sqrt_pdyn"))


def memory_features(rows):
    """Differences to one, three and six hours before by time, not by row: neutral zeros unless both one and three hours are there."""
    def at(k, c):
        return rows.select("series", (F.col("h") + k).alias("h"), F.col(c).alias(f"{c}_{k}"))

    joined = rows
    for k, c in ((1, "dst"), (3, "dst"), (6, "dst"), (1, "bz"), (1, "vb")):
        joined = joined.join(at(k, c), ["series", "h"], "left")
    has = F.col("dst").isNotNull() & F.col("dst_1").isNotNull() & F.col("dst_3").isNotNull()
    zero = F.lit(0.0)
    past = gaps.ordered(KEYS)

    def mean(c, w):
        frame_ = past.rangeBetween(-(w - 1), 0)
        return F.when(has, (F.coalesce(F.sum(c).over(frame_), zero) + (w - F.count(c).over(frame_)) * F.col(c)) / w).otherwise(0.0)

    return joined.select(
        "series", "h", "dst", "sqrt_pdyn", "vb", "bs",
        F.when(has, F.col("dst") - F.col("dst_1")).otherwise(0.0).alias("dst_d1"), F.when(has, F.col("dst") - F.col("dst_3")).otherwise(0.0).alias("dst_d3"),
        F.when(has, F.coalesce(F.col("dst") - F.col("dst_6"), zero)).otherwise(0.0).alias("dst_d6"), F.when(has, F.coalesce(F.col("bz") - F.col("bz_1"), zero)).otherwise(0.0).alias("bz_d1"),
        F.when(has, F.coalesce(F.col("vb") - F.col("vb_1"), zero)).otherwise(0.0).alias("vb_d1"), mean("vb", 3).alias("vb_m3"), mean("vb", 6).alias("vb_m6"), mean("bs", 3).alias("bs_m3"), mean("bs", 6).alias("bs_m6"),
    )


_MEMORY_SQL = f"""{CLEAN}, x AS (SELECT series, h, dst, bz, 1e-3 * v * bs AS vb, bs, sqrt(greatest(pdyn, 0.0)) AS sqrt_pdyn FROM clean WHERE quality = 1),
y AS (SELECT x.*, a.dst AS l1, b.dst AS l3, c.dst AS l6, a.bz AS z1, a.vb AS w1, x.dst IS NOT NULL AND a.dst IS NOT NULL AND b.dst IS NOT NULL AS has,
  {", ".join(f"(coalesce(sum(x.{c}) OVER w{k}, 0) + ({k} - count(x.{c}) OVER w{k}) * x.{c}) / {k} AS {n}{k}" for c, n in (("vb", "vm"), ("bs", "bm")) for k in (3, 6))}
  FROM x LEFT JOIN x a ON a.series = x.series AND a.h = x.h - 1 LEFT JOIN x b ON b.series = x.series AND b.h = x.h - 3 LEFT JOIN x c ON c.series = x.series AND c.h = x.h - 6
  WINDOW w3 AS (PARTITION BY x.series ORDER BY x.h RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), w6 AS (PARTITION BY x.series ORDER BY x.h RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)),
mem AS (SELECT series, h, dst, sqrt_pdyn, vb, bs, CASE WHEN has THEN dst - l1 ELSE 0 END AS dst_d1, CASE WHEN has THEN dst - l3 ELSE 0 END AS dst_d3, CASE WHEN has THEN coalesce(dst - l6, 0) ELSE 0 END AS dst_d6,
  CASE WHEN has THEN coalesce(bz - z1, 0) ELSE 0 END AS bz_d1, CASE WHEN has THEN coalesce(vb - w1, 0) ELSE 0 END AS vb_d1, CASE WHEN has THEN vm3 ELSE 0 END AS vb_m3, CASE WHEN has THEN vm6 ELSE 0 END AS vb_m6,
  CASE WHEN has THEN bm3 ELSE 0 END AS bs_m3, CASE WHEN has THEN bm6 ELSE 0 END AS bs_m6 FROM y)"""


def _memory_rows(spark, sf_dir):
    rows = clean(spark, sf_dir).where("quality = 1")
    return memory_features(rows.select("series", "h", "dst", "bz", (1e-3 * F.col("v") * F.col("bs")).alias("vb"), "bs", F.sqrt(P.positive(F.col("pdyn"))).alias("sqrt_pdyn")))


@query("memory_features", "series h", "dst_d1 dst_d3 dst_d6 bz_d1 vb_d1 vb_m3 vb_m6 bs_m3 bs_m6", f"{_MEMORY_SQL}, res AS (SELECT * FROM mem)")
def memory(spark, sf_dir):
    return _memory_rows(spark, sf_dir)


@query(
    "storm_phase_features", "series h guard_active", "main_phase main_phase_6h coupling coupling_6h recovery phase_balance",
    f"""{_MEMORY_SQL}, res AS (SELECT series, h, greatest(-dst_d1, 0) * sqrt_pdyn AS main_phase, greatest(-dst_d6, 0) * sqrt_pdyn AS main_phase_6h, CASE WHEN vb > 0 AND dst_d1 < 0 THEN vb ELSE 0 END AS coupling,
  CASE WHEN vb_m6 > 0 AND dst_d6 < 0 THEN vb_m6 ELSE 0 END AS coupling_6h, greatest(dst_d3, 0) * sqrt_pdyn AS recovery, greatest(-dst_d6, 0) * sqrt_pdyn - greatest(dst_d3, 0) * sqrt_pdyn AS phase_balance,
  (vb > 0 AND dst_d1 < 0) OR greatest(-dst_d1, 0) * sqrt_pdyn > 0 AS guard_active FROM mem)""",
)
def storm_phase_features(spark, sf_dir):
    m = _memory_rows(spark, sf_dir)
    main, main6, rec = (P.positive(x) * F.col("sqrt_pdyn") for x in (-F.col("dst_d1"), -F.col("dst_d6"), F.col("dst_d3")))
    on = (F.col("vb") > 0) & (F.col("dst_d1") < 0)
    return m.select(
        "series", "h", main.alias("main_phase"), main6.alias("main_phase_6h"), F.when(on, F.col("vb")).otherwise(0.0).alias("coupling"),
        F.when((F.col("vb_m6") > 0) & (F.col("dst_d6") < 0), F.col("vb_m6")).otherwise(0.0).alias("coupling_6h"), rec.alias("recovery"), (main6 - rec).alias("phase_balance"), (on | (main > 0)).alias("guard_active"),
    )


@query(
    "forecast_log", "series issue_h step target_h", "latest persistence burton obrien obs", f"{LOG}, res AS (SELECT * FROM log)",
)
def forecast_log(spark, sf_dir):
    return log(spark, sf_dir)


@query(
    "guards", "series issue_h step", "guarded spread depth_safe climatology tail_tau low high winkler",
    f"""{LOG}, x AS (SELECT *, least(burton, obrien) AS ds, greatest(persistence, burton, obrien) - least(persistence, burton, obrien) AS spread FROM log),
y AS (SELECT *, ds - 15 AS low, ds + 15 AS high FROM x),
res AS (SELECT series, issue_h, step, least(greatest(least(burton, latest - greatest(step * 0.5, 0.0)), -2000.0), 50.0) AS guarded, spread, ds AS depth_safe, latest * exp(-step / 12.0) AS climatology,
  least(48.0, 3.0 * (1 + greatest(0.0, -(burton - latest) / step) / 7.5)) AS tail_tau, low, high,
  CASE WHEN obs IS NOT NULL THEN (high - low) + 20 * greatest(low - obs, 0) + 20 * greatest(obs - high, 0) END AS winkler FROM y)""",
)
def guards(spark, sf_dir):
    """Storm guard, expert spread, depth-safe centre, relaxation and interval score of each forecast."""
    x = log(spark, sf_dir).withColumns({"depth_safe": F.least("burton", "obrien"), "spread": F.greatest("persistence", "burton", "obrien") - F.least("persistence", "burton", "obrien")})
    x = x.withColumns({"low": F.col("depth_safe") - 15, "high": F.col("depth_safe") + 15})
    tau = F.least(F.lit(48.0), 3.0 * (1 + F.greatest(F.lit(0.0), -(F.col("burton") - F.col("latest")) / F.col("step")) / 7.5))
    miss = 20 * P.positive(F.col("low") - F.col("obs")) + 20 * P.positive(F.col("obs") - F.col("high"))
    return x.select(
        "series", "issue_h", "step", P.clamp(F.least(F.col("burton"), F.col("latest") - F.greatest(F.col("step") * 0.5, F.lit(0.0))), P.STATE_LOW, P.STATE_HIGH).alias("guarded"), "spread", "depth_safe",
        (F.col("latest") * F.exp(-F.col("step") / 12.0)).alias("climatology"), tau.alias("tail_tau"), "low", "high", (F.col("high") - F.col("low") + miss).alias("winkler"),
    )


@query(
    "classes", "series h activity depth severity threat phase coupling_class", "",
    f"""{CLEAN}, x AS (SELECT *, lag(dst_star) OVER (PARTITION BY series ORDER BY h) AS p FROM clean),
res AS (SELECT series, h, CASE WHEN dst > -30 THEN 'quiet' ELSE 'disturbed' END AS activity, CASE WHEN dst <= -100 THEN 'deep' WHEN dst <= -50 THEN 'moderate' ELSE 'shallow' END AS depth,
  CASE WHEN dst <= -200 THEN 'superintense' WHEN dst <= -100 THEN 'intense' WHEN dst <= -50 THEN 'moderate' WHEN dst IS NOT NULL THEN 'quiet' END AS severity,
  CASE WHEN dst <= -200 THEN 3 WHEN dst <= -100 THEN 2 WHEN dst <= -50 THEN 1 ELSE 0 END AS threat,
  CASE WHEN dst_star > -20 THEN 'quiet' WHEN dst_star - p < 0 THEN 'main' WHEN dst_star IS NOT NULL THEN 'recovery' END AS phase,
  CASE WHEN v * bs > 0 AND dst_star - p < 0 THEN 'active_deepening' WHEN dst_star - p >= 0 AND dst_star <= -30 THEN 'recovery' ELSE 'quiet' END AS coupling_class FROM x)""",
)
def classes(spark, sf_dir):
    change = F.col("dst_star") - F.lag("dst_star").over(gaps.ordered(KEYS))
    x = clean(spark, sf_dir).withColumn("change", change)
    phase = F.when(F.col("dst_star") > -20, "quiet").when(F.col("change") < 0, "main").when(F.col("dst_star").isNotNull(), "recovery")
    regime = F.when((F.col("v") * F.col("bs") > 0) & (F.col("change") < 0), "active_deepening").when((F.col("change") >= 0) & (F.col("dst_star") <= -30), "recovery").otherwise("quiet")
    return x.select("series", "h", P.activity("dst").alias("activity"), P.depth("dst").alias("depth"), P.severity("dst").alias("severity"), P.severity_rank("dst").alias("threat"), phase.alias("phase"), regime.alias("coupling_class"))


@query(
    "storm_cells", "cell n_rows", "mean_error",
    f"""{LOG}, x AS (SELECT obs - burton AS e, unnest(list_filter([CASE WHEN obs <= -100 THEN 'intense' END, CASE WHEN obs <= -50 THEN 'storm' END, CASE WHEN obs < latest THEN 'deepening' END, 'all'], lambda c: c IS NOT NULL)) AS cell FROM log WHERE obs IS NOT NULL),
res AS (SELECT cell, count(*) AS n_rows, avg(e) AS mean_error FROM x GROUP BY cell)""",
)
def storm_cells(spark, sf_dir):
    """A row counts in every cell whose condition it meets."""
    cells = F.array_compact(F.array(F.when(F.col("obs") <= -100, F.lit("intense")), F.when(F.col("obs") <= -50, F.lit("storm")), F.when(F.col("obs") < F.col("latest"), F.lit("deepening")), F.lit("all")))
    rows = log(spark, sf_dir).where("obs is not null").select(F.explode(cells).alias("cell"), (F.col("obs") - F.col("burton")).alias("e"))
    return rows.groupBy("cell").agg(F.count("*").alias("n_rows"), F.avg("e").alias("mean_error"))


@query(
    "solar_cycles", "cycle split n_orders", "",
    """d AS (SELECT CAST(o_orderdate AS DATE) - INTERVAL 20 YEAR AS day FROM orders UNION ALL SELECT CAST(o_orderdate AS DATE) + INTERVAL 20 YEAR FROM orders),
c AS (SELECT CASE WHEN day < DATE '1964-10-01' THEN 19 WHEN day < DATE '1976-03-01' THEN 20 WHEN day < DATE '1986-09-01' THEN 21 WHEN day < DATE '1996-08-01' THEN 22 WHEN day < DATE '2008-12-01' THEN 23 WHEN day < DATE '2019-12-01' THEN 24 ELSE 25 END AS cycle FROM d),
res AS (SELECT cycle, CASE WHEN cycle BETWEEN 20 AND 23 THEN 'train' WHEN cycle = 24 THEN 'val' WHEN cycle >= 25 THEN 'test' ELSE 'exclude' END AS split, count(*) AS n_orders FROM c GROUP BY ALL)""",
)
def solar_cycles(spark, sf_dir):
    """Cycle numbers and splits; order dates, moved by twenty years to both sides, stand for storm onsets."""
    day = F.col("o_orderdate").cast("date")
    days = table(spark, sf_dir, "orders").select(F.explode(F.array(F.add_months(day, -240), F.add_months(day, 240))).alias("day"))
    cycles = days.select(P.solar_cycle("day").alias("cycle"))
    return cycles.groupBy("cycle", P.cycle_split("cycle").alias("split")).agg(F.count("*").alias("n_orders"))


@query(
    "skill_by_regime", "step regime n_rows", "rmse_persistence rmse_burton skill",
    f"""{LOG}, res AS (SELECT step, CASE WHEN latest > -30 THEN 'quiet' ELSE 'disturbed' END AS regime, count(*) AS n_rows, sqrt(avg((obs - persistence) ** 2)) AS rmse_persistence, sqrt(avg((obs - burton) ** 2)) AS rmse_burton,
  1 - avg((obs - burton) ** 2) / nullif(avg((obs - persistence) ** 2), 0) AS skill FROM log WHERE obs IS NOT NULL GROUP BY ALL)""",
)
def skill_by_regime(spark, sf_dir):
    rows = log(spark, sf_dir).where("obs is not null").withColumn("regime", P.activity("latest"))
    mse = lambda c: F.avg(F.pow(F.col("obs") - F.col(c), F.lit(2)))
    return rows.groupBy("step", "regime").agg(F.count("*").alias("n_rows"), F.sqrt(mse("persistence")).alias("rmse_persistence"), F.sqrt(mse("burton")).alias("rmse_burton"), (1 - F.try_divide(mse("burton"), mse("persistence"))).alias("skill"))
