"""Recursions over series, events and alarms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import folds
from ..operators.adaptive import run_adaptive
from ..operators.assimilation import run_filter
from .base import CLEAN, FRAME, KEYS, LOG, clean, frame, log, query

_DRIVERS = f"{CLEAN}, g AS (SELECT series, h, coalesce(v, 400.0) AS v, coalesce(bs, 0.0) AS bs FROM clean)"


def _drivers(spark, sf_dir):
    return clean(spark, sf_dir).select("series", "h", F.coalesce("v", F.lit(400.0)).alias("v"), F.coalesce("bs", F.lit(0.0)).alias("bs"))


def _euler_sql(rate: str) -> str:
    return f"""{_DRIVERS.replace(FRAME, FRAME, 1)}, sim AS (SELECT series, CAST(0 AS BIGINT) AS h, CAST(-20.0 AS DOUBLE) AS state FROM range(2) t(series)
 UNION ALL SELECT sim.series, sim.h + 1, least(greatest(state + least(greatest({rate}, -200.0), 200.0), -2000.0), 50.0) FROM sim JOIN g ON g.series = sim.series AND g.h = sim.h WHERE sim.h < 719),
res AS (SELECT * FROM sim)"""


_RATES = {
    "burton": "-5.4e-3 * v * bs - state / 7.7",
    "burton_full": "CASE WHEN v * bs > 500 THEN -5.4e-3 * (v * bs - 500) ELSE 0.0 END - state / 7.7",
    "obrien": "CASE WHEN v * bs / 1000.0 > 0.49 THEN -4.4 * (v * bs / 1000.0 - 0.49) ELSE 0.0 END - state / (2.40 * exp(9.74 / (4.69 + v * bs / 1000.0)))",
}


def _simulation(name, model):
    @query(f"simulate_{name}", "series h", "state", "RECURSIVE " + _euler_sql(_RATES[name]))
    def run(spark, sf_dir):
        return folds.simulate(_drivers(spark, sf_dir), KEYS, "h", model, -20.0, "state")

    return run


for _name, _model in (("burton", P.burton), ("burton_full", P.burton_full), ("obrien", P.obrien)):
    _simulation(_name, _model)


def sparse_rate(v, bs, s):
    """A sparse model: constant, decay, coupling and its square."""
    return -0.2 - 0.09 * s - 3.9e-3 * v * bs - 1e-7 * (v * bs) * (v * bs)


@query("simulate_sparse", "series h", "state", "RECURSIVE " + _euler_sql("-0.2 - 0.09 * state - 3.9e-3 * v * bs - 1e-7 * (v * bs) * (v * bs)"))
def simulate_sparse(spark, sf_dir):
    return folds.simulate(_drivers(spark, sf_dir), KEYS, "h", sparse_rate, -20.0, "state")


@query(
    "simulate_phases", "series h", "state",
    "RECURSIVE " + _euler_sql("CASE WHEN v * bs > 1000 THEN -5.0e-3 * v * bs - state / 9.0 WHEN state < -30 THEN -1.0e-3 * v * bs - state / 12.0 ELSE -state / 7.7 END"),
)
def simulate_phases(spark, sf_dir):
    """Coefficients are chosen at each step by the drive and the state."""

    def rate(v, bs, s):
        return F.when(v * bs > 1000, -5.0e-3 * v * bs - s / 9.0).when(s < -30, -1.0e-3 * v * bs - s / 12.0).otherwise(-s / 7.7)

    return folds.simulate(_drivers(spark, sf_dir), KEYS, "h", rate, -20.0, "state")


@query(
    "driver_memory", "series h", "memory",
    f"""RECURSIVE {CLEAN}, g AS (SELECT series, h, 1e-3 * v * bs AS x FROM clean), sim AS (SELECT series, CAST(0 AS BIGINT) AS h, CAST(0.0 AS DOUBLE) AS memory FROM range(2) t(series)
 UNION ALL SELECT sim.series, sim.h + 1, CASE WHEN x IS NULL THEN memory ELSE exp(-1 / 6.0) * memory + (1 - exp(-1 / 6.0)) * x END FROM sim JOIN g ON g.series = sim.series AND g.h = sim.h WHERE sim.h < 719), res AS (SELECT * FROM sim)""",
)
def driver_memory(spark, sf_dir):
    rows = clean(spark, sf_dir).select("series", "h", (1e-3 * F.col("v") * F.col("bs")).alias("x"))
    return folds.memory(rows, KEYS, "h", "x", 6.0, "memory")


_MEMBERS = 500


@query(
    "ensemble_rollout", "series h step", "point median p05 p95",
    f"""RECURSIVE {CLEAN}, d AS (SELECT draw, 5.4e-3 * (0.8 + 0.0008 * draw) AS alpha, 7.7 * (1.2 - 0.0008 * draw) AS tau FROM range({_MEMBERS}) t(draw)),
o AS (SELECT series, h, v, bs, dst_star FROM clean WHERE quality = 1),
sim AS (SELECT series, h, draw, 0 AS step, dst_star AS s, v, bs, alpha, tau FROM o, d UNION ALL SELECT series, h, draw, step + 1, least(greatest(s + least(greatest(-alpha * v * bs - s / tau, -200.0), 200.0), -2000.0), 50.0), v, bs, alpha, tau FROM sim WHERE step < 6),
k AS (SELECT *, row_number() OVER (PARTITION BY series, h, step ORDER BY s) AS i FROM sim WHERE step > 0),
res AS (SELECT series, h, step, max(CASE WHEN draw = 250 THEN s END) AS point, max(CASE WHEN i = 250 THEN s END) AS median, max(CASE WHEN i = 25 THEN s END) AS p05, max(CASE WHEN i = 475 THEN s END) AS p95 FROM k GROUP BY ALL)""",
)
def ensemble_rollout(spark, sf_dir):
    """Six hours ahead from every valid hour for each member's coefficients, and the ranks of the members at each step."""
    origins = clean(spark, sf_dir).where("quality = 1").select("series", "h", "v", "bs", "dst_star")
    members = origins.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(_MEMBERS - 1)))).withColumn("d", F.struct((5.4e-3 * (0.8 + 0.0008 * F.col("draw"))).alias("alpha"), (7.7 * (1.2 - 0.0008 * F.col("draw"))).alias("tau")))
    path = folds.rollout(F.col("dst_star"), F.col("v"), F.col("bs"), F.lit(6), lambda v, bs, s: -F.col("d.alpha") * v * bs - s / F.col("d.tau"))
    steps = members.select("series", "h", "draw", F.posexplode(path).alias("k", "s"))
    grouped = steps.groupBy("series", "h", (F.col("k") + 1).alias("step")).agg(F.max(F.when(F.col("draw") == _MEMBERS // 2, F.col("s"))).alias("point"), F.sort_array(F.collect_list("s")).alias("all"))
    at = lambda q: F.get("all", F.lit(int(np.ceil(q * _MEMBERS)) - 1))
    return grouped.select("series", "h", "step", "point", at(0.5).alias("median"), at(0.05).alias("p05"), at(0.95).alias("p95"))


@query(
    "alarm_cooldown", "series h rank", "",
    f"""RECURSIVE {CLEAN}, g AS (SELECT series, h, CASE WHEN dst <= -200 THEN 3 WHEN dst <= -100 THEN 2 WHEN dst <= -50 THEN 1 ELSE 0 END AS rank FROM clean),
sim AS (SELECT series, CAST(-1 AS BIGINT) AS h, CAST(-100000 AS BIGINT) AS t, 0 AS s, FALSE AS fired FROM range(2) t(series)
 UNION ALL SELECT sim.series, g.h, CASE WHEN rank <= 0 OR (g.h - t <= 6 AND rank <= s) THEN t ELSE g.h END, CASE WHEN rank <= 0 OR (g.h - t <= 6 AND rank <= s) THEN s ELSE rank END, NOT (rank <= 0 OR (g.h - t <= 6 AND rank <= s)) FROM sim JOIN g ON g.series = sim.series AND g.h = sim.h + 1),
res AS (SELECT series, h, s AS rank FROM sim WHERE fired)""",
)
def alarm_cooldown(spark, sf_dir):
    rows = clean(spark, sf_dir).select("series", "h", P.severity_rank("dst").alias("rank"))
    return folds.alarms(rows, KEYS, "h", "rank", 6)


def catalog_by_hand(rows: pd.DataFrame) -> list[tuple]:
    """The catalog as plain Python, for tests."""
    x, q = rows.dst_star.to_numpy(float), rows.quality.to_numpy()
    n, out, crossing, end, i = len(x), [], None, None, 0
    while i < n:
        below = np.isfinite(x[i]) and x[i] < -50 and (i == 0 or not np.isfinite(x[i - 1]) or x[i - 1] >= -50)
        if not below or (crossing is not None and i < crossing + 48):
            i += 1
            continue
        o = i
        while o > max(0, i - 24) and np.isfinite(x[o - 1]) and x[o - 1] < -20:
            o -= 1
        stop = min(n - 1, i + 144)
        known = [k for k in range(o, stop + 1) if np.isfinite(x[k])]
        low = min(known, key=lambda k: (x[k], k))
        recovery = next((k for k in range(low, stop + 1) if np.isfinite(x[k]) and x[k] >= -20), stop)
        a, b = max(0, o - 24), min(n - 1, recovery + 24)
        if end is not None and a <= end:
            i += 1
            continue
        crossing = i
        if sum(q[k] == 1 and np.isfinite(x[k]) for k in range(a, b + 1)) / (b - a + 1) >= 0.6:
            out.append((o, low, recovery, a, b, x[low]))
        end = b if end is None else max(end, b)
        i = max(i + 1, b + 1)
    return out


def smoothed_index(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("h").rowsBetween(-11, 0)
    return clean(spark, sf_dir).select("series", "h", F.when(F.count("dst_star").over(w) >= 6, F.avg("dst_star").over(w)).alias("dst_star"), "quality")


@query("storm_catalog", "series onset_h min_h recovery_h first_h last_h", "min_dst_star")
def storm_catalog(spark, sf_dir):
    """Storms of the twelve-hour mean; greedy acceptance has no plain SQL, so tests hold it against plain Python."""
    return folds.storm_catalog(smoothed_index(spark, sf_dir), KEYS, threshold=-50.0)


@query(
    "storm_sessions", "series first last size", "peak",
    f"""{CLEAN}, x AS (SELECT series, h, -dst AS p FROM clean WHERE dst <= -50), n AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY series ORDER BY h) > 6 THEN 1 ELSE 0 END AS new FROM x),
r AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY h ROWS UNBOUNDED PRECEDING) AS run FROM n), res AS (SELECT series, min(h) AS first, max(h) AS last, count(*) AS size, max(p) AS peak FROM r GROUP BY series, run)""",
)
def storm_sessions(spark, sf_dir):
    rows = clean(spark, sf_dir).where("dst <= -50").select("series", "h", (-F.col("dst")).alias("p"))
    return folds.sessions(rows, KEYS, "h", 6, "p")


@query(
    "merged_windows", "series first last merged", "",
    f"""{CLEAN}, x AS (SELECT series, h FROM clean WHERE dst <= -80), n AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY series ORDER BY h) > 2 THEN 1 ELSE 0 END AS new FROM x),
r AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY h ROWS UNBOUNDED PRECEDING) AS run FROM n), s AS (SELECT series, min(h) - 5 AS first, max(h) + 5 AS last FROM r GROUP BY series, run),
m AS (SELECT *, CASE WHEN first > max(last) OVER (PARTITION BY series ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM s), k AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM m),
res AS (SELECT series, min(first) AS first, max(last) AS last, count(*) AS merged FROM k GROUP BY series, run)""",
)
def merged_windows(spark, sf_dir):
    rows = clean(spark, sf_dir).where("dst <= -80").select("series", "h", F.col("dst").alias("p"))
    return folds.merge_spans(folds.sessions(rows, KEYS, "h", 2, "p"), KEYS, 5)


@query("adaptive_conformal", "series step issue_h covered", "low high alpha")
def adaptive_conformal(spark, sf_dir):
    """Online widths for each series and lead; tests hold them against a direct loop."""
    rows = log(spark, sf_dir).select("series", "step", "issue_h", F.col("burton").alias("point"), F.col("obs").alias("observed"))
    return run_adaptive(rows, ["series", "step"], "issue_h")


@query("assimilation", "series h", "dst_mean decay dst_sd")
def assimilation(spark, sf_dir):
    """State and decay rate by an extended Kalman filter over each series."""
    rows = clean(spark, sf_dir).select("series", "h", F.coalesce("v", F.lit(400.0)).alias("v"), F.coalesce("bs", F.lit(0.0)).alias("bs"), "dst_star")
    return run_filter(rows, KEYS, "h")


@query(
    "electric_field", "series h", "field",
    f"""{FRAME}, b AS (SELECT series, h, bz - lag(bz) OVER (PARTITION BY series ORDER BY h) AS d FROM frame), res AS (SELECT a.series, a.h, sum(coalesce(x.d, 0) / sqrt(a.h - x.h + 0.5)) AS field FROM b a JOIN b x ON x.series = a.series AND x.h BETWEEN a.h - 47 AND a.h GROUP BY ALL)""",
)
def electric_field(spark, sf_dir):
    """Causal half-space convolution of the field's changes with (t - t')^(-1/2) over two days: a sum over a window."""
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("h")
    rows = frame(spark, sf_dir).select("series", "h", F.coalesce(F.col("bz") - F.lag("bz").over(w), F.lit(0.0)).alias("d"))
    recent = F.collect_list("d").over(w.rowsBetween(-47, 0))
    total = F.aggregate(F.transform("recent", lambda d, i: d / F.sqrt(F.size("recent") - 1 - i + 0.5)), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("recent", recent).select("series", "h", total.alias("field"))


@query("field_spectrum", "series", "peak_frequency peak_power total_power impedance")
def field_spectrum(spark, sf_dir):
    """Spectrum of each series and the surface impedance of a layered earth at its peak."""
    from ..functions.geoelectric import surface_impedance

    def spectrum(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("h").bz.interpolate(limit_direction="both").fillna(0.0).to_numpy()
        power = np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x)
        k = int(np.argmax(power[1:])) + 1
        f = k / (len(x) * 3600.0)
        return pd.DataFrame({"series": [rows.series.iloc[0]], "peak_frequency": [f * 1e6], "peak_power": [power[k]], "total_power": [power.sum()], "impedance": [1e3 * abs(surface_impedance(f, (0.01, 0.001, 0.1), (15e3, 85e3)))]})

    return frame(spark, sf_dir).select("series", "h", "bz").groupBy("series").applyInPandas(spectrum, "series long, peak_frequency double, peak_power double, total_power double, impedance double")
