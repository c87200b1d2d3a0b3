"""Model fits: sparse discovery, ridge calibration, stacking, drivers and error models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import linfit as L
from ..operators.boost import boosted_residual
from .base import CLEAN, LOG, clean, log, query

def o():
    return Window.partitionBy("series").orderBy("h")


def _discovery(spark, sf_dir) -> DataFrame:
    """Rows with every term, and the change of the index to the next hour."""
    rows = clean(spark, sf_dir).withColumn("rate", F.lead("dst_star").over(o()) - F.col("dst_star"))
    return rows.where("quality = 1 and by_gsm is not null and rate is not null")


def _table(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows], schema)


@query("sparse_discovery", "term", "coefficient")
def sparse_discovery(spark, sf_dir):
    m = L.moments(_discovery(spark, sf_dir), P.library(), F.col("rate"))[()]
    return _table(spark, zip(m.names, L.stlsq(m, 20.0), strict=True), "term string, coefficient double")


@query("threshold_sweep", "n_terms", "threshold rmse")
def threshold_sweep(spark, sf_dir):
    """One pass of moments serves the whole grid."""
    m = L.moments(_discovery(spark, sf_dir), P.library(), F.col("rate"))[()]
    return _table(spark, L.sweep(m, list(np.geomspace(1, 500, 60))), "threshold double, n_terms int, rmse double")


@query("storm_threshold", "selected n_terms", "threshold validation_rmse standard_error")
def storm_threshold(spark, sf_dir):
    """Thresholds fitted on the first 80 % of weeks and scored on the rest; the largest within one standard error of the best."""
    rows = _discovery(spark, sf_dir).withColumn("week", F.floor(F.col("h") / 72))
    last = rows.agg(F.max("week")).first()[0]
    cut = int(0.8 * ((-1 if last is None else last) + 1))
    m = L.moments(rows.where(F.col("week") < cut), P.library(), F.col("rate"))[()]
    held = L.moments(rows.where(F.col("week") >= cut), P.library(), F.col("rate"), ["series", "week"])
    out = []
    for t in np.geomspace(1, 500, 60):
        c = L.stlsq(m, t)
        e = np.array([x.error(c) for x in held.values()] or [0.0])
        out.append((float(t), int((c != 0).sum()), float(e.mean()), float(e.std(ddof=1) / np.sqrt(len(e))) if len(e) > 1 else 0.0))
    best = min(out, key=lambda r: (r[2], r[1], -r[0]))
    chosen = max((r for r in out if r[2] <= best[2] + best[3]), key=lambda r: r[0])
    return _table(spark, [(*r, r == chosen) for r in out], "threshold double, n_terms int, validation_rmse double, standard_error double, selected boolean")


@query("collinearity", "term", "condition inflation")
def collinearity(spark, sf_dir):
    m = L.moments(_discovery(spark, sf_dir), P.library(), F.col("rate"))[()]
    kappa, inflation = L.collinearity(m)
    return _table(spark, [(n, kappa, float(min(v, 1e12))) for n, v in zip(m.names, inflation, strict=True)], "term string, condition double, inflation double")


@query("ensemble_discovery", "term", "inclusion median_coefficient")
def ensemble_discovery(spark, sf_dir):
    """Draws by a hash of draw and row, so they can be repeated; all draws' moments come from one aggregation."""
    draws = 500
    rows = _discovery(spark, sf_dir).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).where(F.pmod(F.xxhash64("draw", "series", "h"), F.lit(10)) < 8)
    fits = np.array([L.stlsq(m, 20.0) for m in L.moments(rows, P.library(), F.col("rate"), ["draw"]).values()])
    names = [n for n, _ in P.library()]
    return _table(spark, [(n, float((c != 0).mean()), float(np.median(c[c != 0])) if (c != 0).any() else None) for n, c in zip(names, fits.T, strict=True)], "term string, inclusion double, median_coefficient double")




def _log_terms():
    return [("one", F.lit(1.0)), ("latest", F.col("latest")), ("burton", F.col("burton")), ("obrien", F.col("obrien")), ("step", F.col("step"))]


@query("ridge_calibration", "term", "coefficient")
def ridge_calibration(spark, sf_dir):
    rows = log(spark, sf_dir).where("obs is not null and issue_h < 500")
    m = L.moments(rows, _log_terms(), F.col("obs"))[()]
    return _table(spark, zip(m.names, L.ridge(m, 100.0), strict=True), "term string, coefficient double")


@query("calibrated_scores", "part n_rows", "rmse_burton rmse_calibrated interval_scale")
def calibrated_scores(spark, sf_dir):
    """The calibration applied to its fit rows and to later ones; the interval scale is never below one."""
    rows = log(spark, sf_dir).where("obs is not null")
    m = L.moments(rows.where("issue_h < 500"), _log_terms(), F.col("obs"))[()]
    made = sum((F.lit(float(c)) * e for c, (_, e) in zip(L.ridge(m, 100.0), _log_terms(), strict=True)), F.lit(0.0))
    scored = rows.withColumns({"made": made, "part": F.when(F.col("issue_h") < 500, "fit").otherwise("later")})
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col("obs") - F.col(c), F.lit(2))))
    scale = F.greatest(F.lit(1.0), F.percentile(F.abs(F.col("obs") - F.col("made")), F.lit(0.9)) / 25.0)
    return scored.groupBy("part").agg(F.count("*").alias("n_rows"), rmse("burton").alias("rmse_burton"), rmse("made").alias("rmse_calibrated"), scale.alias("interval_scale"))


_EXPERTS = ["persistence", "burton", "obrien"]


def _cells(spark, sf_dir):
    rows = log(spark, sf_dir).where("obs is not null").withColumn("regime", P.activity("latest"))
    return rows, L.moments(rows, [(c, F.col(c)) for c in _EXPERTS], F.col("obs"), ["step", "regime"])


@query("stack_weights", "step regime n_rows", " ".join(_EXPERTS) + " rmse")
def stack_weights(spark, sf_dir):
    """Weights of the experts in each cell, on the simplex."""
    _, cells = _cells(spark, sf_dir)
    return _table(spark, [(*k, m.n, *w, m.error(w)) for k, m in sorted(cells.items()) for w in [L.stack(m)]], "step int, regime string, n_rows long, persistence double, burton double, obrien double, rmse double")


@query("super_learner", "step regime", " ".join(_EXPERTS))
def super_learner(spark, sf_dir):
    """The same weights by exact enumeration of supports."""
    _, cells = _cells(spark, sf_dir)
    return _table(spark, [(*k, *L.exact_stack(m)) for k, m in sorted(cells.items())], "step int, regime string, persistence double, burton double, obrien double")


@query("stacked_scores", "step", "rmse_stack rmse_best")
def stacked_scores(spark, sf_dir):
    rows, cells = _cells(spark, sf_dir)
    weights = _table(spark, [(*k, *L.stack(m)) for k, m in cells.items()], "step int, regime string, w_persistence double, w_burton double, w_obrien double")
    center = sum((F.col(f"w_{c}") * F.col(c) for c in _EXPERTS), F.lit(0.0))
    joined = rows.join(F.broadcast(weights), ["step", "regime"]).withColumn("center", center)  # a row per cell
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col("obs") - F.col(c), F.lit(2))))
    return joined.groupBy("step").agg(rmse("center").alias("rmse_stack"), F.least(*[rmse(c) for c in _EXPERTS]).alias("rmse_best"))


@query("driver_autoregression", "state term", "coefficient radius")
def driver_autoregression(spark, sf_dir):
    """Ridge vector autoregression of speed and field with two lags, and the radius of its companion matrix."""
    rows = clean(spark, sf_dir).select("series", "h", *[F.lag(c, k).over(o()).alias(f"{c}_{k}") for k in (0, 1, 2) for c in ("v", "bz")])
    terms = [(f"{c}_{k}", F.col(f"{c}_{k}")) for k in (1, 2) for c in ("v", "bz")]
    coef = np.array([L.ridge(L.moments(rows, [("one", F.lit(1.0)), *terms], F.col(f"{c}_0"))[()], 1.0) for c in ("v", "bz")])
    radius = L.spectral_radius(coef[:, 1:], 2)
    return _table(spark, [(c, n, float(coef[i, j]), radius) for i, c in enumerate(("v", "bz")) for j, n in enumerate(["one", *[t for t, _ in terms]])], "state string, term string, coefficient double, radius double")


@query("error_subset", "lag chosen", "coefficient")
def error_subset(spark, sf_dir):
    """At most three lags of the matured one-hour error, by BIC; refused where the recursion would not decay."""
    errors = log(spark, sf_dir).where("step = 1").select("series", F.col("target_h").alias("h"), (F.col("obs") - F.col("burton")).alias("e"))
    lags = (1, 2, 3, 4, 6, 9, 12, 18, 24)
    rows = errors.select("e", *[F.lag("e", k).over(o()).alias(f"e_{k}") for k in lags])
    m = L.moments(rows, [(f"e_{k}", F.col(f"e_{k}")) for k in lags], F.col("e"))[()]
    names, coef, _ = L.best_subset(m, 3)
    line = np.zeros((1, max(lags)))
    for k, c in zip(lags, coef, strict=True):
        line[0, k - 1] = c
    if L.spectral_radius(line, max(lags)) > 0.98:
        names, coef = [], np.zeros(len(lags))
    return _table(spark, [(k, f"e_{k}" in names, float(c)) for k, c in zip(lags, coef, strict=True)], "lag int, chosen boolean, coefficient double")


@query("sparse_residual", "term kept", "coefficient gain")
def sparse_residual(spark, sf_dir):
    """The strongest terms of a full ridge fit, fitted again on their own; nothing is kept unless the error falls."""
    rows = log(spark, sf_dir).where("obs is not null")
    m = L.moments(rows, _log_terms(), F.col("obs") - F.col("burton"))[()]
    scale = np.sqrt(np.diag(m.gram) / max(m.n, 1))
    full = L.ridge(m, 10.0)
    top = sorted(np.lexsort((np.arange(len(full)), -np.abs(full * scale)))[:3])
    coef = np.zeros(len(full))
    coef[top] = L.solve(m.gram[np.ix_(top, top)], m.cross[top])
    gain = np.sqrt(m.target / m.n) - m.error(coef) if m.n else 0.0
    keep = gain > 0
    return _table(spark, [(n, bool(keep and i in top), float(c if keep else 0.0), float(gain)) for i, (n, c) in enumerate(zip(m.names, coef, strict=True))], "term string, kept boolean, coefficient double, gain double")


@query("history_fit", "term", "coefficient")
def history_fit(spark, sf_dir):
    """Box-limited coefficients of state, coupling and memory of the coupling."""
    rows = _discovery(spark, sf_dir).withColumn("vb", 1e-3 * F.col("v") * F.col("bs")).withColumn("memory", F.avg("vb").over(o().rowsBetween(-6, -1)))
    m = L.moments(rows, [("state", F.col("dst_star")), ("drive", F.col("vb")), ("memory", F.col("memory"))], F.col("rate"))[()]
    low, high = np.array([-1.0, -20.0, -20.0]), np.array([0.0, 0.0, 20.0])
    w, step = np.clip(L.solve(m.gram, m.cross), low, high), 1 / max(np.linalg.eigvalsh(m.gram)[-1], 1e-12)
    for _ in range(20000):
        w = np.clip(w - step * (m.gram @ w - m.cross), low, high)
    return _table(spark, zip(m.names, w, strict=True), "term string, coefficient double")


@query("boosted_residual", "step n_rows", "rmse_before rmse_after")
def boosted(spark, sf_dir):
    """Shallow trees on the residual of the Burton forecast, by histogram sums of every round."""
    return boosted_residual(log(spark, sf_dir).where("obs is not null"), ["latest", "burton", "obrien", "step"], "burton", "obs")


@query(
    "simple_regression", "step", "slope intercept r2",
    f"{LOG}, res AS (SELECT step, regr_slope(obs, burton) AS slope, regr_intercept(obs, burton) AS intercept, regr_r2(obs, burton) AS r2 FROM log WHERE obs IS NOT NULL GROUP BY step)",
)
def simple_regression(spark, sf_dir):
    rows = log(spark, sf_dir).where("obs is not null")
    return rows.groupBy("step").agg(F.regr_slope("obs", "burton").alias("slope"), F.regr_intercept("obs", "burton").alias("intercept"), F.regr_r2("obs", "burton").alias("r2"))


@query(
    "least_squares_rate", "n_rows", "decay drive",
    f"""{CLEAN}, r AS (SELECT dst_star AS s, v * bs AS d, lead(dst_star) OVER (PARTITION BY series ORDER BY h) - dst_star AS y FROM clean),
m AS (SELECT count(*) AS n_rows, sum(s * s) AS ss, sum(s * d) AS sd, sum(d * d) AS dd, sum(s * y) AS sy, sum(d * y) AS dy FROM r WHERE s IS NOT NULL AND d IS NOT NULL AND y IS NOT NULL),
res AS (SELECT n_rows, (sy * dd - dy * sd) / (ss * dd - sd * sd) AS decay, (dy * ss - sy * sd) / (ss * dd - sd * sd) AS drive FROM m)""",
)
def least_squares_rate(spark, sf_dir):
    """Decay and coupling of the two-term model, by the general solver."""
    rows = clean(spark, sf_dir).withColumn("rate", F.lead("dst_star").over(o()) - F.col("dst_star"))
    m = L.moments(rows, [("decay", F.col("dst_star")), ("drive", F.col("v") * F.col("bs"))], F.col("rate"))[()]
    c = L.solve(m.gram, m.cross)
    return _table(spark, [(m.n, c[0], c[1])], "n_rows long, decay double, drive double")


@query(
    "rolling_folds", "fold part n_rows", "",
    f"""{LOG}, f AS (SELECT fold FROM (SELECT max(issue_h) // 72 AS last FROM log), range(10000) t(fold) WHERE fold <= last), res AS (SELECT fold, CASE WHEN issue_h >= fold * 72 AND issue_h < (fold + 1) * 72 THEN 'query' ELSE 'train' END AS part, count(*) AS n_rows FROM log, f WHERE (issue_h >= fold * 72 AND issue_h < (fold + 1) * 72) OR target_h < fold * 72 - 168 GROUP BY ALL)""",
)
def rolling_folds(spark, sf_dir):
    """Every block is scored; a fold's training rows have targets that end 168 hours before its first hour.

    Rows are counted by block and hour of target first, so that only counts meet the folds.
    """
    rows = log(spark, sf_dir).groupBy(F.floor(F.col("issue_h") / 72).alias("fold"), F.floor((F.col("target_h") + 168) / 72).alias("after")).agg(F.count("*").alias("n_rows"))
    last = rows.agg(F.max("fold")).first()[0]
    query_rows = rows.groupBy("fold").agg(F.sum("n_rows").alias("n_rows")).select("fold", F.lit("query").alias("part"), "n_rows")
    later = F.explode(F.sequence(F.col("after") + 1, F.lit(last))).alias("fold")
    train = rows.where(F.col("after") < F.lit(last)).groupBy("after").agg(F.sum("n_rows").alias("n")).select(later, "n").groupBy("fold").agg(F.sum("n").alias("n_rows")).select("fold", F.lit("train").alias("part"), "n_rows")
    return query_rows.unionByName(train)
