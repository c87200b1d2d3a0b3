"""Ordered operators: gap filling, lags, runs, ranks, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import gaps
from .base import CHANNELS, CLEAN, FRAME, KEYS, LOG, SECONDS, clean, derive, derived_sql, frame, log, query, since, table

W = "PARTITION BY series ORDER BY h"


def _carried(c: str) -> str:
    last = f"max(CASE WHEN {c} IS NOT NULL THEN h END) OVER ({W} ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN h - {last} <= 3 THEN last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS {c}"


@query(
    "causal_clean", "series h quality", "v bz n dst pdyn pressure dst_star",
    f"{FRAME}, carried AS (SELECT series, h, {', '.join(_carried(c) for c in CHANNELS if c != 'dst')}, dst FROM frame),{derived_sql('carried', 'causal')}, res AS (SELECT * FROM causal)",
)
def causal_clean(spark, sf_dir):
    """Cleaning that only looks back; the index itself is never carried."""
    return derive(gaps.carry(frame(spark, sf_dir), [c for c in CHANNELS if c != "dst"], KEYS))


@query(
    "observed_mask", "series h usable", "",
    f"""{FRAME}, f AS (SELECT series, h, CASE WHEN v IS NOT NULL AND bz IS NOT NULL AND n IS NOT NULL AND dst IS NOT NULL THEN 1 ELSE 0 END AS ok FROM frame),
res AS (SELECT series, h, min(ok) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AND count(*) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 AS usable FROM f)""",
)
def observed_mask(spark, sf_dir):
    """Hours whose derivative after smoothing (width 5) rests on observed values alone."""
    near = gaps.ordered(KEYS).rowsBetween(-3, 3)
    ok = F.col("v").isNotNull() & F.col("bz").isNotNull() & F.col("n").isNotNull() & F.col("dst").isNotNull()
    rows = frame(spark, sf_dir).withColumn("ok", ok.cast("int"))
    return rows.select("series", "h", ((F.min("ok").over(near) == 1) & (F.count("*").over(near) == 7)).alias("usable"))


@query(
    "derivative_smoothing", "series h", "rate smoothed smoothed_rate",
    f"""{CLEAN}, s AS (SELECT series, h, dst_star AS x, CASE WHEN count(dst_star) OVER k = count(*) OVER k THEN avg(dst_star) OVER k END AS m FROM clean WINDOW k AS ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
res AS (SELECT series, h, m AS smoothed, {", ".join(f"CASE WHEN h = 0 THEN lead({c}) OVER o - {c} WHEN h = 719 THEN {c} - lag({c}) OVER o ELSE (lead({c}) OVER o - lag({c}) OVER o) / 2 END AS {n}" for c, n in (("x", "rate"), ("m", "smoothed_rate")))} FROM s WINDOW o AS ({W}))""",
)
def derivative_smoothing(spark, sf_dir):
    rows = clean(spark, sf_dir).select("series", "h", F.col("dst_star").alias("x"), gaps.smooth("dst_star", KEYS, 5).alias("smoothed"))
    return rows.select("series", "h", "smoothed", gaps.derivative("x", KEYS).alias("rate"), gaps.derivative("smoothed", KEYS).alias("smoothed_rate"))


@query(
    "fill_both_ways", "series h", "v bz dst",
    f"{FRAME}, res AS (SELECT series, h, {', '.join(f'coalesce(last_value({c} IGNORE NULLS) OVER a, first_value({c} IGNORE NULLS) OVER b) AS {c}' for c in ('v', 'bz', 'dst'))} FROM frame WINDOW a AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
)
def fill_both_ways(spark, sf_dir):
    return gaps.fill_both(frame(spark, sf_dir), ["v", "bz", "dst"], KEYS)


@query(
    "edge_hold_interpolation", "series h", "bz",
    f"""{FRAME}, k AS (SELECT series, h, bz, max(CASE WHEN bz IS NOT NULL THEN h END) OVER a AS ha, last_value(bz IGNORE NULLS) OVER a AS xa, min(CASE WHEN bz IS NOT NULL THEN h END) OVER b AS hb, first_value(bz IGNORE NULLS) OVER b AS xb
 FROM frame WINDOW a AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
res AS (SELECT series, h, CASE WHEN bz IS NOT NULL THEN bz WHEN ha IS NULL THEN xb WHEN hb IS NULL THEN xa ELSE xa + (h - ha) / (hb - ha) * (xb - xa) END AS bz FROM k)""",
)
def edge_hold_interpolation(spark, sf_dir):
    """Linear between values however long the gap, the nearest value beyond the first and last."""
    rows = frame(spark, sf_dir)
    held = gaps.fill_both(rows, ["bz"], KEYS).select("series", "h", F.col("bz").alias("held"))
    inner = gaps.interpolate(rows, ["bz"], KEYS, max_gap=1 << 30).select("series", "h", "bz")
    return inner.join(held, ["series", "h"]).select("series", "h", F.coalesce("bz", "held").alias("bz"))


@query(
    "lag_differences", "series h", "d1 d3 d6 mean_3 mean_6",
    f"""{CLEAN}, res AS (SELECT series, h, {", ".join(f"coalesce(dst - lag(dst, {k}) OVER o, 0) AS d{k}" for k in (1, 3, 6))},
 {", ".join(f"coalesce(avg(dst) OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 0) AS mean_{k}" for k in (3, 6))} FROM clean WINDOW o AS ({W}))""",
)
def lag_differences(spark, sf_dir):
    o = gaps.ordered(KEYS)
    rows = clean(spark, sf_dir)
    lags = [F.coalesce(F.col("dst") - F.lag("dst", k).over(o), F.lit(0.0)).alias(f"d{k}") for k in (1, 3, 6)]
    means = [F.coalesce(F.avg("dst").over(o.rowsBetween(1 - k, 0)), F.lit(0.0)).alias(f"mean_{k}") for k in (3, 6)]
    return rows.select("series", "h", *lags, *means)


def analog_features(rows: DataFrame) -> DataFrame:
    """Features of an origin from the six complete hours before it; incomplete origins are left out."""
    o = gaps.ordered(KEYS)
    past, three = o.rowsBetween(-6, -1), o.rowsBetween(-3, -1)
    full = F.col("v").isNotNull() & F.col("bz").isNotNull() & F.col("by_gsm").isNotNull() & (F.col("n") > 0) & F.col("dst").isNotNull()
    rows = rows.withColumns({"full": full.cast("int"), "bperp": P.transverse("by_gsm", "bz"), "log_n": F.log(F.when(F.col("n") > 0, F.col("n"))), "vbs": F.col("v") * F.col("bs"), "south": (F.lag("bz").over(o) < 0)})
    south = F.when(F.col("south"), gaps.run_length(F.col("south"), KEYS, 12)).otherwise(0)
    return rows.select(
        "series", "h", F.sum("full").over(past).alias("complete"), F.avg("bz").over(past).alias("bz_mean"), F.stddev_pop("bz").over(past).alias("bz_sd"), F.avg("bperp").over(past).alias("bperp_mean"),
        F.avg("log_n").over(past).alias("log_n_mean"), F.avg("vbs").over(three).alias("vbs_mean"), (F.lag("v", 1).over(o) - F.lag("v", 6).over(o)).alias("v_change"), F.lag("dst", 1).over(o).alias("dst_1"),
        F.lag("dst", 3).over(o).alias("dst_3"), south.alias("south_run"),
    ).where("complete = 6").drop("complete")


ANALOG_SQL = f"""{CLEAN}, fx AS (SELECT *, CASE WHEN v IS NOT NULL AND bz IS NOT NULL AND by_gsm IS NOT NULL AND n > 0 AND dst IS NOT NULL THEN 1 ELSE 0 END AS complete_hour, lag(bz) OVER ({W}) AS z1, CASE WHEN n > 0 THEN ln(n) END AS log_n FROM clean),
fy AS (SELECT *, max(CASE WHEN NOT coalesce(z1 < 0, FALSE) THEN h END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS broken FROM fx),
features AS (SELECT * FROM (SELECT series, h, sum(complete_hour) OVER p AS complete, avg(bz) OVER p AS bz_mean, stddev_pop(bz) OVER p AS bz_sd, avg(bt) OVER p AS bperp_mean, avg(log_n) OVER p AS log_n_mean, avg(v * bs) OVER q AS vbs_mean,
 lag(v, 1) OVER o - lag(v, 6) OVER o AS v_change, lag(dst, 1) OVER o AS dst_1, lag(dst, 3) OVER o AS dst_3, CASE WHEN z1 < 0 THEN least(12, h - coalesce(broken, -1)) ELSE 0 END AS south_run
 FROM fy WINDOW o AS ({W}), p AS ({W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), q AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE complete = 6)"""


@query("analog_features", "series h south_run", "bz_mean bz_sd bperp_mean log_n_mean vbs_mean v_change dst_1 dst_3", f"{ANALOG_SQL}, res AS (SELECT * FROM features)")
def analogs(spark, sf_dir):
    return analog_features(clean(spark, sf_dir))


_LADDER = (1, 2, 3, 4, 5, 6, 12, 24)


@query(
    "lag_ladder", "series h", " ".join(f"dst_{k}" for k in _LADDER) + " vbs_1 vbs_2 vbs_3",
    f"""{CLEAN}, x AS (SELECT series, h, {", ".join(f"lag(dst, {k}) OVER o AS dst_{k}" for k in _LADDER)}, {", ".join(f"lag(v * bs, {k}) OVER o AS vbs_{k}" for k in (1, 2, 3))} FROM clean WINDOW o AS ({W})),
res AS (SELECT * FROM x WHERE {" AND ".join([*[f"dst_{k} IS NOT NULL" for k in _LADDER], *[f"vbs_{k} IS NOT NULL" for k in (1, 2, 3)]])})""",
)
def lag_ladder(spark, sf_dir):
    """Lags of the index and the coupling; a row only where all of them are there."""
    o = gaps.ordered(KEYS)
    rows = clean(spark, sf_dir).withColumn("vbs", F.col("v") * F.col("bs"))
    names = {**{f"dst_{k}": F.lag("dst", k).over(o) for k in _LADDER}, **{f"vbs_{k}": F.lag("vbs", k).over(o) for k in (1, 2, 3)}}
    return rows.select("series", "h", *[e.alias(c) for c, e in names.items()]).dropna(subset=list(names))


@query(
    "lead_targets", "series h", "bz_1 bz_3 log_v_change_1 log_n_change_3",
    f"""{CLEAN}, res AS (SELECT series, h, lead(bz, 1) OVER o AS bz_1, lead(bz, 3) OVER o AS bz_3, ln(lead(v, 1) OVER o / v) AS log_v_change_1, ln(lead(n, 3) OVER o / n) AS log_n_change_3 FROM clean WINDOW o AS ({W}))""",
)
def lead_targets(spark, sf_dir):
    o = gaps.ordered(KEYS)
    ratio = lambda c, k: F.log(F.try_divide(F.lead(c, k).over(o), F.col(c)))
    return clean(spark, sf_dir).select("series", "h", F.lead("bz", 1).over(o).alias("bz_1"), F.lead("bz", 3).over(o).alias("bz_3"), ratio("v", 1).alias("log_v_change_1"), ratio("n", 3).alias("log_n_change_3"))


@query(
    "trailing_median", "event_id", "median_15m running_max",
    f"""x AS (SELECT event_id, user_id % 8 AS g, {SECONDS} AS s, value FROM events WHERE event_type = 'view'),
res AS (SELECT event_id, median(value) OVER (PARTITION BY g ORDER BY s RANGE BETWEEN 899 PRECEDING AND CURRENT ROW) AS median_15m, max(value) OVER (PARTITION BY g ORDER BY s RANGE UNBOUNDED PRECEDING) AS running_max FROM x)""",
)
def trailing_median(spark, sf_dir):
    """Median over a trailing time range that is open at its start, and the running maximum."""
    rows = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", (F.col("user_id") % 8).alias("g"), since("SECOND").alias("s"), "value")
    o = Window.partitionBy("g").orderBy("s")
    return rows.select("event_id", F.percentile("value", F.lit(0.5)).over(o.rangeBetween(-899, 0)).alias("median_15m"), F.max("value").over(o.rangeBetween(Window.unboundedPreceding, 0)).alias("running_max"))


_INNOVATION = (1, 2, 3, 4, 6, 9, 12, 18, 24)


@query(
    "innovation_buffer", "series h n_known status", " ".join(f"e_{k}" for k in _INNOVATION),
    f"""{LOG}, er AS (SELECT series, target_h AS h, obs - burton AS e FROM log WHERE step = 1), s AS (SELECT spine.series, spine.h, er.e FROM spine LEFT JOIN er USING (series, h)),
x AS (SELECT series, h, count(e) OVER (PARTITION BY series ORDER BY h ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS n_known, {", ".join(f"lag(e, {k}) OVER o AS e_{k}" for k in _INNOVATION)} FROM s WINDOW o AS (PARTITION BY series ORDER BY h)),
res AS (SELECT *, CASE WHEN h < 24 THEN 'short_history' WHEN n_known < 24 THEN 'gap' ELSE 'ready' END AS status FROM x)""",
)
def innovation_buffer(spark, sf_dir):
    """Matured one-hour errors at fixed lags, and why a buffer is not ready."""
    errors = log(spark, sf_dir).where("step = 1").select("series", F.col("target_h").alias("h"), (F.col("obs") - F.col("burton")).alias("e"))
    rows = frame(spark, sf_dir).select("series", "h").join(errors, ["series", "h"], "left")
    o = gaps.ordered(KEYS)
    known = F.count("e").over(o.rowsBetween(-24, -1))
    status = F.when(F.col("h") < 24, "short_history").when(F.col("n_known") < 24, "gap").otherwise("ready")
    return rows.select("series", "h", known.alias("n_known"), *[F.lag("e", k).over(o).alias(f"e_{k}") for k in _INNOVATION]).withColumn("status", status)


@query(
    "chronological_split", "series part n_rows first_h last_h", "",
    f"""{LOG}, a AS (SELECT DISTINCT series, issue_h FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY issue_h) AS k, count(*) OVER (PARTITION BY series) AS n FROM a),
p AS (SELECT series, issue_h, CASE WHEN k <= floor(0.6 * n) THEN 'fit' WHEN k <= floor(0.8 * n) THEN 'validation' ELSE 'holdout' END AS part FROM r),
b AS (SELECT series, part, min(issue_h) AS a FROM p GROUP BY ALL), j AS (SELECT log.series, log.issue_h, target_h, part FROM log JOIN p USING (series, issue_h)),
n AS (SELECT series, min(CASE WHEN part = 'validation' THEN a END) AS va, min(CASE WHEN part = 'holdout' THEN a END) AS ha FROM b GROUP BY series),
res AS (SELECT j.series, part, count(*) AS n_rows, min(issue_h) AS first_h, max(issue_h) AS last_h FROM j JOIN n USING (series) WHERE part = 'holdout' OR (part = 'fit' AND target_h < va) OR (part = 'validation' AND target_h < ha) GROUP BY ALL)""",
)
def chronological_split(spark, sf_dir):
    """Anchors by order in time; rows whose target reaches into the next part are left out."""
    rows = log(spark, sf_dir)
    anchors = rows.select("series", "issue_h").distinct()
    per = Window.partitionBy("series")
    k, n = F.row_number().over(per.orderBy("issue_h")), F.count("*").over(per)
    parts = anchors.select("series", "issue_h", F.when(k <= F.floor(0.6 * n), "fit").when(k <= F.floor(0.8 * n), "validation").otherwise("holdout").alias("part"))
    first = lambda p: F.min(F.when(F.col("part") == p, F.col("issue_h")))
    starts = parts.groupBy("series").agg(first("validation").alias("va"), first("holdout").alias("ha"))
    joined = rows.join(parts, ["series", "issue_h"]).join(starts, "series")
    kept = joined.where("part = 'holdout' or (part = 'fit' and target_h < va) or (part = 'validation' and target_h < ha)")
    return kept.groupBy("series", "part").agg(F.count("*").alias("n_rows"), F.min("issue_h").alias("first_h"), F.max("issue_h").alias("last_h"))


@query(
    "gap_islands", "series first last size", "",
    f"""{FRAME}, m AS (SELECT series, h, h - row_number() OVER ({W}) AS run FROM frame WHERE dst IS NULL), res AS (SELECT series, min(h) AS first, max(h) AS last, count(*) AS size FROM m GROUP BY series, run)""",
)
def gap_islands(spark, sf_dir):
    return gaps.islands(frame(spark, sf_dir), F.col("dst").isNull(), KEYS)


@query(
    "admissible_gaps", "series h admissible", "",
    f"""{FRAME}, k AS (SELECT series, h, v, max(CASE WHEN v IS NOT NULL THEN h END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS a, min(CASE WHEN v IS NOT NULL THEN h END) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM frame),
res AS (SELECT series, h, coalesce(v IS NOT NULL OR b - a - 1 <= 3, FALSE) AS admissible FROM k)""",
)
def admissible_gaps(spark, sf_dir):
    """Observed, or in a run of at most three unobserved hours between two observed ones."""
    at = F.when(F.col("v").isNotNull(), F.col("h"))
    a, b = F.max(at).over(gaps.before(KEYS)), F.min(at).over(gaps.after(KEYS))
    return frame(spark, sf_dir).select("series", "h", F.coalesce(F.col("v").isNotNull() | (b - a - 1 <= 3), F.lit(False)).alias("admissible"))


@query(
    "best_segment", "series first last size scored", "",
    f"""{FRAME}, m AS (SELECT series, h, dst, h - row_number() OVER ({W}) AS run FROM frame WHERE v IS NOT NULL AND bz IS NOT NULL AND n IS NOT NULL),
s AS (SELECT series, min(h) AS first, max(h) AS last, count(*) AS size, count(dst) AS scored FROM m GROUP BY series, run),
res AS (SELECT series, first, last, size, scored FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY scored DESC, scored / size DESC, first) AS k FROM s) WHERE k = 1)""",
)
def best_segment(spark, sf_dir):
    """The run of valid drivers with the most scored hours, then the greatest share of them, then the earliest."""
    rows = frame(spark, sf_dir)
    runs = gaps.islands(rows, F.col("v").isNotNull() & F.col("bz").isNotNull() & F.col("n").isNotNull(), KEYS)
    targets = rows.where("dst is not null").select("series", "h")
    scored = runs.join(targets, (runs.series == targets.series) & targets.h.between(runs["first"], runs["last"]), "left").groupBy(runs.series, "first", "last", "size").agg(F.count("h").alias("scored"))
    rank = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("scored"), F.desc(F.col("scored") / F.col("size")), "first"))
    return scored.withColumn("k", rank).where("k = 1")


@query(
    "dead_feeds", "series h", "",
    f"""{FRAME}, m AS (SELECT series, h, h - max(CASE WHEN bz IS NOT NULL THEN h END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS missed FROM frame), res AS (SELECT series, h FROM m WHERE missed = 3)""",
)
def dead_feeds(spark, sf_dir):
    """Hours at which a feed has failed three times in a row."""
    missed = F.col("h") - F.max(F.when(F.col("bz").isNotNull(), F.col("h"))).over(gaps.before(KEYS))
    return frame(spark, sf_dir).withColumn("missed", missed).where("missed = 3")


@query(
    "wilcoxon", "step n_pairs", "w_plus w_minus z",
    f"""{LOG}, d AS (SELECT step, round(abs(obs - burton) - abs(obs - persistence), 6) AS d FROM log WHERE obs IS NOT NULL),
r AS (SELECT step, d, rank() OVER (PARTITION BY step ORDER BY abs(d)) + (count(*) OVER (PARTITION BY step, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY step, abs(d)) AS t FROM d WHERE d <> 0),
s AS (SELECT step, count(*) AS n_pairs, coalesce(sum(rk) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (WHERE d < 0), 0) AS w_minus, sum((CAST(t AS DOUBLE) * t * t - t) / t) AS ties FROM r GROUP BY step),
res AS (SELECT step, n_pairs, w_plus, w_minus, least((least(w_plus, w_minus) - n_pairs * (n_pairs + 1) / 4.0 + 0.5) / sqrt(n_pairs * (n_pairs + 1) * (2 * n_pairs + 1) / 24.0 - ties / 48.0), 0) AS z FROM s)""",
)
def wilcoxon(spark, sf_dir):
    """Signed-rank test of the errors of two forecasts: average ranks, tie and continuity corrections."""
    d = log(spark, sf_dir).where("obs is not null").select("step", F.round(F.abs(F.col("obs") - F.col("burton")) - F.abs(F.col("obs") - F.col("persistence")), 6).alias("d")).where("d <> 0")
    return signed_ranks(d, ["step"], "d")


def signed_ranks(rows: DataFrame, keys: list[str], d: str) -> DataFrame:
    # magnitudes first: a partial aggregate, and ties are counted instead of ranked one by one
    sizes = rows.withColumn("m", F.abs(F.col(d))).groupBy(*keys, "m").agg(F.count("*").alias("t"), F.sum(F.when(F.col(d) > 0, 1).otherwise(0)).alias("up"))
    upto = F.sum("t").over(Window.partitionBy(*keys).orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sizes.withColumn("rank", upto - (F.col("t") - 1) / 2.0)
    t = F.col("t").cast("double")
    s = ranked.groupBy(*keys).agg(F.sum("t").alias("n_pairs"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("w_minus"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n_pairs")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    return s.withColumn("z", F.least((F.least("w_plus", "w_minus") - n * (n + 1) / 4.0 + 0.5) / spread, F.lit(0.0)))


@query(
    "holm", "returnflag linestatus rank n_tests", "p adjusted",
    """g AS (SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, least(1.0, abs(avg(l_discount) - 0.05) * 20 + 0.001 * count(*) / 60000.0) AS p FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY p, returnflag, linestatus) AS rank, count(*) OVER () AS n_tests FROM g),
res AS (SELECT returnflag, linestatus, rank, n_tests, p, least(1.0, max((n_tests - rank + 1) * p) OVER (ORDER BY rank)) AS adjusted FROM r)""",
)
def holm(spark, sf_dir):
    """Holm's adjustment of a family of p-values (a family is small, one row per test)."""
    p = F.least(F.lit(1.0), F.abs(F.avg("l_discount") - 0.05) * 20 + 0.001 * F.count("*") / 60000.0)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus")).agg(p.alias("p"))
    family = rows.withColumn("family", F.lit(1))
    w = Window.partitionBy("family")
    ranked = family.withColumns({"rank": F.row_number().over(w.orderBy("p", "returnflag", "linestatus")), "n_tests": F.count("*").over(w)})
    return ranked.withColumn("adjusted", F.least(F.lit(1.0), F.max((F.col("n_tests") - F.col("rank") + 1) * F.col("p")).over(w.orderBy("rank"))))
