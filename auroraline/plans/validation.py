"""Compositions and checks of a release: shadow centre, joint draws, phase and coupled fits, cross-fits, gates, audit, artifacts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import linfit as L
from ..operators.inference import pick
from ..operators.numbering import numbered
from ..operators.scratch import folder
from ..sources import artifacts
from . import registry
from .base import CLEAN, FRAME, LOG, clean, frame, log, query
from .fits import _log_terms, _table, o

_CAP = 15.0


@query(
    "shadow_composition", "series issue_h step applied", "corrected center delta final",
    f"""{LOG}, t AS (SELECT log.*, least(greatest(burton + 0.25 * (latest - burton) - 0.5 * step, -2000.0), 50.0) AS corrected, CASE WHEN step <= 1 THEN 0.8 WHEN step <= 3 THEN 0.6 ELSE 0.4 END AS w FROM log),
c AS (SELECT *, w * corrected + (1 - w) * obrien AS center FROM t), inn AS (SELECT series, issue_h, obs - center AS e FROM c WHERE step = 1 AND obs IS NOT NULL AND center IS NOT NULL),
b AS (SELECT c.series, c.issue_h, c.step, sum(i.e * pow(0.5, c.issue_h - i.issue_h)) AS push FROM c JOIN inn i ON i.series = c.series AND i.issue_h BETWEEN c.issue_h - 6 AND c.issue_h - 1 GROUP BY ALL HAVING count(*) = 6),
res AS (SELECT c.series, c.issue_h, c.step, push IS NOT NULL AS applied, corrected, center, CASE WHEN push IS NULL THEN 0.0 ELSE least(greatest(push, -{_CAP}), {_CAP}) END AS delta, center + CASE WHEN push IS NULL THEN 0.0 ELSE least(greatest(push, -{_CAP}), {_CAP}) END AS final FROM c LEFT JOIN b USING (series, issue_h, step))""",
)
def shadow_composition(spark, sf_dir):
    """Corrected centre, blend with the frozen one by lead, and a capped correction from six matured one-step innovations.

    The innovation of hour t - j is known at t for j of 1 to 6; one that is missing leaves the blend as it is.
    """
    step = F.col("step")
    corrected = P.clamp(F.col("burton") + 0.25 * (F.col("latest") - F.col("burton")) - 0.5 * step, -2000.0, 50.0)
    w = F.when(step <= 1, 0.8).when(step <= 3, 0.6).otherwise(0.4)
    rows = log(spark, sf_dir).withColumn("corrected", corrected).withColumn("center", w * F.col("corrected") + (1 - w) * F.col("obrien"))
    own = F.when(step == 1, F.col("obs") - F.col("center"))
    recent = F.collect_list(F.when(own.isNotNull(), F.struct(F.col("issue_h").alias("h"), own.alias("e")))).over(Window.partitionBy("series").orderBy("issue_h").rangeBetween(-6, -1))
    push = F.aggregate("recent", F.lit(0.0), lambda a, x: a + x["e"] * F.pow(F.lit(0.5), F.col("issue_h") - x["h"]))
    rows = rows.withColumn("recent", recent).withColumn("applied", F.size("recent") == 6)
    rows = rows.withColumn("delta", F.when(F.col("applied"), P.clamp(push, -_CAP, _CAP)).otherwise(0.0))
    return rows.select("series", "issue_h", "step", "applied", "corrected", "center", "delta", (F.col("center") + F.col("delta")).alias("final"))


@query(
    "joint_draws", "member", "coupling decay pressure_term",
    f"""{FRAME}, d AS (SELECT h * 2 + series AS id, v, bz, dst FROM frame WHERE v IS NOT NULL AND dst IS NOT NULL), n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n, avg(v) OVER () AS mv, avg(dst) OVER () AS md FROM d),
m AS (SELECT member, ((member * 7919 + (member * 0) % 613) * 31 + 17) % (SELECT max(n) FROM n) AS i FROM range(500) t(member)),
res AS (SELECT member, 5.4 + 0.001 * (v - mv) AS coupling, -0.13 + 0.001 * (dst - md) AS decay, 0.0 AS pressure_term FROM m JOIN n USING (i))""",
)
def joint_draws(spark, sf_dir):
    """500 members, each one whole row of the draws, moved so that the draws' mean lies on the point coefficients; a term whose point is zero stays zero, and a row with a missing active term is no draw."""
    point = {"coupling": ("v", 5.4), "decay": ("dst", -0.13)}
    draws = frame(spark, sf_dir).where("v is not null and dst is not null").select((F.col("h") * 2 + F.col("series")).alias("id"), (0.001 * F.col("v")).alias("v"), (0.001 * F.col("dst")).alias("dst"))
    mean = draws.agg(F.avg("v").alias("v"), F.avg("dst").alias("dst")).first()
    rows, n = numbered(draws, "id", "i")
    members = spark.range(500).select(F.col("id").alias("member"), pick(F.col("id"), F.lit(0).cast("long"), F.lit(n)).alias("i"))
    moved = [(F.lit(p) + F.col(c) - F.lit(mean[c])).alias(term) for term, (c, p) in point.items()]
    return members.join(rows, "i").select("member", *moved, F.lit(0.0).alias("pressure_term"))


def _two_terms(by: str, source: str) -> str:
    return f"""m AS (SELECT {by}, count(*) AS n_rows, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS bq FROM {source} WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL GROUP BY {by}),
res AS (SELECT {by}, n_rows, (ay * bb - bq * ab) / (aa * bb - ab * ab) AS first_term, (bq * aa - ay * ab) / (aa * bb - ab * ab) AS second_term FROM m WHERE n_rows >= 20)"""


def _solved(spark, cells):
    """Fits of the cells that have 20 rows."""
    return [(*k, m.n, *L.solve(m.gram, m.cross)) for k, m in sorted(cells.items()) if m.n >= 20]


@query(
    "phase_fits", "phase n_rows", "first_term second_term",
    f"""{CLEAN}, r AS (SELECT dst_star AS a, v * bs / 1000.0 AS b, lead(dst_star) OVER (PARTITION BY series ORDER BY h) - dst_star AS y, dst_star - lag(dst_star) OVER (PARTITION BY series ORDER BY h) AS back FROM clean),
p AS (SELECT CASE WHEN a > -20 THEN 'quiet' WHEN back < -2 THEN 'main' ELSE 'recovery' END AS phase, a, b, y FROM r), {_two_terms("phase", "p")}""",
)
def phase_fits(spark, sf_dir):
    """Decay and drive fitted apart for quiet hours, main phase and recovery; the past change decides, so that a phase is known when it is used."""
    rows = clean(spark, sf_dir).withColumns({"rate": F.lead("dst_star").over(o()) - F.col("dst_star"), "back": F.col("dst_star") - F.lag("dst_star").over(o())})
    phase = F.when(F.col("dst_star") > -20, "quiet").when(F.col("back") < -2, "main").otherwise("recovery")
    cells = L.moments(rows.withColumn("phase", phase), [("decay", F.col("dst_star")), ("drive", F.col("v") * F.col("bs") / 1000.0)], F.col("rate"), ["phase"])
    return _table(spark, _solved(spark, cells), "phase string, n_rows long, first_term double, second_term double")


@query(
    "coupled_fits", "state n_rows", "first_term second_term",
    f"""{CLEAN}, r AS (SELECT series, h, dst_star, by_gsm, lead(dst_star) OVER w - dst_star AS y1, lead(by_gsm) OVER w - by_gsm AS y2 FROM clean WINDOW w AS (PARTITION BY series ORDER BY h)),
p AS (SELECT 'dst_star' AS state, dst_star AS a, by_gsm AS b, y1 AS y FROM r UNION ALL SELECT 'by_gsm', dst_star, by_gsm, y2 FROM r), {_two_terms("state", "p")}""",
)
def coupled_fits(spark, sf_dir):
    """The rates of two states, each fitted on both."""
    rows = clean(spark, sf_dir).select("dst_star", "by_gsm", *[(F.lead(c).over(o()) - F.col(c)).alias(f"{c}_rate") for c in ("dst_star", "by_gsm")])
    rows = rows.unpivot(["dst_star", "by_gsm"], ["dst_star_rate", "by_gsm_rate"], "state", "rate").withColumn("state", F.regexp_replace("state", "_rate$", ""))
    cells = L.moments(rows, [("first", F.col("dst_star")), ("second", F.col("by_gsm"))], F.col("rate"), ["state"])
    return _table(spark, _solved(spark, cells), "state string, n_rows long, first_term double, second_term double")


@query(
    "stack_crossfit", "fold step n_train n_query", "weight rmse",
    f"""{LOG}, x AS (SELECT issue_h // 72 AS fold, target_h, step, obs - persistence AS r, burton - persistence AS d FROM log WHERE obs IS NOT NULL), k AS (SELECT DISTINCT fold, step FROM x),
w AS (SELECT k.fold, k.step, count(*) AS n_train, CASE WHEN sum(x.d * x.d) > 0 THEN least(greatest(sum(x.r * x.d) / sum(x.d * x.d), 0.0), 1.0) ELSE 0.0 END AS weight FROM k JOIN x ON x.step = k.step AND x.target_h < k.fold * 72 - 168 GROUP BY ALL),
res AS (SELECT w.fold, w.step, n_train, count(*) AS n_query, any_value(weight) AS weight, sqrt(avg((r - weight * d) ** 2)) AS rmse FROM w JOIN x USING (fold, step) GROUP BY ALL)""",
)
def stack_crossfit(spark, sf_dir):
    """Weight of the model against persistence, fitted for each fold on rows whose targets end a week before it, scored on the fold.

    Sums are taken by block first and then added up along the blocks, so that no row is copied to the folds.
    """
    d = F.col("burton") - F.col("persistence")
    x = log(spark, sf_dir).where("obs is not null").select("step", F.floor(F.col("issue_h") / 72).alias("fold"), (F.floor((F.col("target_h") + 168) / 72) + 1).alias("usable"), (F.col("obs") - F.col("persistence")).alias("r"), d.alias("d"))
    sums = [F.sum(F.col("r") * F.col("d")).alias("rd"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.count("*").alias("n")]
    own = x.groupBy("step", "fold").agg(*sums)
    past = x.groupBy("step", F.col("usable").alias("fold")).agg(*[s.alias(f"p_{c}") for s, c in zip(sums, ("rd", "dd", "rr", "n"), strict=True)])
    w = Window.partitionBy("step").orderBy("fold")
    both = own.join(past, ["step", "fold"], "full").withColumns({c: F.sum(c).over(w) for c in ("p_rd", "p_dd", "p_n")})
    weight = F.when(F.col("p_dd") > 0, P.clamp(F.col("p_rd") / F.col("p_dd"), 0.0, 1.0)).otherwise(0.0)
    both = both.where("n is not null and p_n is not null").withColumn("weight", weight)
    sse = F.col("rr") - 2 * F.col("weight") * F.col("rd") + F.col("weight") * F.col("weight") * F.col("dd")
    return both.select("fold", "step", F.col("p_n").alias("n_train"), F.col("n").alias("n_query"), "weight", F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n")).alias("rmse"))


@query(
    "gate_table", "step best_comparator beat_all margin_pass decision", "candidate_rmse best_rmse gain",
    f"""{LOG}, s AS (SELECT step, sqrt(avg((obs - 0.5 * (burton + persistence)) ** 2)) AS candidate_rmse, sqrt(avg((obs - persistence) ** 2)) AS p, sqrt(avg((obs - burton) ** 2)) AS b, sqrt(avg((obs - obrien) ** 2)) AS q FROM log WHERE obs IS NOT NULL GROUP BY step),
g AS (SELECT *, least(p, b, q) AS best_rmse, CASE WHEN b <= q AND b <= p THEN 'burton' WHEN q <= p THEN 'obrien' ELSE 'persistence' END AS best_comparator, least(p, b, q) - candidate_rmse AS gain FROM s),
res AS (SELECT *, gain > 0 AS beat_all, gain >= 0.02 * best_rmse AS margin_pass, CASE WHEN gain >= 0.02 * best_rmse THEN 'promote' WHEN gain > 0 THEN 'hold' ELSE 'reject' END AS decision FROM g)""",
)
def gate_table(spark, sf_dir):
    """Does the candidate, half model and half persistence, beat every comparator at a lead, and the best one by its margin of 2 %?"""
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col("obs") - c, F.lit(2))))
    names = ["burton", "obrien", "persistence"]  # ties go to the first
    s = log(spark, sf_dir).where("obs is not null").groupBy("step").agg(rmse(0.5 * (F.col("burton") + F.col("persistence"))).alias("candidate_rmse"), *[rmse(F.col(c)).alias(c) for c in names])
    best = F.least(*names)
    g = s.select("step", "candidate_rmse", best.alias("best_rmse"), F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in names]).alias("best_comparator"), (best - F.col("candidate_rmse")).alias("gain"))
    beat, margin = F.col("gain") > 0, F.col("gain") >= 0.02 * F.col("best_rmse")
    return g.select("*", beat.alias("beat_all"), margin.alias("margin_pass"), F.when(margin, "promote").when(beat, "hold").otherwise("reject").alias("decision"))


@query(
    "readiness_audit", "name passed failures n_rows", "",
    f"""{LOG}, a AS (SELECT *, count(*) OVER (PARTITION BY series, issue_h, step) AS copies FROM log),
t AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE copies > 1) AS duplicates, count(*) FILTER (WHERE burton IS NULL OR obrien IS NULL OR persistence IS NULL) AS missing, count(*) FILTER (WHERE target_h <> issue_h + step) AS targets,
 count(*) FILTER (WHERE obs IS NULL) AS pending, count(*) FILTER (WHERE burton NOT BETWEEN -2500 AND 500) AS ranges FROM a),
res AS (SELECT name, failures = 0 AS passed, failures, n_rows FROM (SELECT n_rows, unnest(['duplicate_rows', 'missing_centers', 'target_hours', 'pending_truth', 'center_range']) AS name, unnest([duplicates, missing, targets, pending, ranges]) AS failures FROM t))""",
)
def readiness_audit(spark, sf_dir):
    """Checks of the log with their counts of failing rows; one pass, after a count of equal keys."""
    rows = log(spark, sf_dir)
    bad = {
        "missing_centers": F.col("burton").isNull() | F.col("obrien").isNull() | F.col("persistence").isNull(),
        "target_hours": F.col("target_h") != F.col("issue_h") + F.col("step"),
        "pending_truth": F.col("obs").isNull(),
        "center_range": ~F.col("burton").between(-2500, 500),
    }
    keyed = rows.groupBy("series", "issue_h", "step").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in bad.items()])
    total = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in bad])
    checks = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("failures")) for k in ("duplicate_rows", *bad)]))
    return total.select("n_rows", checks.alias("c")).select("c.name", (F.col("c.failures") == 0).alias("passed"), "c.failures", "n_rows")


_CONFORMAL = registry.ORACLES["conformal_fit"]


@query("conformal_sidecar", "bin regime n", "half_width coverage_floor", f"res AS ({_CONFORMAL})")
def conformal_sidecar(spark, sf_dir):
    """The conformal cells written as an artifact and read back by kind and version."""
    path = folder(spark, "conformal")
    artifacts.write_artifact(registry.QUERIES["conformal_fit"](spark, sf_dir), path, "conformal", 1)
    return artifacts.read_artifact(spark, path, "conformal", 1, "bin int, regime string, n long, half_width double, coverage_floor double")


@query("calibration_artifact", "series issue_h step", "center")
def calibration_artifact(spark, sf_dir):
    """Ridge coefficients written as an artifact, read back and applied to every row of the log; without them nothing is served."""
    path, rows = folder(spark, "calibration"), log(spark, sf_dir)
    m = L.moments(rows.where("obs is not null and issue_h < 500"), _log_terms(), F.col("obs"))[()]
    artifacts.write_artifact(_table(spark, zip(m.names, L.ridge(m, 100.0), strict=True), "term string, coefficient double"), path, "calibration", 2)
    served = {r["term"]: r["coefficient"] for r in artifacts.read_artifact(spark, path, "calibration", 2, "term string, coefficient double").collect()}  # a row per term
    assert set(served) == set(m.names) and np.isfinite(list(served.values())).all()
    return rows.select("series", "issue_h", "step", sum((F.lit(served[n]) * e for n, e in _log_terms()), F.lit(0.0)).alias("center"))
