"""The driver path from what is on its way, continued by an autoregression; errors explained by outside lags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import linfit as L
from .base import CHANNELS, SECONDS, clean, log, query, since, table

_STEPS, _DAY = 14, 48


@query(
    "arrival_path", "series issue step source", "speed",
    f"""RECURSIVE x AS (SELECT user_id % 2 AS series, {SECONDS} AS s, 300 + 2 * value AS v FROM events WHERE event_type = 'view'),
y AS (SELECT series, CAST(floor(s / 1800) AS BIGINT) AS m, CAST(floor((s + 1500000.0 / v) / 1800) AS BIGINT) AS a, v FROM x),
i AS (SELECT *, (m // {_DAY} + 1) * {_DAY} AS issue FROM y), q AS (SELECT series, issue, a - issue AS step, avg(v) AS v FROM i WHERE a > issue AND a - issue <= {_STEPS} GROUP BY ALL),
k AS (SELECT series, issue, arg_max(v, (m, v)) AS v FROM i GROUP BY ALL),
sim AS (SELECT series, issue, CAST(0 AS BIGINT) AS step, CAST(v AS DOUBLE) AS speed, 'known' AS source FROM k
 UNION ALL SELECT sim.series, sim.issue, sim.step + 1, coalesce(q.v, 400 + 0.9 * (speed - 400)), CASE WHEN q.v IS NULL THEN 'autoregression' ELSE 'queued' END FROM sim LEFT JOIN q ON q.series = sim.series AND q.issue = sim.issue AND q.step = sim.step + 1 WHERE sim.step < {_STEPS}),
res AS (SELECT * FROM sim WHERE step > 0)""",
)
def arrival_path(spark, sf_dir):
    """Half-hour speeds for seven hours from each day's first issue: bins measured before the issue that arrive after it, else the recursion from the step before."""
    assert CHANNELS["v"][0] == "view"
    x = table(spark, sf_dir, "events").where("event_type = 'view'").select((F.col("user_id") % 2).alias("series"), since("SECOND").alias("s"), (300 + 2 * F.col("value")).alias("v"))
    y = x.select("series", F.floor(F.col("s") / 1800).alias("m"), F.floor((F.col("s") + 1500000.0 / F.col("v")) / 1800).alias("a"), "v").withColumn("issue", (F.floor(F.col("m") / _DAY) + 1) * _DAY)
    queued = y.withColumn("step", F.col("a") - F.col("issue")).where(F.col("step").between(1, _STEPS)).groupBy("series", "issue", "step").agg(F.avg("v").alias("v"))
    ahead = queued.groupBy("series", "issue").agg(F.map_from_entries(F.collect_list(F.struct("step", "v"))).alias("q"))  # _STEPS entries at most
    known = y.groupBy("series", "issue").agg(F.max_by("v", F.struct("m", "v")).alias("v0"))
    both = known.join(ahead, ["series", "issue"], "left")

    def step(path, k):
        last = F.coalesce(F.try_element_at(path, F.lit(-1))["speed"], F.col("v0"))
        own = F.try_element_at(F.col("q"), k)
        new = F.struct(F.coalesce(own, 400 + 0.9 * (last - 400)).alias("speed"), F.when(own.isNull(), "autoregression").otherwise("queued").alias("source"))
        return F.concat(path, F.array(new)).cast("array<struct<speed:double,source:string>>")

    path = F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(_STEPS).cast("long")), F.array().cast("array<struct<speed:double,source:string>>"), step)
    return both.select("series", "issue", F.posexplode(path).alias("k", "p")).select("series", "issue", (F.col("k") + 1).alias("step"), "p.source", "p.speed")


@query("exogenous_error", "lag_group kept", "strength coefficient_norm")
def exogenous_error(spark, sf_dir):
    """Lags of the error, the drive and the index in groups; weak groups go, the rest is fitted again."""
    o = Window.partitionBy("series").orderBy("h")
    errors = log(spark, sf_dir).where("step = 1").select("series", F.col("target_h").alias("h"), (F.col("obs") - F.col("burton")).alias("error"))
    rows = clean(spark, sf_dir).select("series", "h", (1e-3 * F.col("v") * F.col("bs")).alias("drive"), F.col("dst").alias("index")).join(errors, ["series", "h"], "left")
    groups = {c: [f"{c}_{k}" for k in (1, 2, 3)] for c in ("error", "drive", "index")}
    lagged = rows.select(F.col("error"), *[F.lag(c, k).over(o).alias(f"{c}_{k}") for c in groups for k in (1, 2, 3)])
    m = L.moments(lagged, [("one", F.lit(1.0)), *[(n, F.col(n)) for names in groups.values() for n in names]], F.col("error"))[()]
    scale, full = np.sqrt(np.diag(m.gram) / max(m.n, 1)), L.ridge(m, 5.0)
    at = {c: [m.names.index(n) for n in names] for c, names in groups.items()}
    strength = {c: float(np.linalg.norm((full * scale)[i])) for c, i in at.items()}
    kept = [c for c in groups if strength[c] >= 0.1 * max(strength.values())]
    support = [0, *[i for c in kept for i in at[c]]]
    coef = np.zeros(len(full))
    coef[support] = L.solve(m.gram[np.ix_(support, support)], m.cross[support])
    return spark.createDataFrame([(c, c in kept, strength[c], float(np.linalg.norm(coef[at[c]]))) for c in groups], "lag_group string, kept boolean, strength double, coefficient_norm double")


