"""Forecast compositions: analog members, coupled and driver recursions, half-hour drivers, served sequence."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import folds, gaps
from .base import CLEAN, KEYS, LOG, SECONDS, clean, log, query, since, table

_COUPLED = "SELECT series, CAST(0 AS BIGINT) AS h, CAST(-20.0 AS DOUBLE) AS dst_star, CAST(100.0 AS DOUBLE) AS ae FROM range(2) t(series)"


@query(
    "simulate_coupled", "series h", "dst_star ae",
    f"""RECURSIVE {CLEAN}, g AS (SELECT series, h, coalesce(1e-3 * v * bs, 0.0) AS e FROM clean), sim AS ({_COUPLED}
 UNION ALL SELECT sim.series, sim.h + 1, least(greatest(dst_star + least(greatest(-4.0 * e - 0.002 * ae - dst_star / 8.0, -200.0), 200.0), -2000.0), 50.0), least(greatest(ae + 90.0 * e - ae / 2.5, 0.0), 3000.0) FROM sim JOIN g ON g.series = sim.series AND g.h = sim.h WHERE sim.h < 719),
res AS (SELECT * FROM sim)""",
)
def simulate_coupled(spark, sf_dir):
    """Two states that drive each other: the ring current and the auroral index."""
    rows = clean(spark, sf_dir).select("series", "h", F.coalesce(1e-3 * F.col("v") * F.col("bs"), F.lit(0.0)).alias("e"))
    state = "struct<d:double,a:double>"

    def step(s, r):
        d = P.euler(s["d"], -4.0 * r["e"] - 0.002 * s["a"] - s["d"] / 8.0)
        return F.struct(d.alias("d"), P.clamp(s["a"] + 90.0 * r["e"] - s["a"] / 2.5, 0.0, 3000.0).alias("a"))

    start = F.struct(F.lit(-20.0).alias("d"), F.lit(100.0).alias("a"))
    folded = folds.collected(rows, KEYS, "h", ["e"]).select("series", F.explode(F.arrays_zip(F.transform("rows", lambda r: r["h"]).alias("h"), folds.trajectory(F.col("rows"), start, step, lambda s, _: s, state, state).alias("s"))).alias("z"))
    return folded.select("series", "z.h", F.col("z.s.d").alias("dst_star"), F.col("z.s.a").alias("ae"))


@query(
    "affine_trajectory", "series h step", "exact euler",
    f"""{CLEAN}, o AS (SELECT series, h, dst_star AS s, -5.4e-3 * v * bs AS q FROM clean WHERE quality = 1), ex AS (SELECT series, h, s, q, unnest([1, 2, 3, 6]) AS step FROM o),
res AS (SELECT series, h, step, 7.7 * q + (s - 7.7 * q) * exp(-step / 7.7) AS exact, 7.7 * q + (s - 7.7 * q) * pow(1 - 1 / 7.7, step) AS euler FROM ex)""",
)
def affine_trajectory(spark, sf_dir):
    """The exact solution of the linear model under constant drive, beside its Euler steps, from every valid hour."""
    s, q = F.col("dst_star"), -5.4e-3 * F.col("v") * F.col("bs")
    rows = clean(spark, sf_dir).where("quality = 1").select("series", "h", s.alias("s"), q.alias("q"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 6)])).alias("step"))
    rest = lambda decay: 7.7 * F.col("q") + (F.col("s") - 7.7 * F.col("q")) * decay
    return rows.select("series", "h", "step", rest(F.exp(-F.col("step") / 7.7)).alias("exact"), rest(F.pow(F.lit(1 - 1 / 7.7), F.col("step"))).alias("euler"))


@query(
    "half_hour_drivers", "series h n_bins", "speed density",
    f"""x AS (SELECT user_id % 2 AS series, CAST(floor({SECONDS} / 1800) AS BIGINT) AS b, CASE WHEN event_type = 'view' THEN 300 + 2 * value END AS v, CASE WHEN event_type = 'purchase' THEN 1 + 0.2 * value END AS n FROM events),
y AS (SELECT series, b, avg(v) AS v, avg(n) AS n FROM x GROUP BY ALL), res AS (SELECT series, b // 2 AS h, count(*) AS n_bins, avg(v) AS speed, exp(avg(ln(n))) AS density FROM y GROUP BY ALL)""",
)
def half_hour_drivers(spark, sf_dir):
    """Half-hour means joined to hours: the mean speed, and the mean of the logarithm for the density."""
    reading = lambda kind, e: F.when(F.col("event_type") == kind, e)
    x = table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("series"), F.floor(since("SECOND") / 1800).alias("b"), reading("view", 300 + 2 * F.col("value")).alias("v"), reading("purchase", 1 + 0.2 * F.col("value")).alias("n"))
    y = x.groupBy("series", "b").agg(F.avg("v").alias("v"), F.avg("n").alias("n"))
    return y.groupBy("series", F.floor(F.col("b") / 2).alias("h")).agg(F.count("*").alias("n_bins"), F.avg("v").alias("speed"), F.exp(F.avg(F.log("n"))).alias("density"))


@query(
    "driver_rollout", "series h step", "bz",
    f"""{CLEAN}, o AS (SELECT series, h, bz AS b0, lag(bz) OVER (PARTITION BY series ORDER BY h) AS b1 FROM clean),
s1 AS (SELECT series, h, b0, 0.5 * b0 + 0.2 * b1 + 0.1 AS x1 FROM o WHERE b0 IS NOT NULL AND b1 IS NOT NULL), s2 AS (SELECT *, 0.5 * x1 + 0.2 * b0 + 0.1 AS x2 FROM s1), s3 AS (SELECT *, 0.5 * x2 + 0.2 * x1 + 0.1 AS x3 FROM s2),
res AS (SELECT series, h, 1 AS step, x1 AS bz FROM s3 UNION ALL SELECT series, h, 2, x2 FROM s3 UNION ALL SELECT series, h, 3, x3 FROM s3)""",
)
def driver_rollout(spark, sf_dir):
    """A second-order autoregression run forward from each hour."""
    rows = clean(spark, sf_dir).select("series", "h", "bz", F.lag("bz").over(gaps.ordered(KEYS)).alias("b1")).dropna()
    ahead = F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.array("b1", "bz"), lambda a, k: F.concat(a, F.array(0.5 * F.element_at(a, F.lit(-1)) + 0.2 * F.element_at(a, F.lit(-2)) + 0.1)), lambda a: F.slice(a, 3, 3))
    return rows.select("series", "h", F.posexplode(ahead).alias("k", "next")).select("series", "h", (F.col("k") + 1).alias("step"), F.col("next").alias("bz"))


@query(
    "analog_forecast", "query_id n_members", "mean_ahead spread",
    """q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT query_id, vec_id, sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: (CAST(e[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)) ** 2))) AS distance FROM q, embeddings WHERE abs(vec_id - query_id) >= 16),
r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM p),
n AS (SELECT r.query_id, CAST(b.embedding[1] AS DOUBLE) - CAST(a.embedding[1] AS DOUBLE) AS d FROM r JOIN embeddings a USING (vec_id) JOIN embeddings b ON b.vec_id = r.vec_id + 1 WHERE rank <= 25),
res AS (SELECT query_id, count(*) AS n_members, avg(d) AS mean_ahead, stddev_pop(d) AS spread FROM n GROUP BY query_id)""",
)
def analog_forecast(spark, sf_dir):
    """What followed the analogs of a query: the mean and spread of the members' next increments."""
    from ..operators.analog import nearest_neighbours

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    members = nearest_neighbours(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 25, 16)
    first = lambda: F.get("embedding", F.lit(0)).cast("double")
    here = rows.select("vec_id", first().alias("now"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), first().alias("next"))
    d = F.col("next") - F.col("now")
    return members.join(here, "vec_id").join(after, "vec_id").groupBy("query_id").agg(F.count("*").alias("n_members"), F.avg(d).alias("mean_ahead"), F.stddev_pop(d).alias("spread"))


@query(
    "served_sequence", "series issue_h step stage", "center low high",
    f"""{LOG}, x AS (SELECT *, 0.4 * burton + 0.5 * obrien + 0.1 * persistence AS stacked FROM log), y AS (SELECT *, CASE WHEN latest <= -100 THEN least(stacked, burton, obrien) ELSE stacked END AS safe FROM x),
z AS (SELECT *, latest - 40.0 * step AS floor_rate FROM y),
res AS (SELECT series, issue_h, step, CASE WHEN safe < floor_rate THEN 'rate_limited' WHEN safe < stacked THEN 'depth_safe' ELSE 'stacked' END AS stage, greatest(safe, floor_rate) AS center, greatest(safe, floor_rate) - 12 - 3 * step AS low, greatest(safe, floor_rate) + 12 + 3 * step AS high FROM z)""",
)
def served_sequence(spark, sf_dir):
    """Stacked centre, depth-safe minimum, rate limit, and the interval moved to the centre that is served."""
    x = log(spark, sf_dir).withColumn("stacked", 0.4 * F.col("burton") + 0.5 * F.col("obrien") + 0.1 * F.col("persistence"))
    x = x.withColumn("safe", F.when(F.col("latest") <= -100, F.least("stacked", "burton", "obrien")).otherwise(F.col("stacked"))).withColumn("floor_rate", F.col("latest") - 40.0 * F.col("step"))
    stage = F.when(F.col("safe") < F.col("floor_rate"), "rate_limited").when(F.col("safe") < F.col("stacked"), "depth_safe").otherwise("stacked")
    center, half = F.greatest("safe", "floor_rate"), 12 + 3 * F.col("step")
    return x.select("series", "issue_h", "step", stage.alias("stage"), center.alias("center"), (center - half).alias("low"), (center + half).alias("high"))


@query(
    "driver_status", "series h status", "",
    f"""{CLEAN}, x AS (SELECT series, h, count(v) OVER w AS nv, count(bz) OVER w AS nb FROM clean WINDOW w AS (PARTITION BY series ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), res AS (SELECT series, h, CASE WHEN least(nv, nb) = 0 THEN 'hard_gap' WHEN least(nv, nb) < 6 THEN 'partial_gap' ELSE 'ok' END AS status FROM x)""",
)
def driver_status(spark, sf_dir):
    w = gaps.ordered(KEYS).rowsBetween(-5, 0)
    n = F.least(F.count("v").over(w), F.count("bz").over(w))
    return clean(spark, sf_dir).select("series", "h", F.when(n == 0, "hard_gap").when(n < 6, "partial_gap").otherwise("ok").alias("status"))


@query(
    "minute_rate_forecast", "station m", "point bound exceedance",
    f"""x AS (SELECT user_id % 4 AS station, CAST(floor({SECONDS} / 3600) AS BIGINT) AS m, avg(value) AS b FROM events GROUP BY ALL), d AS (SELECT station, m, abs(b - lag(b) OVER w) / (m - lag(m) OVER w) AS r FROM x WINDOW w AS (PARTITION BY station ORDER BY m)),
f AS (SELECT station, m, r, avg(r) OVER k AS mean30, max(r) OVER k AS max30, stddev_samp(r) OVER k AS sd30, count(r) OVER k AS n, m - min(m) OVER k AS span FROM d WINDOW k AS (PARTITION BY station ORDER BY m ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
p AS (SELECT station, m, 0.1 + 0.3 * ln(1 + r) + 0.25 * ln(1 + mean30) + 0.2 * ln(1 + max30) + 0.05 * ln(1 + sd30) AS y FROM f WHERE n = 30 AND span = 29),
res AS (SELECT station, m, exp(y) - 1 AS point, exp(y + 0.45) - 1 AS bound, list_sum(list_transform([-0.6, -0.3, -0.1, 0.0, 0.1, 0.3, 0.6], lambda e: CASE WHEN exp(y + e) - 1 > 15 THEN 1.0 ELSE 0.0 END)) / 7 AS exceedance FROM p)""",
)
def minute_rate_forecast(spark, sf_dir):
    """Log-linear forecast of the rate of change from thirty consecutive readings: point, bound and chance to exceed a level."""
    x = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("station"), since("HOUR").alias("m"), "value").groupBy("station", "m").agg(F.avg("value").alias("b"))
    w = Window.partitionBy("station").orderBy("m")
    k = w.rowsBetween(-29, 0)
    r = F.abs(F.col("b") - F.lag("b").over(w)) / (F.col("m") - F.lag("m").over(w))
    f = x.select("station", "m", r.alias("r")).select("station", "m", "r", F.avg("r").over(k).alias("mean"), F.max("r").over(k).alias("max"), F.stddev_samp("r").over(k).alias("sd"), F.count("r").over(k).alias("n"), (F.col("m") - F.min("m").over(k)).alias("span"))
    y = 0.1 + 0.3 * F.log1p("r") + 0.25 * F.log1p("mean") + 0.2 * F.log1p("max") + 0.05 * F.log1p("sd")
    residuals = F.array(*[F.lit(e) for e in (-0.6, -0.3, -0.1, 0.0, 0.1, 0.3, 0.6)])
    p = f.where("n = 30 and span = 29").withColumn("y", y)
    return p.select("station", "m", F.expm1("y").alias("point"), F.expm1(F.col("y") + 0.45).alias("bound"), (F.size(F.filter(residuals, lambda e: F.expm1(F.col("y") + e) > 15)) / 7).alias("exceedance"))


@query(
    "transit_arrivals", "event_id arrival_second", "transit_seconds",
    f"res AS (SELECT event_id, {SECONDS} + CAST(floor(1500000.0 / least(greatest(300 + 2 * value, 200.0), 3000.0)) AS BIGINT) AS arrival_second, 1500000.0 / least(greatest(300 + 2 * value, 200.0), 3000.0) AS transit_seconds FROM events WHERE event_type = 'view')",
)
def transit_arrivals(spark, sf_dir):
    """Ballistic arrival with the speed held within its limits."""
    transit = 1500000.0 / P.clamp(300 + 2 * F.col("value"), 200.0, 3000.0)
    rows = table(spark, sf_dir, "events").where("event_type = 'view'")
    return rows.select("event_id", (since("SECOND") + F.floor(transit)).alias("arrival_second"), transit.alias("transit_seconds"))


@query(
    "level_changes", "series h level kind", "",
    f"""{CLEAN}, x AS (SELECT series, h, CASE WHEN dst IS NULL THEN NULL WHEN dst <= -200 THEN 3 WHEN dst <= -100 THEN 2 WHEN dst <= -50 THEN 1 ELSE 0 END AS level FROM clean),
y AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY series ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x), res AS (SELECT series, h, level, CASE WHEN p IS NULL THEN 'start' WHEN level > p THEN 'raised' ELSE 'lowered' END AS kind FROM y WHERE level IS NOT NULL AND (p IS NULL OR level <> p))""",
)
def level_changes(spark, sf_dir):
    """Notices on a change of level; hours without a value keep the last level."""
    o = gaps.ordered(KEYS)
    rows = clean(spark, sf_dir).select("series", "h", F.when(F.col("dst").isNotNull(), P.severity_rank("dst")).alias("level"))
    rows = rows.withColumn("p", F.last("level", True).over(o.rowsBetween(Window.unboundedPreceding, -1)))
    kind = F.when(F.col("p").isNull(), "start").when(F.col("level") > F.col("p"), "raised").otherwise("lowered")
    return rows.where("level is not null and (p is null or level <> p)").select("series", "h", "level", kind.alias("kind"))


RHO = math.exp(-1 / 6)


@query(
    "history_rollout", "series h step", "state memory",
    f"""RECURSIVE {CLEAN}, o AS (SELECT series, h, dst_star AS s, 1e-3 * v * bs AS e FROM clean WHERE quality = 1),
sim AS (SELECT series, h, 0 AS step, s AS state, e AS memory, e FROM o UNION ALL SELECT series, h, step + 1, least(greatest(state + least(greatest(-0.1 * state - 3.0 * memory - 1.0 * (e - memory), -200.0), 200.0), -2000.0), 50.0), exp(-1 / 6.0) * memory + (1 - exp(-1 / 6.0)) * e, e * 0.9 FROM sim WHERE step < 6),
res AS (SELECT series, h, step, state, memory FROM sim)""",
)
def history_rollout(spark, sf_dir):
    """State and memory of the coupling run forward together from every valid hour, under a drive that fades."""
    rows = clean(spark, sf_dir).where("quality = 1").select("series", "h", F.col("dst_star").alias("s"), (1e-3 * F.col("v") * F.col("bs")).alias("e"))
    kind = "array<struct<s:double,m:double,e:double>>"

    def step(acc, k):
        def of(x):
            rate = -0.1 * x["s"] - 3.0 * x["m"] - 1.0 * (x["e"] - x["m"])
            return F.struct(P.euler(x["s"], rate).alias("s"), (RHO * x["m"] + (1 - RHO) * x["e"]).alias("m"), (x["e"] * 0.9).alias("e"))

        return F.concat(acc, F.array(folds.let(F.element_at(acc, F.lit(-1)), of))).cast(kind)

    path = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.array(F.struct(F.col("s").alias("s"), F.col("e").alias("m"), F.col("e").alias("e"))).cast(kind), step)
    return rows.select("series", "h", F.posexplode(path).alias("step", "x")).select("series", "h", "step", F.col("x.s").alias("state"), F.col("x.m").alias("memory"))
