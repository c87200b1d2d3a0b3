"""What a live forecast adds: the magnetic feed, blended and relaxed drivers, steps anchored to observations, and the p-value of the rank test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as P
from ..functions.special import ERFC, erfc
from ..operators import folds, gaps
from ..sources import feeds
from . import registry
from .base import CLEAN, FRAME, KEYS, SECONDS, clean, frame, query, table
from .windows import wilcoxon


@query(
    "mag_scan", "event_second", "bx_gsm by_gsm bz bt",
    f"""x AS (SELECT event_id, {SECONDS} AS s, value, event_id % 6 AS k FROM events WHERE event_type = 'click'),
res AS (SELECT s AS event_second, CASE WHEN k <> 1 THEN value - 4 END AS bx_gsm, CASE WHEN k <> 4 THEN 3 - value END AS by_gsm, 6 - value / 4 AS bz, CASE WHEN value - 2 >= 0 THEN value - 2 END AS bt FROM x WHERE k NOT IN (2, 3))""",
)
def mag_scan(spark, sf_dir):
    """Feed objects of which some are inactive, some have no southward component in range and some lack another component."""
    rows = table(spark, sf_dir, "events").where("event_type = 'click'")
    k = F.col("event_id") % 6
    bz = F.when(k == 3, "-1000.5").otherwise((6 - F.col("value") / 4).cast("string"))
    fields = {
        "time_tag": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), "active": F.when(k == 2, "False").otherwise("true"), "bx_gsm": F.when(k == 1, "n/a").otherwise((F.col("value") - 4).cast("string")),
        "by_gsm": F.when(k == 4, "99999").otherwise((3 - F.col("value")).cast("string")), "bz_gsm": bz, "bt": (F.col("value") - 2).cast("string"),
    }
    text = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
    parsed = feeds.parse_mag(rows.select(text.alias("value")))
    return parsed.select(F.expr("timestampdiff(SECOND, timestamp'2024-01-01 00:00:00', time_tag)").alias("event_second"), "bx_gsm", "by_gsm", "bz", "bt")


@query(
    "latest_drivers", "series h", "v bz",
    f"{FRAME}, x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY h DESC) AS k FROM frame WHERE v IS NOT NULL AND bz IS NOT NULL), res AS (SELECT series, h, v, bz FROM x WHERE k = 1)",
)
def latest_drivers(spark, sf_dir):
    """The latest hour with both drivers; a partial aggregate, not a sort."""
    both = frame(spark, sf_dir).where("v is not null and bz is not null")
    return both.groupBy(*KEYS).agg(F.max(F.struct("h", "v", "bz")).alias("d")).select(*KEYS, "d.*")


_BLEND = ", ".join(f"f * {c} + (1 - f) * p_{c} AS {c}" for c in ("v", "bz", "by_gsm", "n"))


@query(
    "driver_blend", "series h", "v bz by_gsm n pdyn",
    f"""{CLEAN}, x AS (SELECT series, h, v, bz, by_gsm, n, {", ".join(f"lag({c}) OVER (PARTITION BY series ORDER BY h) AS p_{c}" for c in ("v", "bz", "by_gsm", "n"))},
  least(greatest(CAST(h % 6 AS DOUBLE) / 4.0, 0.0), 1.0) AS f FROM clean), y AS (SELECT series, h, {_BLEND} FROM x),
res AS (SELECT *, CASE WHEN n >= 0 AND v >= 0 THEN {P.PRESSURE!r} * n * (v * v) END AS pdyn FROM y)""",
)
def driver_blend(spark, sf_dir):
    """The measured part of an hour and the hour before it for the rest; the pressure follows from the blended wind."""
    x = clean(spark, sf_dir).withColumn("f", F.least(F.greatest(F.col("h") % 6 / F.lit(4.0), F.lit(0.0)), F.lit(1.0)))
    before = lambda c: F.lag(c).over(gaps.ordered(KEYS))
    blended = x.select("series", "h", *[(F.col("f") * F.col(c) + (1 - F.col("f")) * before(c)).alias(c) for c in ("v", "bz", "by_gsm", "n")])
    return blended.withColumn("pdyn", P.dynamic_pressure("n", "v"))


#: Hours for which a known driver is carried on.
_TAIL = (1, 2, 3, 6)


@query(
    "relaxed_tail", "series h step", "v bz by_gsm tau",
    f"""{CLEAN}, x AS (SELECT series, h, v, bz, by_gsm, unnest([1, 2, 3, 6]) AS step, dst - lag(dst) OVER (PARTITION BY series ORDER BY h) AS rate FROM clean),
y AS (SELECT *, least(48.0, 3.0 * (1 + greatest(0.0, -coalesce(rate, 0.0)) / 7.5)) AS tau FROM x WHERE v IS NOT NULL AND bz IS NOT NULL),
res AS (SELECT series, h, step, v, bz * exp(-step / tau) AS bz, by_gsm * exp(-step / tau) AS by_gsm, tau FROM y)""",
)
def relaxed_tail(spark, sf_dir):
    """Drivers beyond the last measurement: the field decays, the more slowly the faster the index falls; the speed stays."""
    rate = F.col("dst") - F.lag("dst").over(gaps.ordered(KEYS))
    x = clean(spark, sf_dir).withColumn("rate", rate).where("v is not null and bz is not null")
    x = x.withColumn("tau", F.least(F.lit(48.0), 3.0 * (1 + F.greatest(F.lit(0.0), -F.coalesce("rate", F.lit(0.0))) / 7.5)))
    x = x.select("*", F.explode(F.array(*[F.lit(s) for s in _TAIL])).alias("step"))
    decay = F.exp(-F.col("step") / F.col("tau"))
    return x.select("series", "h", "step", "v", (F.col("bz") * decay).alias("bz"), (F.col("by_gsm") * decay).alias("by_gsm"), "tau")


def _rate_sql(state: str) -> str:
    return f"least(greatest(-0.2 - 0.09 * {state} - 3.9e-3 * v * bs - 1e-7 * (v * bs) * (v * bs), -200.0), 200.0)"


@query(
    "anchored_steps", "series h anchored", "state forecast",
    f"""RECURSIVE {CLEAN}, g AS (SELECT series, h, row_number() OVER (PARTITION BY series ORDER BY h) AS k, v, bs, dst FROM clean WHERE v IS NOT NULL AND bs IS NOT NULL),
sim AS (SELECT series, h, k, CAST(-20.0 AS DOUBLE) AS state, least(greatest(-20.0 + {_rate_sql("-20.0")}, -2000.0), 50.0) AS forecast, dst FROM g WHERE k = 1
 UNION ALL SELECT g.series, g.h, g.k, coalesce(sim.dst, sim.forecast), least(greatest(coalesce(sim.dst, sim.forecast) + {_rate_sql("coalesce(sim.dst, sim.forecast)")}, -2000.0), 50.0), g.dst FROM sim JOIN g ON g.series = sim.series AND g.k = sim.k + 1),
res AS (SELECT series, h, dst IS NOT NULL AS anchored, state, forecast FROM sim)""",
)
def anchored_steps(spark, sf_dir):
    """A step for each hour with drivers: the forecast from the state, which then becomes the observation where there is one, else the forecast."""
    from .folds import sparse_rate

    rows = clean(spark, sf_dir).where("v is not null and bs is not null")
    ahead = lambda s, r: P.euler(s, sparse_rate(r["v"], r["bs"], s))
    folded = folds.collected(rows, KEYS, "h", ["v", "bs", "dst"])
    values = folds.trajectory(F.col("rows"), F.lit(-20.0), lambda s, r: F.coalesce(r["dst"], ahead(s, r)), lambda s, r: F.struct(s.alias("state"), ahead(s, r).alias("forecast")), "double", "struct<state:double,forecast:double>")
    paired = folded.select(*KEYS, "rows", values.alias("made")).select(*KEYS, F.explode(F.arrays_zip("rows", "made")).alias("z"))
    return paired.select(*KEYS, "z.rows.h", F.col("z.rows.dst").isNotNull().alias("anchored"), "z.made.state", "z.made.forecast")


@query("wilcoxon_p", "step n_pairs", "w z p", registry.ORACLES["wilcoxon"].partition("WITH ")[2].rpartition("\nSELECT")[0].replace("res AS (SELECT step", "zs AS (SELECT step") + f", res AS (SELECT step, n_pairs, least(w_plus, w_minus) AS w, z, least(1.0, {ERFC.format(x='(-z / sqrt(2.0))')}) AS p FROM zs)")
def wilcoxon_p(spark, sf_dir):
    """The two-sided p of the signed-rank test, from the lower tail."""
    return wilcoxon(spark, sf_dir).select("step", "n_pairs", F.least("w_plus", "w_minus").alias("w"), "z", F.least(F.lit(1.0), erfc(-F.col("z") / F.sqrt(F.lit(2.0)))).alias("p"))
