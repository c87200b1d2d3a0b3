"""Query registration, and the tables that the queries share, in Spark and as SQL.

The tables are not space weather, so ``events`` stands for the sensors: hourly means of its event
types become channels, and the parity of the user is the station.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import gaps
from . import registry

HOURS, STATIONS = 720, 2
KEYS = ["series"]
START = "2024-01-01 00:00:00"
#: channel -> (event type, offset, factor)
CHANNELS = {"v": ("view", 300, 2.0), "bz": ("click", 6, -0.25), "n": ("purchase", 1, 0.2), "by_gsm": ("signup", -10, 0.2), "dst": ("error", 10, -1.0)}


#: Added before the last rounding: exact half-way cases, which the engines round differently, move off the border.
OFF = 2.3e-8


def rounded(df: DataFrame, keys: list[str], doubles: list[str]) -> DataFrame:
    return df.select(*keys, *[(F.round(F.col(c).cast("double") + F.lit(OFF), 6) + F.lit(0.0)).alias(c) for c in doubles])


def query(name: str, keys: str, doubles: str = "", sql: str | None = None) -> Callable:
    """Registers a query; its SQL is a list of CTEs of which the last is ``res``."""
    k, d = keys.split(), doubles.split()

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir), k, d)

        assert name not in registry.QUERIES
        registry.QUERIES[name] = run
        if sql:
            columns = ", ".join([*k, *[f"round(CAST({c} AS DOUBLE) + 2.3e-8, 6) + 0.0 AS {c}" for c in d]])
            registry.ORACLES[name] = f"WITH {sql}\nSELECT {columns} FROM res"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def since(unit: str, ts: str = "ts") -> Column:
    """Whole units from START; the same in every session time zone."""
    return F.expr(f"timestampdiff({unit}, timestamp_ntz'{START}', cast({ts} as timestamp_ntz))").cast("long")


SECONDS = f"CAST(floor(epoch(ts - TIMESTAMP '{START}')) AS BIGINT)"


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, h and the channels for every hour; null where a channel has no event."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % STATIONS).alias("series"), F.floor(since("MICROSECOND") / 3_600_000_000).alias("h"), "event_type", "value")
    means = [F.round(a + b * F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 9).alias(c) for c, (kind, a, b) in CHANNELS.items()]
    # the hours of the SQL at least, and all that have events
    reach = events.agg(F.least(F.min("h"), F.lit(0).cast("long")).alias("first"), F.greatest(F.max("h"), F.lit(HOURS - 1).cast("long")).alias("last"))
    spine = reach.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(STATIONS - 1).cast("long"))).alias("series"), "first", "last").select("series", F.explode(F.sequence("first", "last")).alias("h"))
    return spine.join(events.groupBy("series", "h").agg(*means), ["series", "h"], "left")


_MEANS = ", ".join(f"round({a} + {b} * avg(value) FILTER (WHERE event_type = '{kind}'), 9) AS {c}" for c, (kind, a, b) in CHANNELS.items())
FRAME = f"""
e AS (SELECT user_id % {STATIONS} AS series, CAST(floor({SECONDS} / 3600) AS BIGINT) AS h, event_type, value FROM events),
spine AS (SELECT i // {HOURS} AS series, i % {HOURS} AS h FROM range({STATIONS * HOURS}) t(i)),
means AS (SELECT series, h, {_MEANS} FROM e GROUP BY 1, 2),
frame AS (SELECT spine.series, spine.h, v, bz, n, by_gsm, dst FROM spine LEFT JOIN means USING (series, h))"""


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame with short gaps filled and its derived columns: bs, theta_c, bt, pdyn, quality, pressure (carried), dst_star."""
    filled = gaps.interpolate(frame(spark, sf_dir), list(CHANNELS), KEYS)
    return derive(filled)


def derive(df: DataFrame) -> DataFrame:
    df = df.withColumns({"pdyn": P.dynamic_pressure("n", "v"), "bs": P.southward("bz"), "theta_c": P.clock_angle("by_gsm", "bz"), "bt": P.transverse("by_gsm", "bz")})
    ok = F.col("v").isNotNull() & F.col("bz").isNotNull() & F.col("dst").isNotNull() & F.col("n").isNotNull() & F.col("pdyn").isNotNull()
    last = F.last(F.when(F.col("pdyn").isNotNull(), F.struct("h", "pdyn")), True).over(gaps.before(KEYS))
    carried = F.when(F.col("h") - last["h"] <= P.PRESSURE_MAX_AGE, last["pdyn"])
    df = df.withColumns({"quality": ok.cast("int"), "pressure": F.coalesce(carried, F.lit(P.QUIET_PRESSURE))})
    return df.withColumn("dst_star", P.dst_star("dst", "pressure"))


def _filled(c: str, gap: int) -> str:
    prior, later = "OVER (PARTITION BY series ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "OVER (PARTITION BY series ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    h = f"CASE WHEN {c} IS NOT NULL THEN h END"
    a, b, x, y = f"max({h}) {prior}", f"min({h}) {later}", f"last_value({c} IGNORE NULLS) {prior}", f"first_value({c} IGNORE NULLS) {later}"
    return f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {b} - {a} - 1 <= {gap} THEN {x} + (h - {a}) / ({b} - {a}) * ({y} - {x}) END AS {c}"


def derived_sql(source: str, to: str) -> str:
    return f"""
{to}_p AS (SELECT *, CASE WHEN n >= 0 AND v >= 0 THEN {P.PRESSURE!r} * n * (v * v) END AS pdyn, CASE WHEN bz IS NOT NULL THEN greatest(-bz, 0.0) END AS bs,
  atan2(abs(by_gsm), bz) AS theta_c, sqrt(by_gsm * by_gsm + bz * bz) AS bt FROM {source}),
{to}_q AS (SELECT *, CASE WHEN v IS NOT NULL AND bz IS NOT NULL AND dst IS NOT NULL AND n IS NOT NULL AND pdyn IS NOT NULL THEN 1 ELSE 0 END AS quality,
  coalesce(CASE WHEN h - max(CASE WHEN pdyn IS NOT NULL THEN h END) OVER w <= 6 THEN last_value(pdyn IGNORE NULLS) OVER w END, 2.0) AS pressure
  FROM {to}_p WINDOW w AS (PARTITION BY series ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{to} AS (SELECT *, dst - 7.26 * sqrt(greatest(pressure, 0.0)) + 11.0 AS dst_star FROM {to}_q)"""


CLEAN = f"{FRAME},\nfilled AS (SELECT series, h, {', '.join(_filled(c, 3) for c in CHANNELS)} FROM frame)," + derived_sql("filled", "clean")

STEPS = (1, 2, 3, 6)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each series, issue hour and lead: the latest index, three forecasts and the observation (null until it is there)."""
    base = clean(spark, sf_dir)
    issued = base.where("dst is not null").select("series", F.col("h").alias("issue_h"), F.explode(F.array(*[F.lit(s) for s in STEPS])).alias("step"), F.col("dst").alias("latest"), "dst_star", "pressure", "v", "bs")
    hours = F.col("step")
    zero = F.lit(0.0)
    star_b = P.euler(F.col("dst_star"), P.burton(F.coalesce("v", zero), F.coalesce("bs", zero), "dst_star"), hours)
    star_o = P.euler(F.col("dst_star"), P.obrien(F.coalesce("v", zero), F.coalesce("bs", zero), "dst_star"), hours)
    observed = base.select("series", F.col("h").alias("target_h"), F.col("dst").alias("obs"))
    made = issued.select(
        "series", "issue_h", "step", (F.col("issue_h") + F.col("step")).alias("target_h"), "latest", F.col("latest").alias("persistence"),
        P.dst_from_star(star_b, "pressure").alias("burton"), P.dst_from_star(star_o, "pressure").alias("obrien"),
    )
    return made.join(observed, ["series", "target_h"], "left")


def _star(rate: str) -> str:
    return f"least(greatest(dst_star + least(greatest({rate}, -200.0), 200.0) * step, -2000.0), 50.0) + 7.26 * sqrt(greatest(pressure, 0.0)) - 11.0"


LOG = f"""{CLEAN},
issued AS (SELECT series, h AS issue_h, unnest([1, 2, 3, 6]) AS step, dst AS latest, dst_star, pressure, coalesce(v, 0.0) AS v0, coalesce(bs, 0.0) AS b0 FROM clean WHERE dst IS NOT NULL),
made AS (SELECT series, issue_h, step, issue_h + step AS target_h, latest, latest AS persistence,
  {_star("-5.4e-3 * v0 * b0 - dst_star / 7.7")} AS burton,
  {_star("CASE WHEN v0 * b0 / 1000.0 > 0.49 THEN -4.4 * (v0 * b0 / 1000.0 - 0.49) ELSE 0.0 END - dst_star / (2.40 * exp(9.74 / (4.69 + v0 * b0 / 1000.0)))")} AS obrien FROM issued),
log AS (SELECT made.*, c.dst AS obs FROM made LEFT JOIN clean c ON c.series = made.series AND c.h = made.target_h)"""
