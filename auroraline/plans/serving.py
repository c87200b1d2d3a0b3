"""What a dashboard asks of the forecast log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import FRAME, LOG, SECONDS, frame, log, query, since, table

_VIEW = f"{LOG}, v AS (SELECT series, issue_h, step, target_h, latest, least(burton, obrien) AS served, least(burton, obrien) - 15 - 2 * step AS low, least(burton, obrien) + 15 + 2 * step AS high, persistence, obs FROM log)"


def served(spark, sf_dir) -> DataFrame:
    center = F.least("burton", "obrien")
    return log(spark, sf_dir).select("series", "issue_h", "step", "target_h", "latest", center.alias("served"), (center - 15 - 2 * F.col("step")).alias("low"), (center + 15 + 2 * F.col("step")).alias("high"), "persistence", "obs")


def threat(x: Column) -> Column:
    """Level of the display: -30, -50, -100 and -200 are the borders, each part of the deeper level."""
    return F.when(x > -30, 0).when(x > -50, 1).when(x > -100, 2).when(x > -200, 3).otherwise(4)


_THREAT = "CASE WHEN {0} > -30 THEN 0 WHEN {0} > -50 THEN 1 WHEN {0} > -100 THEN 2 WHEN {0} > -200 THEN 3 ELSE 4 END"


@query(
    "verified_rows", "series issue_h step target_h covered", "served error",
    f"{_VIEW}, res AS (SELECT series, issue_h, step, target_h, obs BETWEEN low AND high AS covered, served, obs - served AS error FROM v WHERE obs IS NOT NULL AND served IS NOT NULL AND low <= high AND target_h > issue_h)",
)
def verified_rows(spark, sf_dir):
    rows = served(spark, sf_dir).where("obs is not null and served is not null and low <= high and target_h > issue_h")
    return rows.withColumns({"covered": F.col("obs").between(F.col("low"), F.col("high")), "error": F.col("obs") - F.col("served")})


def valid_cycles(rows: DataFrame) -> DataFrame:
    """Issue hours that have all leads once, one anchor and ordered intervals."""
    whole = rows.groupBy("series", "issue_h").agg(F.sort_array(F.collect_list("step")).alias("steps"), F.min("latest").alias("a"), F.max("latest").alias("b"), F.bool_and((F.col("low") <= F.col("served")) & (F.col("served") <= F.col("high"))).alias("ordered"))
    return whole.where((F.col("steps") == F.array(*[F.lit(s) for s in (1, 2, 3, 6)])) & (F.col("a") == F.col("b")) & F.col("ordered")).select("series", "issue_h")


_VALID = f"{_VIEW}, cyc AS (SELECT series, issue_h FROM v GROUP BY ALL HAVING list_sort(list(step)) = [1, 2, 3, 6] AND min(latest) = max(latest) AND bool_and(low <= served AND served <= high)), last AS (SELECT series, max(issue_h) AS issue_h FROM cyc GROUP BY series)"


def latest_cycle(spark, sf_dir) -> DataFrame:
    rows = served(spark, sf_dir)
    last = valid_cycles(rows).groupBy("series").agg(F.max("issue_h").alias("issue_h"))
    return rows.join(last, ["series", "issue_h"])


@query("api_forecast", "series issue_h step target_h", "served low high", f"{_VALID}, res AS (SELECT v.* FROM v JOIN last USING (series, issue_h))")
def api_forecast(spark, sf_dir):
    return latest_cycle(spark, sf_dir)


def status(cycle: DataFrame) -> DataFrame:
    s = cycle.groupBy("series", "issue_h").agg(F.min("served").alias("deepest"), F.min("low").alias("edge"), F.min_by("step", F.struct("served", "step")).alias("lead"))
    return s.withColumns({"level": threat(F.col("deepest")), "watch_level": threat(F.col("edge"))})


_STATUS = f"{_VALID}, st AS (SELECT v.series, v.issue_h, min(served) AS deepest, min(low) AS edge, arg_min(step, (served, step)) AS lead, {_THREAT.format('min(served)')} AS level, {_THREAT.format('min(low)')} AS watch_level FROM v JOIN last USING (series, issue_h) GROUP BY ALL)"


@query("api_status", "series issue_h lead level watch_level", "deepest edge", f"{_STATUS}, res AS (SELECT * FROM st)")
def api_status(spark, sf_dir):
    return status(latest_cycle(spark, sf_dir))


@query(
    "api_alerts", "series kind level", "depth",
    f"{_STATUS}, res AS (SELECT series, 'forecast' AS kind, level, deepest AS depth FROM st WHERE level >= 1 UNION ALL SELECT series, 'watch', watch_level, edge FROM st WHERE watch_level > level)",
)
def api_alerts(spark, sf_dir):
    """A forecast alert from the first level on, and a watch where the interval's edge is deeper."""
    entry = lambda c, kind, level, depth: F.when(c, F.struct(F.lit(kind).alias("kind"), F.col(level).alias("level"), F.col(depth).alias("depth")))
    both = F.array_compact(F.array(entry(F.col("level") >= 1, "forecast", "level", "deepest"), entry(F.col("watch_level") > F.col("level"), "watch", "watch_level", "edge")))
    return status(latest_cycle(spark, sf_dir)).select("series", F.explode(both).alias("a")).select("series", "a.*")


@query(
    "api_history", "series n_window n_all", "coverage_window rmse_window coverage_all rmse_all",
    f"""{_VIEW}, x AS (SELECT series, target_h >= 624 AS w, CASE WHEN obs BETWEEN low AND high THEN 1.0 ELSE 0.0 END AS c, (obs - served) ** 2 AS e FROM v WHERE obs IS NOT NULL),
res AS (SELECT series, count(*) FILTER (WHERE w) AS n_window, count(*) AS n_all, avg(c) FILTER (WHERE w) AS coverage_window, sqrt(avg(e) FILTER (WHERE w)) AS rmse_window, avg(c) AS coverage_all, sqrt(avg(e)) AS rmse_all FROM x GROUP BY series)""",
)
def api_history(spark, sf_dir):
    """Coverage and RMSE of the last four days beside those of the whole log."""
    rows = served(spark, sf_dir).where("obs is not null").select("series", (F.col("target_h") >= 624).alias("w"), F.col("obs").between(F.col("low"), F.col("high")).cast("double").alias("c"), F.pow(F.col("obs") - F.col("served"), F.lit(2)).alias("e"))
    near = lambda c: F.when(F.col("w"), F.col(c))
    return rows.groupBy("series").agg(F.count_if("w").alias("n_window"), F.count("*").alias("n_all"), F.avg(near("c")).alias("coverage_window"), F.sqrt(F.avg(near("e"))).alias("rmse_window"), F.avg("c").alias("coverage_all"), F.sqrt(F.avg("e")).alias("rmse_all"))


@query(
    "calibration_summary", "model n_rows shown", "rmse",
    f"""{LOG}, x AS (UNPIVOT (SELECT obs, persistence, burton, obrien FROM log WHERE obs IS NOT NULL) ON persistence, burton, obrien INTO NAME model VALUE p), res AS (SELECT model, count(*) AS n_rows, count(*) >= 48 AS shown, sqrt(avg((obs - p) ** 2)) AS rmse FROM x GROUP BY model)""",
)
def calibration_summary(spark, sf_dir):
    """RMSE of every model over the rows that all of them have; shown from 48 rows on."""
    long = log(spark, sf_dir).where("obs is not null").unpivot(["obs"], ["persistence", "burton", "obrien"], "model", "p")
    return long.groupBy("model").agg(F.count("*").alias("n_rows"), (F.count("*") >= 48).alias("shown"), F.sqrt(F.avg(F.pow(F.col("obs") - F.col("p"), F.lit(2)))).alias("rmse"))


@query(
    "stage_health", "series n_cycles n_fallback", "fallback_rate",
    f"""{_VIEW}, c AS (SELECT series, issue_h, max(CASE WHEN served < latest - 20 THEN 1 ELSE 0 END) AS f FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY issue_h DESC) AS k FROM c),
res AS (SELECT series, count(*) AS n_cycles, CAST(sum(f) AS BIGINT) AS n_fallback, avg(f) AS fallback_rate FROM r WHERE k <= 24 GROUP BY series)""",
)
def stage_health(spark, sf_dir):
    """The share of the last 24 cycles in which any lead fell back."""
    cycles = served(spark, sf_dir).groupBy("series", "issue_h").agg(F.max((F.col("served") < F.col("latest") - 20).cast("int")).alias("f"))
    k = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("issue_h")))
    return cycles.withColumn("k", k).where("k <= 24").groupBy("series").agg(F.count("*").alias("n_cycles"), F.sum("f").alias("n_fallback"), F.avg("f").alias("fallback_rate"))


@query(
    "recent_observed", "g h event_id", "dst",
    f"""x AS (SELECT user_id % 4 AS g, CAST(floor({SECONDS} / 3600) AS BIGINT) AS h, event_id, 10 - value AS dst FROM events WHERE event_type = 'error'), res AS (SELECT g, h, max(event_id) AS event_id, arg_max(dst, event_id) AS dst FROM x WHERE h >= 648 GROUP BY ALL)""",
)
def recent_observed(spark, sf_dir):
    """One value per hour of the last three days; the last one written wins."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 4).alias("g"), since("HOUR").alias("h"), "event_id", (10 - F.col("value")).alias("dst")).where("h >= 648")
    return rows.groupBy("g", "h").agg(F.max("event_id").alias("event_id"), F.max_by("dst", "event_id").alias("dst"))


@query(
    "first_writes", "g h event_id", "",
    f"x AS (SELECT user_id % 4 AS g, CAST(floor({SECONDS} / 3600) AS BIGINT) AS h, event_id, {SECONDS} AS s FROM events), res AS (SELECT g, h, arg_min(event_id, (s, event_id)) AS event_id FROM x GROUP BY ALL)",
)
def first_writes(spark, sf_dir):
    """Of rows with one key the earliest is kept."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("g"), since("HOUR").alias("h"), "event_id", since("SECOND").alias("s"))
    return rows.groupBy("g", "h").agg(F.min_by("event_id", F.struct("s", "event_id")).alias("event_id"))


@query(
    "freshness", "series state", "",
    f"{FRAME}, x AS (SELECT series, max(CASE WHEN dst IS NOT NULL THEN h END) AS last FROM frame GROUP BY series), res AS (SELECT series, CASE WHEN last IS NULL THEN 'absent' WHEN 719 - last > 6 THEN 'stale' WHEN last > 719 THEN 'future' ELSE 'fresh' END AS state FROM x)",
)
def freshness(spark, sf_dir):
    last = frame(spark, sf_dir).groupBy("series").agg(F.max(F.when(F.col("dst").isNotNull(), F.col("h"))).alias("last"))
    return last.select("series", F.when(F.col("last").isNull(), "absent").when(719 - F.col("last") > 6, "stale").when(F.col("last") > 719, "future").otherwise("fresh").alias("state"))


@query(
    "conflicting_revisions", "g m n_versions", "",
    f"x AS (SELECT user_id % 4 AS g, CAST(floor({SECONDS} / 600) AS BIGINT) AS m, value FROM events WHERE event_type = 'view'), res AS (SELECT g, m, count(DISTINCT value) AS n_versions FROM x GROUP BY ALL HAVING count(DISTINCT value) > 1)",
)
def conflicting_revisions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'view'").select((F.col("user_id") % 4).alias("g"), F.floor(since("SECOND") / 600).alias("m"), "value")
    return rows.groupBy("g", "m").agg(F.count_distinct("value").alias("n_versions")).where("n_versions > 1")


@query(
    "station_rates", "station n_minutes", "last_rate peak_30",
    f"""x AS (SELECT user_id % 8 AS station, CAST(floor({SECONDS} / 60) AS BIGINT) AS m, avg(value) AS b FROM events GROUP BY ALL), d AS (SELECT station, m, abs(b - lag(b) OVER w) / (m - lag(m) OVER w) AS r FROM x WINDOW w AS (PARTITION BY station ORDER BY m)),
p AS (SELECT *, max(r) OVER (PARTITION BY station ORDER BY m RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS peak FROM d), res AS (SELECT station, count(r) AS n_minutes, arg_max(r, m) AS last_rate, max(peak) AS peak_30 FROM p GROUP BY station)""",
)
def station_rates(spark, sf_dir):
    """Rate of change at each station, and its peak over trailing half hours."""
    x = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("station"), F.floor(since("SECOND") / 60).alias("m"), "value").groupBy("station", "m").agg(F.avg("value").alias("b"))
    w = Window.partitionBy("station").orderBy("m")
    d = x.select("station", "m", (F.abs(F.col("b") - F.lag("b").over(w)) / (F.col("m") - F.lag("m").over(w))).alias("r"))
    p = d.withColumn("peak", F.max("r").over(w.rangeBetween(-29, 0)))
    return p.groupBy("station").agg(F.count("r").alias("n_minutes"), F.max_by("r", "m").alias("last_rate"), F.max("peak").alias("peak_30"))
