"""Streams run over the table as it is; the batch answer is their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators.scratch import folder
from ..streaming import live
from .base import LOG, SECONDS, log, query, since


def _events(spark, sf_dir):
    return live.stream_of(spark, f"{sf_dir}/events.parquet")


def _start():
    return F.expr("timestampdiff(SECOND, timestamp'2024-01-01 00:00:00', start)")


@query("stream_hourly", "s n_samples", "mean_value", f"res AS (SELECT CAST(floor({SECONDS} / 3600) AS BIGINT) * 3600 AS s, count(value) AS n_samples, CASE WHEN count(value) >= 10 THEN avg(value) END AS mean_value FROM events GROUP BY 1)")
def stream_hourly(spark, sf_dir):
    return live.run_to_end(live.hourly(_events(spark, sf_dir), 10), "complete", "hourly").withColumn("s", _start())


@query(
    "stream_sliding", "s event_type n", "peak",
    f"x AS (SELECT event_type, value, unnest([0, 300, 600]) AS back, {SECONDS} AS t FROM events), res AS (SELECT CAST(floor(t / 300) AS BIGINT) * 300 - back AS s, event_type, count(*) AS n, max(value) AS peak FROM x GROUP BY ALL)",
)
def stream_sliding(spark, sf_dir):
    return live.run_to_end(live.sliding(_events(spark, sf_dir)), "complete", "sliding").withColumn("s", _start())


@query(
    "stream_sessions", "g s size", "",
    f"""x AS (SELECT user_id % 16 AS g, ts, {SECONDS} AS t, lag(ts) OVER (PARTITION BY user_id % 16 ORDER BY ts) AS p FROM events), y AS (SELECT g, ts, t, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY ts) AS k FROM x),
res AS (SELECT g, min(t) AS s, count(*) AS size FROM y GROUP BY g, k)""",
)
def stream_sessions(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("g", F.col("user_id") % 16)
    return live.run_to_end(live.sessions(events, "30 minutes"), "complete", "sessions").withColumn("s", _start())


@query("stream_first_of_key", "user_id h", "", f"res AS (SELECT DISTINCT user_id, CAST(floor({SECONDS} / 3600) AS BIGINT) AS h FROM events)")
def stream_first_of_key(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("h", since("HOUR")).select("ts", "user_id", "h")
    return live.run_to_end(live.first_of_key(events, ["user_id", "h"], "30 days"), "append", "first")


@query(
    "stream_late_truth", "g h n_pairs", "forecast truth",
    f"""x AS (SELECT user_id % 4 AS g, CAST(floor({SECONDS} / 3600) AS BIGINT) AS h, event_type, value FROM events), f AS (SELECT g, h + 1 AS h, value FROM x WHERE event_type = 'view'), t AS (SELECT g, h, value FROM x WHERE event_type = 'error'),
res AS (SELECT f.g, f.h, count(*) AS n_pairs, avg(f.value) AS forecast, avg(t.value) AS truth FROM f JOIN t ON f.g = t.g AND f.h = t.h GROUP BY ALL)""",
)
def stream_late_truth(spark, sf_dir):
    hour = F.date_trunc("hour", "ts")
    f = _events(spark, sf_dir).where("event_type = 'view'").select((F.col("user_id") % 4).alias("g"), (hour + F.expr("interval 1 hour")).alias("target"), F.col("value").alias("forecast"))
    t = _events(spark, sf_dir).where("event_type = 'error'").select((F.col("user_id") % 4).alias("g2"), hour.alias("seen"), F.col("value").alias("truth"))
    pairs = live.run_to_end(live.late_truth(f, t), "append", "truth")
    h = F.expr("timestampdiff(HOUR, timestamp'2024-01-01 00:00:00', target)")
    return pairs.groupBy("g", h.alias("h")).agg(F.count("*").alias("n_pairs"), F.avg("forecast").alias("forecast"), F.avg("truth").alias("truth"))


def _log_stream(spark, sf_dir):
    path = folder(spark, "log")
    rows = log(spark, sf_dir).select("series", "step", "issue_h", F.col("burton").alias("point"), F.col("obs").alias("observed"))
    rows.write.parquet(path)  # all files are one batch, in which each state sorts its own rows
    return spark.readStream.schema(rows.schema).parquet(path)


@query("stream_adaptive", "series step issue_h covered", "low high alpha")
def stream_adaptive(spark, sf_dir):
    """State per series and lead; tests hold it against the batch query."""
    return live.run_to_end(live.adaptive(_log_stream(spark, sf_dir), ["series", "step"], "issue_h"), "append", "adaptive")


@query(
    "stream_alarms", "series n_issues deepest", "",
    f"""{LOG}, res AS (SELECT series, count(*) AS n_issues, max(CASE WHEN burton <= -200 THEN 3 WHEN burton <= -100 THEN 2 WHEN burton <= -50 THEN 1 ELSE 0 END) AS deepest FROM log WHERE step = 1 GROUP BY series HAVING max(CASE WHEN burton <= -50 THEN 1 ELSE 0 END) = 1)""",
)
def stream_alarms(spark, sf_dir):
    """The most severe alarm of each series beside its number of issues: the last alarm state never misses the deepest level."""
    rows = _log_stream(spark, sf_dir).where("step = 1").withColumn("rank", P.severity_rank("point"))
    fired = live.run_to_end(live.alarms(rows.select("series", "issue_h", "rank"), ["series"], "issue_h", "rank", 6), "append", "alarms")
    issues = log(spark, sf_dir).where("step = 1").groupBy("series").agg(F.count("*").alias("n_issues"))
    return fired.groupBy("series").agg(F.max("rank").alias("deepest")).join(issues, "series")


@query("stream_hours_once", "g n_hours last_h", "", f"x AS (SELECT DISTINCT user_id % 4 AS g, CAST(floor({SECONDS} / 3600) AS BIGINT) AS h FROM events), res AS (SELECT g, count(*) AS n_hours, max(h) AS last_h FROM x GROUP BY g)")
def stream_hours_once(spark, sf_dir):
    events = _events(spark, sf_dir).withColumns({"g": F.col("user_id") % 4, "h": since("HOUR")}).select("g", "h")
    taken = live.run_to_end(live.hours_once(events, ["g"]), "append", "hours")
    return taken.groupBy("g").agg(F.count("*").alias("n_hours"), F.max("h").alias("last_h"))
