"""Live queries on Structured Streaming: windows, sessions, duplicates, late truth and state per stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.adaptive import Stream
from ..operators.scratch import folder


#: A time after all others, in seconds since 1970: the year 2200.
_FAR = 7_258_118_400


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, be it one file or a folder of them; event time is a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what is there and gives its result; state and progress lie in the shared folder.

    In complete and update mode each batch replaces the table or its own part of it by a new
    numbered version, so a batch that is run again after a failure changes nothing.
    """
    spark = stream.sparkSession
    path = folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema.add("batch", "long") if "batch" not in stream.schema.names else stream.schema
    result = spark.read.schema(schema).parquet(f"{path}/data")
    if mode == "complete":
        last = result.agg(F.max("batch")).first()[0]
        result = result.where(F.col("batch") == F.lit(last))
    return result.drop("batch")


def hourly(events: DataFrame, least: int) -> DataFrame:
    """Tumbling hours in event time with a minimum number of samples."""
    w = F.window("ts", "1 hour")
    return events.withWatermark("ts", "2 hours").groupBy(w).agg(F.count("value").alias("n_samples"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "n_samples", F.when(F.col("n_samples") >= least, F.col("mean_value")).alias("mean_value"))


def sliding(events: DataFrame) -> DataFrame:
    """Fifteen-minute windows every five minutes."""
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "15 minutes", "5 minutes"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("peak")).select(F.col("window.start").alias("start"), "event_type", "n", "peak")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.withWatermark("ts", "2 hours").groupBy(F.session_window("ts", gap), "g").agg(F.count("*").alias("size")).select("g", F.col("session_window.start").alias("start"), "size")


def first_of_key(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def late_truth(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """Forecasts joined to observations of their target time, whichever comes first; both sides forget after a day."""
    f = forecasts.withWatermark("target", "1 day")
    t = truth.withWatermark("seen", "1 day")
    return f.join(t, (f.g == t.g2) & (f.target == t.seen))


def with_late_truth(forecasts: DataFrame, truth: DataFrame, keys: list[str], truth_keys: list[str]) -> DataFrame:
    """Every forecast once: joined to the observation of its ``target`` hour, or to none once the watermark has passed it.

    Both tables are written as files and streamed.  When all are read, one row a side far ahead of them closes the day
    for which either side waits, so the forecasts still pending come out without a truth; those two rows are left out.
    Keys are numbers or strings.
    """
    spark = forecasts.sparkSession
    paths = [folder(spark, "forecasts"), folder(spark, "truths")]
    for rows, path in zip((forecasts, truth), paths, strict=True):
        rows.write.parquet(path)
    left, right = (spark.readStream.schema(rows.schema).parquet(path) for rows, path in zip((forecasts, truth), paths, strict=True))
    same = [F.col(a) == F.col(b) for a, b in zip(keys, truth_keys, strict=True)]
    f, t = left.withWatermark("target", "1 day"), right.withWatermark("seen", "1 day")
    joined = f.join(t, [*same, F.col("target") == F.col("seen")], "left_outer")
    out = folder(spark, "truth")

    def run() -> None:
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

        joined.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    for rows, path, at, own in ((forecasts, paths[0], "target", keys), (truth, paths[1], "seen", truth_keys)):
        # keys that are null are filtered before they reach the watermark
        given = {at: F.timestamp_seconds(F.lit(_FAR)), **dict.fromkeys(own, F.lit("0"))}
        spark.range(1).select(*[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in rows.dtypes]).write.mode("append").parquet(path)
    run()
    found = spark.read.schema(joined.schema).parquet(f"{out}/data")
    return found.where(F.col("target") < F.timestamp_seconds(F.lit(_FAR)))


def _kept(columns: list[str], rows: pd.DataFrame) -> list[tuple]:
    return list(rows[columns].itertuples(index=False, name=None))


def adaptive(events: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Adaptive conformal intervals with one state per stream; rows of a batch are taken in order of time."""
    kinds = dict(events.dtypes)
    out = ", ".join([*[f"{k} {kinds[k]}" for k in [*keys, time]], "low double, high double, covered boolean, alpha double"])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alpha, recent = state.get if state.exists else (None, [])
        stream = Stream(alpha=alpha, recent=recent)
        rows = pd.concat(list(batches)).sort_values(time)
        results = []
        for at, point, seen in _kept([time, "point", "observed"], rows):
            low, high, covered, level = stream.step(None if pd.isna(point) else float(point), None if pd.isna(seen) else float(seen))
            finite = lambda x: x if x is not None and abs(x) != float("inf") else None
            results.append((*key, at, finite(low), finite(high), covered, level))
        state.update((stream.alpha, list(stream.recent)))
        frame = pd.DataFrame(results, columns=[*keys, time, "low", "high", "covered", "alpha"])
        frame["covered"] = frame["covered"].astype("boolean")
        yield frame

    return events.groupBy(*keys).applyInPandasWithState(update, out, "alpha double, recent array<double>", "append", GroupStateTimeout.NoTimeout)


def alarms(events: DataFrame, keys: list[str], time: str, rank: str, cooldown: int) -> DataFrame:
    """Alarms with a cooldown that a more severe level breaks; the last alarm of each stream is its state."""
    kinds = dict(events.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in [*keys, time, rank])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, level = state.get if state.exists else (-(1 << 40), 0)
        fired = []
        for at, now in _kept([time, rank], pd.concat(list(batches)).sort_values(time)):
            if now > 0 and not (at - last <= cooldown and now <= level):
                last, level = int(at), int(now)
                fired.append((*key, at, now))
        state.update((last, level))
        yield pd.DataFrame(fired, columns=[*keys, time, rank])

    return events.groupBy(*keys).applyInPandasWithState(update, out, "last long, level int", "append", GroupStateTimeout.NoTimeout)


def hours_once(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per new hour of a stream: an hour that was already processed, or an earlier one, is not taken again."""
    kinds = dict(events.dtypes)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        hours = sorted(h for h in set(pd.concat(list(batches))["h"]) if h > last)
        if hours:
            state.update((int(hours[-1]),))
        yield pd.DataFrame([(*key, h) for h in hours], columns=[*keys, "h"])

    return events.groupBy(*keys).applyInPandasWithState(update, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "h long"]), "last long", "append", GroupStateTimeout.NoTimeout)


