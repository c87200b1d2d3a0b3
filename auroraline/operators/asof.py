"""Joins by nearness in time, by interval and by distance, without theta joins over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: list[str], id_: str, time: str, tolerance: int) -> DataFrame:
    """For each row of ``left`` the row of ``right`` that is nearest in time, within ``tolerance``; ties go to the earlier one.

    Time is cut into buckets as wide as the tolerance, so a match lies in the same bucket or beside
    it: an equi-join on three buckets instead of a comparison of all pairs.
    """
    r = right.select(*keys, F.col(time).alias("_t"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in (*keys, time)], F.floor(F.col(time) / tolerance).alias("_bucket"))
    near = F.explode(F.array(*[F.floor(F.col(time) / tolerance) + d for d in (-1, 0, 1)]))
    pairs = left.withColumn("_bucket", near).join(r, [*keys, "_bucket"]).where(F.abs(F.col("_t") - F.col(time)) <= tolerance)
    best = pairs.groupBy(id_).agg(F.min_by(F.struct("_t", *[c for c in r.columns if c.startswith("r_")]), F.struct(F.abs(F.col("_t") - F.col(time)), "_t")).alias("_m"))
    return left.join(best, id_, "left").select(*left.columns, F.col("_m._t").alias(f"r_{time}"), *[F.col(f"_m.{c}").alias(c) for c in r.columns if c.startswith("r_")])


def backward_forward(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, width: int = 3600) -> DataFrame:
    """For each row of ``left`` the last value of ``right`` at or before it and the first one at or after it.

    Time is cut into slots of ``width``; windows stay inside a slot, and the value from another slot
    comes from a table with a row for each slot, so tasks do not grow with the length of a series.
    A row without a key or a time matches nothing; a null value is a value.
    """
    known = right.dropna(subset=[*keys, time]).select(*keys, time, F.lit(0).alias("_side"), F.struct(F.col(value).cast("double").alias("x")).alias("_v"))
    both = left.withColumn("_side", F.lit(1)).unionByName(known, allowMissingColumns=True).withColumn("_slot", F.floor(F.col(time) / width))
    at = F.when(F.col("_side") == 0, F.col(time))
    ends = both.groupBy(*keys, "_slot").agg(F.min_by("_v", at).alias("_first"), F.max_by("_v", at).alias("_last"))
    # both windows start at their first row: a frame that reaches to the last one is read anew for every row
    w = Window.partitionBy(*keys)
    slots = ends.select(
        *keys, "_slot", F.last("_last", True).over(w.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("_first", True).over(w.orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after")
    )
    # at one time, rows of the right come before those of the left
    w = Window.partitionBy(*keys, "_slot")
    back, ahead = (F.last("_v", True).over(w.orderBy(o, "_side").rowsBetween(Window.unboundedPreceding, 0)) for o in (time, F.desc(time)))
    found = both.join(slots, [*keys, "_slot"], "left").withColumns({"back": F.coalesce(back, "_before")["x"], "ahead": F.coalesce(ahead, "_after")["x"]})
    return found.where("_side = 1").select(*left.columns, "back", "ahead")


def in_intervals(rows: DataFrame, spans: DataFrame, keys: list[str], time: str, first: str = "first", last: str = "last") -> DataFrame:
    """Rows with the spans that hold them; spans are spelled out hour by hour, so the join is on equal values."""
    hours = spans.withColumn(time, F.explode(F.sequence(first, last)))
    return rows.join(hours, [*keys, time])
