"""Ordered operators over hourly series: spines, gaps, lags and runs.

Every window is partitioned by the keys of the series, so series are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], time: str = "h"):
    return Window.partitionBy(*keys).orderBy(time)


def before(keys: list[str], time: str = "h"):
    return ordered(keys, time).rowsBetween(Window.unboundedPreceding, 0)


def after(keys: list[str], time: str = "h"):
    return ordered(keys, time).rowsBetween(0, Window.unboundedFollowing)


def dense(df: DataFrame, keys: list[str], time: str = "h") -> DataFrame:
    """One row for every hour between a series' first and last; missing hours have nulls."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    spine = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias(time))
    return spine.join(df, [*keys, time], "left")


def interpolate(df: DataFrame, columns: list[str], keys: list[str], max_gap: int = 3, time: str = "h") -> DataFrame:
    """Linear fill of gaps of at most ``max_gap`` rows with a value on both sides."""
    back, ahead = before(keys, time), after(keys, time)
    out = {}
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("t"), F.col(c).alias("x")))
        a, b = F.last(known, True).over(back), F.first(known, True).over(ahead)
        share = (F.col(time) - a["t"]) / (b["t"] - a["t"])
        out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(b["t"] - a["t"] - 1 <= max_gap, a["x"] + share * (b["x"] - a["x"]))
    return df.withColumns(out)


def carry(df: DataFrame, columns: list[str], keys: list[str], max_age: int = 3, time: str = "h") -> DataFrame:
    """The last value for at most ``max_age`` rows; only the past decides, so a longer prefix changes nothing."""
    back = before(keys, time)
    out = {}
    for c in columns:
        last = F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("t"), F.col(c).alias("x"))), True).over(back)
        out[c] = F.when(F.col(time) - last["t"] <= max_age, last["x"])
    return df.withColumns(out)


def fill_both(df: DataFrame, columns: list[str], keys: list[str], time: str = "h") -> DataFrame:
    """The last value before, else the first one after."""
    return df.withColumns({c: F.coalesce(F.last(c, True).over(before(keys, time)), F.first(c, True).over(after(keys, time))) for c in columns})


def derivative(column: str, keys: list[str], time: str = "h") -> Column:
    """Central difference, one-sided at the ends; null where a neighbour is null."""
    w = ordered(keys, time)
    left, right = F.lag(time).over(w), F.lead(time).over(w)
    x, back, ahead = F.col(column), F.lag(column).over(w), F.lead(column).over(w)
    return F.when(left.isNull(), ahead - x).when(right.isNull(), x - back).otherwise((ahead - back) / 2)


def smooth(column: str, keys: list[str], width: int, time: str = "h") -> Column:
    """Centred mean over an odd number of rows, cut at the ends; null if the window holds a null."""
    w = ordered(keys, time).rowsBetween(-(width // 2), width // 2)
    return F.when(F.count(column).over(w) == F.count(F.lit(1)).over(w), F.avg(column).over(w))


def run_length(flag: Column, keys: list[str], cap: int, time: str = "h") -> Column:
    """Length of the run of true rows that ends here, at most ``cap``."""
    broken = F.max(F.when(~F.coalesce(flag, F.lit(False)), F.col(time))).over(before(keys, time))
    first = F.min(time).over(before(keys, time))
    return F.least(F.lit(cap), F.col(time) - F.coalesce(broken, first - 1))


def islands(df: DataFrame, flag: Column, keys: list[str], time: str = "h") -> DataFrame:
    """Runs of rows where ``flag`` holds: first, last and size of each."""
    marked = df.where(flag).select(*keys, time)
    number = F.row_number().over(ordered(keys, time))
    runs = marked.withColumn("_run", F.col(time) - number)
    return runs.groupBy(*keys, "_run").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("size")).drop("_run")
