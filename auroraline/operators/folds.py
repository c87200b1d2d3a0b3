"""Sequential recursions: state(k + 1) = f(state(k), row(k)), with limits, so no prefix sum can give them.

A series' rows are sorted into one array per series (or per storm, per replica: bounded by the
length of an event) and folded by a higher-order function inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collected(rows: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """One row per key with its rows in order of time, in ``rows``."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(time, *columns))).alias("rows"))


def trajectory(rows: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], state_type: str, out_type: str) -> Column:
    """The emitted values of a fold: before each step, ``emit(state, row)``; then ``step(state, row)``.

    Appending to an array copies it, so the rows are folded in blocks of about the root of their number, and
    only whole blocks are appended: n ** 1.5 copied values for n rows instead of n ** 2.
    """
    none = F.array().cast(f"array<{out_type}>")
    pair = lambda state, out: F.struct(state.cast(state_type).alias("s"), out.alias("out"))

    def merge(acc: Column, row: Column) -> Column:
        return pair(step(acc["s"], row), F.concat(acc["out"], F.array(emit(acc["s"], row).cast(out_type))))

    def append(acc: Column, block: Column) -> Column:
        return let(F.aggregate(block, pair(acc["s"], none), merge), lambda done: pair(done["s"], F.concat(acc["out"], done["out"])))

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(rows))).cast("int"))
    firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(rows)), width)
    blocks = F.transform(firsts, lambda first: F.slice(rows, first, width))
    return F.aggregate(blocks, pair(start, none), append, lambda acc: acc["out"])


def scan(rows: DataFrame, keys: list[str], time: str, columns: list[str], start: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """keys, time and the state before each row's step, in ``name``."""
    folded = collected(rows, keys, time, columns).select(*keys, "rows", trajectory(F.col("rows"), start, step, lambda s, _: s, "double", "double").alias("_out"))
    return folded.select(*keys, F.explode(F.arrays_zip(F.transform("rows", lambda r: r[time]).alias(time), F.col("_out").alias(name))).alias("z")).select(*keys, "z.*")


def simulate(rows: DataFrame, keys: list[str], time: str, rate: Callable[[Column, Column, Column], Column], start: float | Column, name: str) -> DataFrame:
    """Euler steps of one hour over rows with v and bs; ``rate(v, bs, state)`` is the model's derivative."""
    start = F.lit(float(start)) if isinstance(start, (int, float)) else start
    return scan(rows, keys, time, ["v", "bs"], start, lambda s, r: P.euler(s, rate(r["v"], r["bs"], s)), name)


def rollout(state: Column, v: Column, bs: Column, hours: Column, rate: Callable[[Column, Column, Column], Column]) -> Column:
    """States after 1 .. hours steps with drivers that stay as they are."""
    return F.aggregate(
        F.sequence(F.lit(1), hours),
        F.array().cast("array<double>"),
        lambda acc, k: F.concat(acc, F.array(let(F.coalesce(F.try_element_at(acc, F.lit(-1)), state), lambda s: P.euler(s, rate(v, bs, s))))),
    )


def memory(rows: DataFrame, keys: list[str], time: str, value: str, tau: float, name: str) -> DataFrame:
    """m' = rho m + (1 - rho) x with rho = exp(-1 / tau); a null row leaves the memory as it is."""
    import math

    rho = math.exp(-1 / tau)
    return scan(rows, keys, time, [value], F.lit(0.0), lambda m, r: F.when(r[value].isNull(), m).otherwise(rho * m + (1 - rho) * r[value]), name)


def alarms(rows: DataFrame, keys: list[str], time: str, rank: str, cooldown: int) -> DataFrame:
    """Rows at which an alarm fires: not within ``cooldown`` hours of the last one unless it is more severe."""
    state = "struct<t:bigint,s:int,fired:boolean>"

    def step(s: Column, r: Column) -> Column:
        quiet = (r[rank] <= 0) | ((r[time] - s["t"] <= cooldown) & (r[rank] <= s["s"]))
        return F.when(quiet, F.struct(s["t"].alias("t"), s["s"].alias("s"), F.lit(False).alias("fired"))).otherwise(F.struct(r[time].alias("t"), r[rank].alias("s"), F.lit(True).alias("fired")))

    start = F.struct(F.lit(-(1 << 40)).cast("long").alias("t"), F.lit(0).alias("s"), F.lit(False).alias("fired"))
    folded = collected(rows, keys, time, [rank]).select(*keys, trajectory(F.col("rows"), start, step, lambda s, r: let(step(s, r), lambda n: F.when(n["fired"], F.struct(n["t"].alias("t"), n["s"].alias("s")))), state, "struct<t:bigint,s:int>").alias("out"))
    return folded.select(*keys, F.explode(F.array_compact("out")).alias("a")).select(*keys, F.col("a.t").alias(time), F.col("a.s").alias(rank))


def storm_catalog(rows: DataFrame, keys: list[str], threshold: float = -50.0, before: int = 24, after: int = 144, separation: int = 48) -> DataFrame:
    """Storms of each series (h, dst_star, quality; every hour there): greedy acceptance in order of time.

    Candidates are downward crossings; their onset, minimum, recovery and window come from the
    array of the series.  A candidate is passed over if it is too near to the last accepted
    crossing or its window meets the last one; a window with less than 60 % valid hours blocks its
    span without being listed.  Returns onset_h, min_h, recovery_h, first_h, last_h, min_dst_star.
    """
    whole = collected(rows, keys, "h", ["dst_star", "quality"])
    x = lambda r, i: F.get(r, i)["dst_star"]  # noqa: E731  positions from 0

    def candidate(r: Column, i: Column) -> Column:
        n = F.size(r)
        low = F.greatest(F.lit(0), i - before)
        # the walk back stops at the first earlier hour that is not below -20
        stops = F.filter(F.when(low < i, F.sequence(low, i - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.coalesce(x(r, j) >= -20.0, F.lit(True)))
        onset = F.when(F.size(stops) > 0, F.array_max(stops) + 1).otherwise(low)
        end = F.least(n - 1, i + after)

        def from_onset(o: Column) -> Column:
            known = F.filter(F.transform(F.sequence(o, end), lambda k: F.struct(x(r, k).alias("x"), k.alias("k"))), lambda p: p["x"].isNotNull())
            least = F.array_min(known)
            back = let(least, lambda m: F.array_min(F.filter(F.sequence(m["k"], end), lambda k: F.coalesce(x(r, k) >= -20.0, F.lit(False)))))
            return F.struct(i.alias("at"), o.alias("onset"), least["k"].alias("min_at"), least["x"].alias("min_x"), F.coalesce(back, end).alias("recovery"))

        return let(onset, from_onset)

    crossings = F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: F.coalesce(x(F.col("rows"), i) < threshold, F.lit(False)) & ((i == 0) | F.coalesce(x(F.col("rows"), i - 1) >= threshold, F.lit(True))))
    found = whole.select(*keys, "rows", F.transform(crossings, lambda i: candidate(F.col("rows"), i)).alias("c"))
    shape = "array<struct<onset:int,min_at:int,min_x:double,recovery:int,first:int,last:int>>"
    start = F.struct(F.lit(-1).alias("crossing"), F.lit(-1).alias("end"), F.array().cast(shape).alias("out"))

    def accept(acc: Column, c: Column) -> Column:
        first, last = F.greatest(F.lit(0), c["onset"] - before), F.least(F.size("rows") - 1, c["recovery"] + 24)
        skip = ((acc["crossing"] >= 0) & (c["at"] < acc["crossing"] + separation)) | ((acc["end"] >= 0) & (first <= acc["end"])) | (c["at"] <= acc["end"])
        valid = F.size(F.filter(F.slice("rows", first + 1, last - first + 1), lambda r: (r["quality"] == 1) & r["dst_star"].isNotNull()))
        entry = F.struct(c["onset"].alias("onset"), c["min_at"].alias("min_at"), c["min_x"].alias("min_x"), c["recovery"].alias("recovery"), first.alias("first"), last.alias("last"))
        listed = F.when(valid / (last - first + 1) >= 0.6, F.concat(acc["out"], F.array(entry))).otherwise(acc["out"])
        taken = F.struct(c["at"].alias("crossing"), F.greatest(acc["end"], last).alias("end"), listed.cast(shape).alias("out"))
        return F.when(skip, acc).otherwise(taken)

    storms = found.select(*keys, "rows", F.explode(F.aggregate("c", start, accept, lambda a: a["out"])).alias("s"))
    hour = lambda c: F.get("rows", F.col(f"s.{c}"))["h"].alias(f"{c}_h")
    return storms.select(*keys, hour("onset"), hour("min_at").alias("min_h"), hour("recovery"), hour("first"), hour("last"), F.col("s.min_x").alias("min_dst_star"))


def sessions(rows: DataFrame, keys: list[str], time: str, gap: int, value: str) -> DataFrame:
    """Runs of rows no further apart than ``gap``: first, last, size and the greatest value."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(time)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(1))
    numbered = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("size"), F.max(value).alias("peak")).drop("_run")


def merge_spans(spans: DataFrame, keys: list[str], pad: int) -> DataFrame:
    """Padded spans that overlap, merged."""
    from pyspark.sql import Window

    padded = spans.select(*keys, (F.col("first") - pad).alias("first"), (F.col("last") + pad).alias("last"))
    w = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = padded.withColumn("_new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("merged")).drop("_run")
