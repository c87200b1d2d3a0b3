"""Scans of text archives and observatory JSON: a model's index, the planetary three-hour table, one-minute winds, magnetometers.

Lines that do not have the format are left out, fill values become nulls, and each line is parsed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import feeds

# Words of a minute line (from 1), fill values and whether the magnitude decides; fixed values of the format.
MINUTE_SHIFT = (10, 999999.0, False)
MINUTE_WORDS = {"by_gsm": (18, 9999.0, True), "bz": (19, 9999.0, True), "v": (22, 99999.0, False), "n": (26, 999.0, False), "pdyn": (28, 99.0, False)}
# First words of the eight values of a day in the three-hour table; fixed values of the format.
KP_WORD, AP_WORD, DEFINITIVE_WORD = 8, 16, 28


def _day(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy - 1)


def _at(day: Column, hour: Column, minute: Column, second: Column | None = None) -> Column:
    return F.make_timestamp(F.year(day), F.month(day), F.day(day), hour, minute, F.lit(0) if second is None else second)


def parse_model_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """valid_at and dst from lines ``YYYY/DDD-HH:MM:SS value``; a day of zero or an hour out of range leaves the line out."""
    form = r"^\s*(\d{4})/(\d{3})-(\d{2}):(\d{2}):(\d{2})\s+(-?\d+(?:\.\d+)?)\s*$"
    part = lambda k: F.regexp_extract(column, form, k).try_cast("int")
    read = lines.select(*[part(k).alias(c) for k, c in enumerate(("y", "d", "h", "m", "s"), 1)], F.regexp_extract(column, form, 6).try_cast("double").alias("dst"))
    read = read.where("dst is not null and y >= 1 and d between 1 and 366 and h < 24 and m < 60 and s < 60")
    return read.select(_at(_day(F.col("y"), F.col("d")), F.col("h"), F.col("m"), F.col("s")).alias("valid_at"), "dst")


def parse_kp_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """valid_at, kp, ap, definitive from a line a day with eight values of each; comments, short lines and negative fills are left out."""
    words = F.split(F.trim(column), "\\s+")
    rows = lines.where(~F.col(column).startswith("#")).select(words.alias("w")).where(F.size("w") >= DEFINITIVE_WORD)
    word = lambda k: F.col("w")[k - 1]
    cells = F.array(*[F.struct(F.lit(3 * i).alias("hour"), word(KP_WORD + i).try_cast("double").alias("kp"), word(AP_WORD + i).try_cast("int").alias("ap")) for i in range(8)])
    ymd = [word(k).try_cast("int").alias(c) for k, c in ((1, "y"), (2, "m"), (3, "d"), (DEFINITIVE_WORD, "definitive"))]
    long = rows.select(*ymd, F.explode(cells).alias("c")).where("c.kp >= 0")
    return long.select(F.try_make_timestamp("y", "m", "d", "c.hour", F.lit(0), F.lit(0)).alias("valid_at"), "c.kp", "c.ap", "definitive").where("valid_at is not null")


def parse_minutes(lines: DataFrame, column: str = "value") -> DataFrame:
    """One-minute rows: arrives_at is the line's own time, measured_at lies the stated shift before it (the same where the shift is a fill)."""
    words = F.split(F.trim(column), "\\s+")
    rows = lines.select(words.alias("w")).where(F.size("w") >= 28)
    number = lambda k: F.col("w")[k - 1].try_cast("double")
    picked = rows.select(*[F.col("w")[k].try_cast("int").alias(c) for k, c in enumerate(("y", "d", "h", "m"))], number(MINUTE_SHIFT[0]).alias("shift"), *[number(k).alias(c) for c, (k, _, _) in MINUTE_WORDS.items()])
    picked = picked.where("y >= 1 and d between 1 and 366 and h between 0 and 23 and m between 0 and 59")
    typed = picked.withColumns({c: feeds.unfilled(c, fill, signed) for c, (_, fill, signed) in MINUTE_WORDS.items()})
    shift = F.coalesce(feeds.unfilled("shift", *MINUTE_SHIFT[1:]), F.lit(0.0))
    at = _at(_day(F.col("y"), F.col("d")), F.col("h"), F.col("m"))
    return typed.select(at.alias("arrives_at"), F.timestamp_seconds(F.unix_timestamp(at) - F.round(shift).cast("long")).alias("measured_at"), *MINUTE_WORDS)


def parse_observatory(documents: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """keys, at, x, y of each sample of a document with ``times`` and one list of values an element.

    A document without both components, or with lists of unequal length, gives no row; a missing value is null.
    """
    j = F.from_json(column, "times array<string>, values array<struct<metadata: struct<element: string>, values: array<double>>>")
    read = documents.select(*keys, j.alias("j")).where("j.times is not null")
    of = lambda e: F.get(F.filter("j.values", lambda v: v["metadata"]["element"] == e), F.lit(0))["values"]
    lists = read.select(*keys, F.col("j.times").alias("at"), of("X").alias("x"), of("Y").alias("y")).where("size(at) = size(x) and size(at) = size(y)")
    long = lists.select(*keys, F.explode(F.arrays_zip("at", "x", "y")).alias("z")).select(*keys, feeds.time(F.regexp_replace("z.at", "Z$", "")).alias("at"), "z.x", "z.y")
    return long.where("at is not null")


def field_rates(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at and the horizontal rate a minute against the sample before, where both samples are whole."""
    w = Window.partitionBy(*keys).orderBy("at")
    before = lambda c: F.lag(c).over(w)
    minutes = (F.unix_timestamp("at") - F.unix_timestamp(before("at"))) / 60.0
    moved = F.sqrt(F.pow(F.col("x") - before("x"), F.lit(2)) + F.pow(F.col("y") - before("y"), F.lit(2)))
    return samples.select(*keys, "at", F.when(minutes > 0, moved / minutes).alias("rate")).where("rate is not null")
