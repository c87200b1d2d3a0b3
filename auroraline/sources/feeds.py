"""Scans of archive text and feed JSON.  Fill values and unreadable cells become nulls; rows without a time are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of an archive line (from 1) and fill values of its channels; fixed values of the format.
ARCHIVE_WORDS = {"year": 1, "doy": 2, "hour": 3, "by_gsm": 16, "bz": 17, "t": 23, "n": 24, "v": 25, "pdyn": 29, "dst": 41, "ae": 42, "al": 53, "au": 54}
FILLS = {"v": (9999.0, False), "bz": (999.9, True), "by_gsm": (999.9, True), "n": (999.9, False), "pdyn": (99.99, False), "t": (9999999.0, False), "dst": (99999.0, True), "ae": (9999.0, False), "al": (99999.0, True), "au": (99999.0, True)}
DST_SENTINEL = 9000.0


def unfilled(column: str, fill: float, signed: bool) -> Column:
    """Null where a value has reached its fill; the magnitude decides for signed channels."""
    x = F.col(column)
    return F.when((F.abs(x) if signed else x) < fill, x)


def parse_archive(lines: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Hourly rows from lines of blank-separated words in ``value``; the year is filtered before anything is parsed."""
    words = F.split(F.trim("value"), "\\s+")
    picked = lines.select(*[F.get(words, F.lit(k - 1)).alias(c) for c, k in ARCHIVE_WORDS.items()])
    picked = picked.where(F.col("year").try_cast("int").between(first_year, last_year))
    start = F.date_add(F.make_date(F.col("year").try_cast("int"), F.lit(1), F.lit(1)), F.col("doy").try_cast("int") - 1)
    typed = picked.withColumns({c: F.col(c).try_cast("double") for c in FILLS})
    return typed.select(start.alias("day"), F.col("hour").try_cast("int").alias("hour"), *[unfilled(c, *f).alias(c) for c, f in FILLS.items()])


def read_archive(spark: SparkSession, path: str, first_year: int, last_year: int) -> DataFrame:
    return parse_archive(spark.read.text(path), first_year, last_year)


def violations(hours: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Numbers of repeated and of missing hours between neighbours of each series."""
    from pyspark.sql import Window

    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    return hours.select(*keys, step.alias("s")).groupBy(*keys).agg(F.count_if(F.col("s") == 0).alias("n_repeated"), F.count_if(F.col("s") > 1).alias("n_gaps"), F.coalesce(F.sum(F.when(F.col("s") > 1, F.col("s") - 1)), F.lit(0)).alias("n_missing"))


def active(flag: Column) -> Column:
    """A lenient boolean: known spellings and numbers decide, all else counts as active."""
    s = F.lower(F.trim(flag))
    return F.coalesce(F.when(s.isin("true", "1", "t", "yes"), True).when(s.isin("false", "0", "f", "no"), False), s.try_cast("double") != 0, F.lit(True))


def number(text: Column, low: float, high: float | None) -> Column:
    x = text.try_cast("double")
    return F.when((x >= low) if high is None else x.between(low, high), x)


def time(text: Column) -> Column:
    """ISO time with a T or a blank, with or without a fraction, which is dropped; else null."""
    base = F.substring_index(text, ".", 1)
    return F.coalesce(F.try_to_timestamp(base, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(base, F.lit("yyyy-MM-dd HH:mm:ss")))


def parse_plasma(rows: DataFrame, column: str = "value", densest: float | None = 500, timed: bool = True) -> DataFrame:
    """time_tag, v, n, t of active rows from JSON objects; readings out of range are null.

    ``densest``: the largest density in range, None for no limit.  ``timed``: leave out rows without a time.
    """
    j = F.from_json(column, "time_tag string, active string, proton_speed string, proton_density string, proton_temperature string")
    p = rows.select(j.alias("j")).where(F.col("j").isNotNull() & active(F.col("j.active")))
    parsed = p.select(time(F.col("j.time_tag")).alias("time_tag"), number(F.col("j.proton_speed"), 100, 3000).alias("v"), number(F.col("j.proton_density"), 0, densest).alias("n"), number(F.col("j.proton_temperature"), 0, 1e8).alias("t"))
    return parsed.where("time_tag is not null") if timed else parsed


def parse_mag(rows: DataFrame, column: str = "value") -> DataFrame:
    """time_tag, bx_gsm, by_gsm, bz and bt of active rows from JSON objects.

    A row needs a time and a southward component in range; other components out of range are null.
    """
    j = F.from_json(column, "time_tag string, active string, bx_gsm string, by_gsm string, bz_gsm string, bt string")
    m = rows.select(j.alias("j")).where(F.col("j").isNotNull() & active(F.col("j.active")))
    component = lambda name, low=-1e3: number(F.col(f"j.{name}"), low, 1e3)
    parsed = m.select(time(F.col("j.time_tag")).alias("time_tag"), component("bx_gsm").alias("bx_gsm"), component("by_gsm").alias("by_gsm"), component("bz_gsm").alias("bz"), component("bt", 0).alias("bt"))
    return parsed.where("time_tag is not null and bz is not null")


def parse_dst(rows: DataFrame, column: str = "value") -> DataFrame:
    """time_tag and dst from objects {time_tag, dst} or arrays [time, dst]; headers, sentinels and unreadable rows are left out."""
    array = F.from_json(F.when(F.col(column).startswith("["), F.col(column)), "array<string>")
    obj = F.from_json(F.when(F.col(column).startswith("{"), F.col(column)), "time_tag string, dst string")
    picked = rows.select(F.coalesce(F.get(array, F.lit(0)), obj["time_tag"]).alias("a"), F.coalesce(F.get(array, F.lit(1)), obj["dst"]).alias("b"))
    parsed = picked.select(time(F.col("a")).alias("time_tag"), F.col("b").try_cast("double").alias("dst"))
    return parsed.where((F.abs("dst") <= DST_SENTINEL) & F.col("time_tag").isNotNull())


def parse_bulletin(rows: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """Long rows (bin, day, kp) of a three-day table: a line for each three-hour bin, a column for each day; negative fills are left out."""
    lines = rows.select(*keys, F.explode(F.split(column, "\n")).alias("line"))
    bins = lines.select(*keys, F.regexp_extract("line", r"^(\d\d)-(\d\d)UT", 1).alias("start"), F.regexp_extract_all("line", F.lit(r"(-?\d+\.\d+)(?:\s*\(G\d\))?"), F.lit(1)).alias("kp")).where("start <> ''")
    return bins.select(*keys, F.col("start").cast("int").alias("bin"), F.posexplode("kp").alias("day", "kp")).withColumn("kp", F.col("kp").cast("double")).where("kp >= 0")


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries of the manifest that are missing or whose digest differs."""
    return manifest.join(files, ["name", "sha256"], "left_anti")
