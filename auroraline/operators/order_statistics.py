"""Order statistics by group; ranks come from sorted partitions, never from lists of a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with their counts and the number of rows up to them: a hot group shrinks before it is sorted."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*keys)
    return counted.withColumns({"_upto": F.sum("_m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_m").over(w)})


def kth_smallest(rows: DataFrame, keys: list[str], value: str, coverage: float) -> DataFrame:
    """n, the ceil((n + 1) * coverage)-th smallest value (the greatest if there are fewer) and the coverage it guarantees."""
    k = F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(coverage)))
    ranked = _ranked(rows, keys, value).withColumn("_k", k)
    return ranked.where("_upto >= _k").groupBy(*keys).agg(F.first("n").alias("n"), F.min(value).alias("half_width"), (F.first("_k") / (F.first("n") + 1)).alias("coverage_floor"))


def conformal(rows: DataFrame, keys: list[str], value: str, coverage: float) -> DataFrame:
    """Split-conformal half-widths by stratum, and over all rows with null keys."""
    strata = kth_smallest(rows, keys, value, coverage)
    kinds = dict(rows.dtypes)
    everything = rows.select(*[F.lit(None).cast(kinds[k]).alias(k) for k in keys], value)
    return strata.unionByName(kth_smallest(everything, keys, value, coverage))


def rank_quantile(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """The ceil(q * n)-th smallest value."""
    return _ranked(rows, keys, value).where(F.col("_upto") >= F.ceil(q * F.col("n"))).groupBy(*keys).agg(F.min(value).alias(name))


def monotone_width(cells: DataFrame, least: int) -> DataFrame:
    """bin, regime, half_width of every fitted cell; a cell of fewer than ``least`` rows takes the widest of the pooled one
    and the full ones at equal or shorter leads that are of its regime or, for a disturbed one, quiet."""
    pooled = cells.where("bin is null").select(F.col("half_width").alias("pooled"))
    fitted = cells.where("bin is not null")
    offers = fitted.where(F.col("n") >= least).select(F.col("bin").alias("o_bin"), F.col("regime").alias("o_regime"), F.col("half_width").alias("o_width"))
    # lead bins times regimes: a handful of rows on both sides
    wanted = fitted.withColumn("o_regime", F.explode(F.when(F.col("regime") == "disturbed", F.array(F.lit("disturbed"), F.lit("quiet"))).otherwise(F.array("regime"))))
    widest = wanted.join(F.broadcast(offers), "o_regime", "left").groupBy("bin", "regime", "n", "half_width").agg(F.max(F.when(F.col("o_bin") <= F.col("bin"), F.col("o_width"))).alias("offer"))
    wide = pooled.first()["pooled"]
    return widest.select("bin", "regime", F.when(F.col("n") >= least, F.col("half_width")).otherwise(F.greatest(F.lit(wide), "offer")).alias("half_width"))
