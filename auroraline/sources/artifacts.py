"""Model artifacts as CSV folders that carry their kind and version in every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_artifact(rows: DataFrame, path: str, kind: str, version: int) -> None:
    rows.select(F.lit(kind).alias("kind"), F.lit(version).alias("version"), *rows.columns).write.option("header", True).csv(path)


def read_artifact(spark: SparkSession, path: str, kind: str, version: int, schema: str) -> DataFrame:
    """The rows of an artifact; one of another kind or version raises when it is read, and so does a header that is not the schema's."""
    rows = spark.read.schema(f"kind string, version int, {schema}").option("header", True).option("enforceSchema", False).csv(path)
    same = (F.col("kind") == kind) & (F.col("version") == version)
    refused = F.raise_error(F.concat(F.lit(f"not {kind} {version}: "), F.col("kind"), F.lit(" "), F.col("version").cast("string")))
    # the check is part of a column that is read, so that it can't be pruned
    first, *rest = [c for c in rows.columns if c not in ("kind", "version")]
    return rows.select(F.when(same, F.col(first)).otherwise(refused.cast(rows.schema[first].dataType)).alias(first), *rest)
