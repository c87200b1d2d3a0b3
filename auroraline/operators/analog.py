"""Nearest analogs of stated queries among all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in one broadcast block; more are searched block by block.
BLOCK = 4096


def nearest_neighbours(archive: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, exclusion: int) -> DataFrame:
    """query_id, rank, id and distance of the ``k`` nearest rows whose ids differ by ``exclusion`` or more; ties go to the smaller id.

    Queries come in blocks of a fixed size; each block is broadcast, every batch of the archive gives
    its own k best by one matrix product, and only those are shuffled and ranked.
    """
    out = None
    spark = archive.sparkSession
    ordered = queries.select(id_, vector).orderBy(id_).toLocalIterator()
    while block := [row for _, row in zip(range(BLOCK), ordered, strict=False)]:
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)))

        def stage(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                own = batch.column(0).to_numpy()
                rows = batch.column(1)
                a = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                squared = np.maximum((q * q).sum(1)[:, None] + (a * a).sum(1)[None, :] - 2 * q @ a.T, 0)
                squared[np.abs(ids[:, None] - own[None, :]) < exclusion] = np.inf
                # all within a rounding margin of the k-th, then exact distances of those and the k best by distance and id
                m = min(len(own), k)
                border = np.partition(squared, m - 1, axis=1)[:, m - 1]
                margin = 1e-9 * (1 + border + (q * q).sum(1) + (a * a).sum(1).max())
                at, row = np.nonzero((squared <= (border + margin)[:, None]) & np.isfinite(squared))
                exact = np.sqrt(((q[at] - a[row]) ** 2).sum(1))
                order = np.lexsort((own[row], np.round(exact, 9), at))
                at, row, exact = at[order], row[order], exact[order]
                keep = np.arange(len(at)) - np.searchsorted(at, at) < k
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[keep]]), pa.array(own[row[keep]]), pa.array(exact[keep])], ["query_id", "id", "distance"])

        part = archive.select(id_, vector).mapInArrow(stage, "query_id long, id long, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_), "distance")
