"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A ledger is a folder with one table per committed batch: sums of signed document, token and
character counts by group.  Totals are the sums over the ledger, so a batch only adds rows and
never rewrites any.  A batch has an id; its folder is named by it and committed whole by Spark's
writer, so committing it again, after a failure or by mistake, changes nothing.

* an insert adds the counts of a document, a delete takes off those that the insert added;
* a revision takes off the old counts and adds the new ones, in one batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer")
MEASURES = ("n_docs", "n_tokens", "n_chars")

#: Tokenizer versions that need no vocabulary: name -> number of tokens of ``text``.
TOKENIZERS: dict[str, str] = {
    "whitespace/1": "size(array_remove(split(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), ''))",
    "wordpunct/1": "regexp_count(coalesce(text, ''), '[A-Za-z0-9_\\\\x80-\\\\x{10FFFF}]+|[!-/:-@\\\\[-^`{-~]')",
}


def counted(docs: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang and, for each tokenizer version, its number of tokens of every document: one pass over the texts.

    A null text has no tokens and no characters; null sources and languages are groups of their own.
    """
    tokenizers = tokenizers or TOKENIZERS
    counts = [F.expr(sql).cast("long").alias(name) for name, sql in tokenizers.items()]
    return docs.select("doc_id", "source", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), *counts)


def counted_by_file(docs: DataFrame, name: str, path: str) -> DataFrame:
    """As ``counted``, for the version ``name`` of a byte-level BPE vocabulary file."""
    from .bpe import text_chunks
    from .tokenstore import byte_encoder

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_encoder(path)
        for batch in batches:
            n = [own.encode(texts)[1] for texts in text_chunks(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.concatenate(n) if n else np.zeros(0), pa.int64())], ["doc_id", "source", "lang", "n_chars", name])

    rows = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "text")
    return rows.mapInArrow(stage, f"doc_id long, source string, lang string, n_chars long, `{name}` long")


def revisions(old: DataFrame, new: DataFrame, tokenizers: list[str]) -> DataFrame:
    """One batch of signed sums that takes off the old counts of some documents and adds the new ones."""
    return deltas(old.withColumn("_s", F.lit(-1)).unionByName(new.withColumn("_s", F.lit(1))), tokenizers, F.col("_s"))


def deltas(counts: DataFrame, tokenizers: list[str], sign: int | Column = 1) -> DataFrame:
    """Signed sums of counted documents by group; partial sums before the shuffle, so a hot source costs a row a task."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    versions = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(f"`{t}`").alias("tokens")) for t in tokenizers]))
    long = counts.select("source", "lang", "n_chars", sign.cast("long").alias("s"), versions.alias("v"))
    sums = [F.sum("s").alias("n_docs"), F.sum(F.col("s") * F.col("v.tokens")).alias("n_tokens"), F.sum(F.col("s") * F.col("n_chars")).alias("n_chars")]
    return long.groupBy("source", "lang", F.col("v.tokenizer").alias("tokenizer")).agg(*sums)


class Ledger:
    """Committed batches under ``path``; readers see whole batches only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        if not batch or any(c in batch for c in "/= "):
            raise ValueError(f"a batch id is a plain name, not {batch!r}")
        return f"{self.path}/batch={batch}"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._fs_path(f"{self._folder(batch)}/_SUCCESS"))

    def batches(self) -> list[str]:
        if not self._fs.exists(self._fs_path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._fs_path(self.path))]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and self.committed(n.removeprefix("batch=")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the deltas of a batch; False, and nothing done, where the batch is already there.

        Each attempt writes a table of its own and renames it; a rename never replaces a folder, so of two
        writers one wins and the other gets False.  What a failed attempt left is not read and does not disturb.
        """
        if self.committed(batch):
            return False
        target, staged = self._fs_path(self._folder(batch)), self._fs_path(f"{self.path}/_staged-{batch}-{uuid.uuid4().hex}")
        changes.select(*GROUP, *MEASURES).write.parquet(staged.toString())
        if self._fs.exists(target) and not self.committed(batch):
            self._fs.delete(target, True)
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs
        no_options = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(staged.toUri() if staged.isUriPathAbsolute() and staged.toUri().getScheme() else self._fs.getUri(), context._jsc.hadoopConfiguration()).rename(staged, target, no_options)
        except Py4JJavaError:
            self._fs.delete(staged, True)
            if self.committed(batch):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """Sums over all batches; groups whose counts have all been taken off are left out."""
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
        folders = [self._folder(b) for b in self.batches()]
        log = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        summed = log.groupBy(*GROUP).agg(*[F.sum(m).alias(m) for m in MEASURES])
        return summed.where(" or ".join(f"{m} <> 0" for m in MEASURES))
