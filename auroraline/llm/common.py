"""What the corpus operators share: scratch tables, Arrow text buffers and word hashes.

Texts are handled as UTF-8 bytes.  The word rules of the operators only tell ASCII bytes
apart, so a word never ends inside a multi-byte character and bytes can be cut without decoding.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are handled at once in a Python worker; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

#: Separators of the whitespace word rule ``[^\x20\x09-\x0D]+``.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


#: Rows that Spark hands to a Python worker at once; Spark's own 10,000 texts would fill hundreds of MB there and in the JVM.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; a session that has larger Arrow batches gets BATCH_ROWS."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, as in tests, a folder under the warehouse is used.  The path is
    deleted when the driver's file system closes.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    path = f"{base.rstrip('/')}/auroraline-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


_cuts: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _cuts[written] = path
    return written


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``cut`` wrote and nothing will read again."""
    for table_ in tables:
        if path := _cuts.pop(table_, None):
            context = table_.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def whole(docs: DataFrame) -> Column:
    """All columns of a row in one struct, where no name of an operator's own can clash with them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def doc_rank(column: str = "doc_id"):
    """A null id counts as the largest one: such a row never precedes another."""
    return F.coalesce(F.col(column).cast("long"), F.lit(2**63 - 1))


# ---------------------------------------------------------------- Arrow text


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows, each of about ``size`` bytes and of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of some rows of text: byte spans, and ``first[i]:first[i + 1]`` are those of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        base = int(offsets[0])
        self.offsets = offsets - base
        self.data = data[base : int(offsets[-1])]
        inside = ~separators[self.data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            filled = self.offsets[:-1][np.diff(self.offsets) > 0]
            before[filled] = False
            after[filled[1:] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words; ``fold`` maps bytes first (256 values)."""
        return span_hashes((BYTE_KEYS if fold is None else BYTE_KEYS[fold])[self.data], self.starts, self.ends)


# ---------------------------------------------------------------- hashes

_BASE, _WINDOW = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
BYTE_KEYS = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: The lower-case form of A-Z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ``base`` and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up = np.full(n, base, dtype=np.uint64)
        down = np.full(n, pow(base, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if n > 1 << 22:
            del _powers[base]
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hashes of ``keys[s:e]`` (64-bit values) by prefix sums, so the cost does not depend on the lengths of the spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(keys) + 1)
    total = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(keys * up[: len(keys)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes; windows across rows are for the caller to drop."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hashes(words, at, at + k, _WINDOW)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[s:s + n]`` for each start and length, one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    at = np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
    return values[at]


def union_length(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """A mask of n positions that tells those covered by ``start .. start + width``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
