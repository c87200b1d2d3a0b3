"""Token ids in files: Simple-8b words, in ascending document order, read back with numpy.

A 64-bit word has a selector in its low 4 bits and up to 60 ids of one width in the other 60.
Ids are coded in blocks of ``BLOCK`` ids; a block never shares a word with another one, so every
block is decoded from its own offset.  An id of more than 60 bits is an *escape*: its word has
selector 0 and no value, and the value itself stands in the block's list of escapes.

A file row is a *segment*: consecutive documents of one shard with their ids.  Shards are ranges of
doc_id, so shard, segment and place in the segment give the order; ``manifest`` has the first token
of each shard.  Files are written and read by Spark's own commit protocol: a task that is run again
replaces its files whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import text_chunks
from .pieces import Cut, PieceIds, byte_symbols

#: (ids in a word, bits of each) by selector; fixed values of the format, 0 is the escape.
SELECTORS = ((1, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 1024
SEGMENT_IDS = 1 << 18
END_ID = 2

SEGMENT = "shard int, segment int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, block_words array<int>, block_escapes array<int>, words binary, escapes binary"
_WIDTHS = np.array([w for _, w in SELECTORS], np.uint64)
_COUNTS = np.array([c for c, _ in SELECTORS], np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each block, escaped values, escapes of each block); all blocks are packed side by side."""
    ids = ids.astype(np.uint64)
    blocks = -(-len(ids) // BLOCK)
    values = np.zeros((blocks, BLOCK + 60), np.uint64)
    lengths = np.minimum(BLOCK, len(ids) - BLOCK * np.arange(blocks))
    filled = np.arange(BLOCK) < lengths[:, None]
    values[:, :BLOCK][filled] = ids
    bits = np.zeros(values.shape, np.uint8)
    for shift in range(64):
        more = values >> np.uint64(shift) > 0
        if not more.any():
            break
        bits += more
    # the widest of the next 1, 2, 3 ... ids, grown step by step; the most ids that fit win
    choice = np.zeros((blocks, BLOCK), np.uint8)
    widest, seen = bits[:, :BLOCK].copy(), 1
    for selector in range(len(SELECTORS) - 1, 0, -1):
        count, width = SELECTORS[selector]
        while seen < count:
            np.maximum(widest, bits[:, seen : seen + BLOCK], out=widest)
            seen += 1
        choice[widest <= width] = selector
    at = np.zeros(blocks, np.int64)
    row = np.arange(blocks)
    starts = []
    while len(row):
        starts.append(row * (BLOCK + 60) + at)
        at = at + _COUNTS[choice[row, at]]
        go = at < lengths[row]
        row, at = row[go], at[go]
    start = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    block, place = start // (BLOCK + 60), start % (BLOCK + 60)
    selector = choice[block, place]
    flat = values.reshape(-1)
    words = selector.astype(np.uint64)
    for s in range(1, len(SELECTORS)):
        own = np.flatnonzero(selector == s)
        count, width = SELECTORS[s]
        for k in range(count if len(own) else 0):
            words[own] |= flat[start[own] + k] << np.uint64(4 + k * width)
    escaped = selector == 0
    return words, np.bincount(block, minlength=blocks), flat[start[escaped]], np.bincount(block[escaped], minlength=blocks)


def unpack(words: np.ndarray, block_words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of consecutive blocks; only the last one may be short."""
    selector = (words & np.uint64(15)).astype(np.int64)
    count = _COUNTS[selector]
    # the last word of a block may have room left, so places are counted from the block's start
    block = np.repeat(np.arange(len(block_words)), block_words)
    before = np.cumsum(count) - count
    first = np.cumsum(block_words) - block_words
    place = before - before[first][block] + block * BLOCK
    out = np.zeros(len(block_words) * BLOCK + 64, np.uint64)
    for s in range(1, len(SELECTORS)):
        own = np.flatnonzero(selector == s)
        room, width = SELECTORS[s]
        limit = (block[own] + 1) * BLOCK
        for k in range(room if len(own) else 0):
            inside = place[own] + k < limit
            out[place[own][inside] + k] = words[own][inside] >> np.uint64(4 + k * width) & np.uint64((1 << width) - 1)
    out[place[selector == 0]] = escapes
    return out[:n]


class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizer of the tokenizers library.

    The pieces of the pattern come from numpy; the library's model encodes each distinct piece once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = PieceIds(self._encode)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        symbols, tokenize = self.symbols, self.model.tokenize
        found = [[t.id for t in tokenize(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(symbols))] for p in pieces]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of each text's; a text with a special token's string goes to the library as a whole."""
        special = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        cut = Cut(["" if i in special else t for i, t in enumerate(texts)], False)
        at = self.cache.look_up(cut) if len(cut.starts) else np.zeros(0, np.int64)
        ids, counts = self.cache.ids_of(at)
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        borders = ends[cut.first]
        if not special:
            return ids, np.diff(borders)
        rows = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) if i in special else ids[borders[i] : borders[i + 1]] for i, t in enumerate(texts)]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def _segment(shard: int, number: int, first: int, doc_ids: list, counts: list, ids: list) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    words, block_words, escapes, block_escapes = pack(flat)
    row = {
        "shard": [shard], "segment": [number], "first_token": [first], "n_tokens": [len(flat)], "doc_ids": [doc_ids], "doc_tokens": [counts],
        "block_words": [block_words.tolist()], "block_escapes": [block_escapes.tolist()], "words": [words.astype("<u8").tobytes()], "escapes": [escapes.astype("<u8").tobytes()],
    }
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], list(row))


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Ids of ``docs`` (doc_id, text) in ``path``/segments and ``path``/manifest.

    Null ids come first, equal ids lie in the order of a hash of their texts; a null text has the
    end id only.  An empty table gives files without rows.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    # the tie spreads rows that share one id over several shards
    dealt = keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = byte_encoder(tokenizer), TaskContext.get().partitionId()
        number = first = size = 0
        doc_ids: list = []
        counts: list = []
        parts: list = []
        for batch in batches:
            rows = iter(batch.column(0).to_pylist())
            for texts in text_chunks(batch.column(1)):
                ids, n = own.encode(texts)
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id)
                for _ in texts:
                    doc_ids.append(next(rows))
                counts += (n + 1).tolist()
                parts.append(ids)
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield _segment(shard, number, first, doc_ids, counts, parts)
                    number, first, size, doc_ids, counts, parts = number + 1, first + size, 0, [], [], []
        if doc_ids:
            yield _segment(shard, number, first, doc_ids, counts, parts)

    dealt.mapInArrow(stage, SEGMENT).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/segments")
    spark = docs.sparkSession
    totals = spark.read.schema(SEGMENT).parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row per shard
    firsts, at = [], 0
    for r in totals:
        firsts.append((r["shard"], at, r["n"]))
        at += r["n"]
    spark.createDataFrame(firsts, "shard int, first_token long, n_tokens long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def _read(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    firsts = {r["shard"]: r["first_token"] for r in spark.read.schema("shard int, first_token long, n_tokens long").parquet(f"{path}/manifest").collect()}

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(np.frombuffer(r["words"], "<u8"), np.array(r["block_words"], np.int64), np.frombuffer(r["escapes"], "<u8"), r["n_tokens"])
                counts = np.array(r["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                yield rows(r["doc_ids"], firsts[r["shard"]] + r["first_token"] + ends - counts, counts, ends, ids)

    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    return segments.mapInArrow(stage, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ``ids`` array<long> of every document in the files."""

    def rows(doc_ids, starts, counts, ends, ids):
        flat = common.list_array(ids.astype(np.int64), counts, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), flat], ["doc_id", "start", "ids"])

    return _read(spark, path, "doc_id long, start long, ids array<long>", rows)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def rows(doc_ids, starts, counts, ends, ids):
        raw = ids.astype("<u4")
        crc = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", rows)
