"""Benchmark decontamination: a broadcast hash set of item windows, scanned over token windows.

Words are lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  An item's windows are
its runs of ``width`` words, or all its words where it has fewer.  The documents' windows are
hashed with numpy and looked up in a sorted array of the items' hashes; every hit is then verified
by a 128-bit digest of the words themselves, so a false hash match changes nothing.

The pairs (window, item) are dealt to blocks of about ``block_windows`` by their hash, so neither a long
item nor a window that many items have makes a block larger, and a pair takes 33 bytes whatever its
words are.  One block is the rule, and then the documents pass through one stage without a shuffle.
With more, the blocks follow each other: each is broadcast, its hits are written out and the broadcast is
destroyed before the next one is built; the hits are joined to the documents at the end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 10
#: Pairs of window and item in one broadcast, 33 bytes each.
BLOCK_WINDOWS = 1_000_000

_ASCII = np.zeros(256, dtype=bool)
_ASCII[:128] = True
_ASCII[0x30:0x3A] = False
_ASCII[0x61:0x7B] = False
#: Separators, told apart after lower-casing.
SEPARATORS = _ASCII
SEPARATORS_RAW = SEPARATORS[common.LOWER]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {i: i + 32 for i in range(65, 91)}
#: Lower-cases A-Z and turns separators to spaces.
_TO_SPACE = bytes(np.where(SEPARATORS_RAW, 0x20, common.LOWER).astype(np.uint8))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _byte_words(raw: bytes) -> list[bytes]:
    return raw.translate(_TO_SPACE).split()


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """size, hash, digest, item_id of the distinct windows of all items; null texts have none."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            data, offsets = common.utf8(column)
            for i, j in common.chunks(offsets):
                words = common.Words(data, offsets[i : j + 1], SEPARATORS_RAW)
                hashes = words.hashes(common.LOWER)
                sizes, found, digests, owner = [], [], [], []
                for row in range(j - i):
                    n = int(words.counts[row])
                    size = min(width, n)
                    if not size:
                        continue
                    a = words.first[row]
                    own = _byte_words(bytes(words.data[words.offsets[row] : words.offsets[row + 1]]))
                    found.append(common.window_hashes(hashes[a : a + n], size))
                    digests += [_digest(own[k : k + size]) for k in range(n - size + 1)]
                    sizes += [size] * (n - size + 1)
                    owner += [i + row] * (n - size + 1)
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64)), pa.array(digests, pa.binary()), ids.take(pa.array(owner, pa.int64()))], ["size", "hash", "digest", "item_id"])

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(stage, "size int, hash long, digest binary, item_id long").distinct()


class Block:
    """Pairs of window and item: for each window length the sorted hashes, the digests and the items."""

    def __init__(self, rows: pa.Table):
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        size, hashes = rows.column("size").to_numpy(), rows.column("hash").to_numpy().view(np.uint64)
        digests = np.array(rows.column("digest").to_pylist(), dtype="S16") if len(rows) else np.zeros(0, "S16")
        known = rows.column("item_id").is_valid().to_numpy()
        items = rows.column("item_id").fill_null(0).to_numpy()
        for k in np.unique(size):
            own = np.flatnonzero(size == k)
            own = own[np.argsort(hashes[own], kind="stable")]
            self.parts[int(k)] = hashes[own], digests[own], items[own], known[own]


def item_blocks(benchmark: DataFrame, width: int, block_windows: int) -> tuple[int, Iterator[Block]]:
    """The number of blocks, and the blocks one by one."""
    windows = common.cut(item_windows(benchmark, width), "windows")
    blocks = max(1, -(-windows.count() // block_windows))

    def each() -> Iterator[Block]:
        for b in range(blocks):
            yield Block(windows.where(F.pmod(F.xxhash64("digest", "item_id"), F.lit(blocks)) == b).toArrow())
        common.release(windows)

    return blocks, each()


def scan(words: common.Words, block: Block) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, position, window length, item ids) of verified hits."""
    hashes, rows = words.hashes(common.LOWER), words.rows()
    split: dict[int, list[bytes]] = {}
    for size, (wanted, digests, items, known) in block.parts.items():
        windows = common.window_hashes(hashes, size)
        first = np.searchsorted(wanted, windows)
        found = np.flatnonzero(wanted[np.minimum(first, len(wanted) - 1)] == windows)
        found = found[rows[found] == rows[found + size - 1]]
        last = np.searchsorted(wanted, windows[found], "right")
        for i, a, b in zip(found.tolist(), first[found].tolist(), last.tolist(), strict=True):
            row = int(rows[i])
            if row not in split:
                split = {row: _byte_words(bytes(words.data[words.offsets[row] : words.offsets[row + 1]]))}
            at = i - int(words.first[row])
            same = a + np.flatnonzero(digests[a:b] == np.bytes_(_digest(split[row][at : at + size])))
            if len(same):
                yield row, at, size, items[same[known[same]]]


def _hits(texts: pa.Array, block: Block) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Number of words, positions hit and items of each text."""
    data, offsets = common.utf8(texts)
    counts, hit, items = [], [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
    for i, j in common.chunks(offsets):
        words = common.Words(data, offsets[i : j + 1], SEPARATORS_RAW)
        counts.append(words.counts)
        for row, at, size, ids in scan(words, block):
            hit[i + row].append(np.arange(at, at + size))
            items[i + row].append(ids)
    none = np.zeros(0, np.int64)
    join = lambda parts: [np.unique(np.concatenate(p)) if p else none for p in parts]
    return np.concatenate(counts) if counts else none, join(hit), join(items)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return common.list_array(np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array([len(p) for p in parts], np.int64), kind)


def _marked(rows: DataFrame, benchmark: DataFrame, width: int, block_windows: int) -> DataFrame:
    """``rows`` (row, text) with ``n_words``, ``hit_words`` and ``items`` in place of the text."""
    spark = rows.sparkSession
    blocks, each = item_blocks(benchmark, width, block_windows)
    kept = rows.select("row").schema
    extra = [pa.field("n_words", pa.int64()), pa.field("hit_words", pa.list_(pa.int32())), pa.field("items", pa.list_(pa.int64()))]
    out = rows.select("row", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<long>").alias("items")).schema
    if blocks == 1:
        shared = spark.sparkContext.broadcast(next(each))
        next(each, None)

        def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, hit, items = _hits(batch.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), _lists(hit, pa.int32()), _lists(items, pa.int64())], [kept.names[0], *[f.name for f in extra]])

        return rows.mapInArrow(stage, out)

    keyed = rows.select(F.xxhash64("text").alias("th"), F.length("text").alias("size"), "text")
    found = None
    for block in each:
        shared = spark.sparkContext.broadcast(block)

        def one(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, hit, items = _hits(batch.column(2), shared.value)
                own = np.flatnonzero([len(h) > 0 for h in hit])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), _lists([hit[k] for k in own], pa.int32()), _lists([items[k] for k in own], pa.int64())], ["th", "size", "hit_words", "items"])

        part = common.cut(keyed.mapInArrow(one, "th long, size int, hit_words array<int>, items array<long>"), "hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("th", "size").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit_words", "items")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            counts = [common.Words(data, offsets[i : j + 1], SEPARATORS_RAW).counts for i, j in common.chunks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64()), *batch.columns[2:]], [kept.names[0], *[f.name for f in extra]])

    both = rows.withColumns({"th": F.xxhash64("text"), "size": F.length("text")}).join(merged, ["th", "size"], "left")
    none = [F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"), F.coalesce("items", F.array().cast("array<long>")).alias("items")]
    return both.select("row", "text", *none).mapInArrow(count, out)


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words`` long, ``hit_words`` array<int> (positions, ascending) and ``items`` array<long> (ids with a hit).

    A null or empty text has no words; an item without words hits nothing; an item with a null id hits but
    is not listed; equal items are all listed; repeated rows get equal results.  Other columns pass
    through; ones named like the three new ones are replaced.
    """
    docs = docs.drop("n_words", "hit_words", "items")
    marked = _marked(docs.select(common.whole(docs).alias("row"), "text"), benchmark, width, block_windows)
    return marked.select("row.*", "n_words", "hit_words", "items")


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without those that hold a window of an item; columns of any name, and their values, as before."""
    marked = _marked(docs.select(common.whole(docs).alias("row"), "text"), benchmark, width, block_windows)
    return marked.where(F.size("hit_words") == 0).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with the hit words taken out of ``text``; whitespace, all else and all other columns stay."""
    at = docs.columns.index("text")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, texts = batch.column(0).flatten(), []
            for text, hits in zip(fields[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hits:
                    spans = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
                    gone, parts, end = set(hits), [], 0
                    for k, (a, b) in enumerate(spans):
                        if k in gone:
                            parts.append(text[end:a])
                            end = b
                    text = "".join([*parts, text[end:]])
                texts.append(text)
            fields[at] = pa.array(texts, fields[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(batch.schema.field(0).type))], ["row"])

    marked = _marked(docs.select(common.whole(docs).alias("row"), "text"), benchmark, width, block_windows).select("row", "hit_words")
    return marked.mapInArrow(stage, marked.select("row").schema).select("row.*")


def digest(marked: DataFrame) -> DataFrame:
    """The digest columns of marked documents: n_hit, n_items, items_sha256, contaminated."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return marked.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )
