"""BPE encoding and decoding with a pair occurrence index.

Texts are normalised (NFC, lower case) and cut into pieces; the distinct pieces of a batch that
are not known yet lie one after another in a list of symbols.  An index maps every pair that has a
rank to all its positions in that list.  Active ranks are taken in ascending order from a heap;
applying one merges all positions of its pair from left to right and updates the lists of the pairs
that arise beside them.  Ids of pieces are kept in a cache of the worker, so frequent ones are
merged once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .pieces import Cut, PieceIds, byte_symbols, load_vocabulary

#: Code points of text that are cut into pieces at once.
CHUNK_POINTS = 1 << 20


class PairMerger:
    """Merges of a vocabulary over byte symbols; the last symbol of a piece carries the end suffix."""

    def __init__(self, vocabulary: dict):
        model = vocabulary["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.suffix] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces and the number for each."""
        symbols: list[int] = []
        before: list[int] = []  # position of the symbol to the left in the same piece, or -1
        after: list[int] = []
        borders = [0]
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            a, n = len(symbols), len(raw)
            symbols.extend([self.inner[x] for x in raw[:-1]])
            symbols.append(self.final[raw[-1]])
            before.append(-1)
            before.extend(range(a, a + n - 1))
            after.extend(range(a + 1, a + n))
            after.append(-1)
            borders.append(a + n)
        merges = self.merges
        index: dict[int, list[int]] = {}  # rank -> positions of the left symbol of its pair
        pair_of: dict[int, tuple[int, int, int]] = {}  # rank -> the pair and what it becomes
        for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)):
            if after[i] >= 0 and (m := merges.get((a, b))):
                if m[0] in index:
                    index[m[0]].append(i)
                else:
                    index[m[0]] = [i]
                    pair_of[m[0]] = (a, b, m[1])
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            positions = index.pop(rank)
            positions.sort()
            a, b, c = pair_of[rank]
            for i in positions:
                j = after[i]
                if symbols[i] != a or j < 0 or symbols[j] != b:
                    continue  # an earlier merge took one of the two
                symbols[i], symbols[j] = c, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if m := merges.get((c, symbols[k])):
                        if m[0] in index:
                            index[m[0]].append(i)
                        else:
                            index[m[0]] = [i]
                            pair_of[m[0]] = (c, symbols[k], m[1])
                            heapq.heappush(active, m[0])
                h = before[i]
                if h >= 0 and (m := merges.get((symbols[h], c))):
                    if m[0] in index:
                        index[m[0]].append(h)
                    else:
                        index[m[0]] = [h]
                        pair_of[m[0]] = (symbols[h], c, m[1])
                        heapq.heappush(active, m[0])
        merged = np.array(symbols, np.int32)
        alive = np.zeros(len(merged) + 1, np.int64)
        np.cumsum(merged >= 0, out=alive[1:])
        ends = np.array(borders)
        return merged[merged >= 0], alive[ends[1:]] - alive[ends[:-1]]


def normalise(text: str) -> str:
    """NFC, then lower case of each code point by itself (a final sigma is not told apart)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Encoder:
    """Ids and decoded text of whole texts; special tokens in a text are taken as such, as the public library does by default."""

    def __init__(self, path: str):
        vocabulary = load_vocabulary(path)
        self.merger = PairMerger(vocabulary)
        self.special = {t["content"]: t["id"] for t in vocabulary.get("added_tokens", [])}
        self.tokens = self.merger.tokens | {i: t for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache = PieceIds(self._encode)
        self.decoded: list[str] = []

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.merger.encode(pieces)
        if not self.cache.n:
            self.decoded.clear()
        tokens, at = self.tokens, 0
        for n in counts.tolist():
            self.decoded.append(" ".join([tokens[x] for x in ids[at : at + n].tolist()]))
            at += n
        return ids, counts

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """(ids, decoded text) of each text.  An empty text has no ids and decodes to the empty text."""
        plain = [t if not self.split or "<" not in t or not self.split.search(t) else None for t in texts]
        cut = Cut([normalise(t or "") for t in plain], True)
        at = self.cache.look_up(cut) if len(cut.starts) else np.zeros(0, np.int64)
        ids, counts = self.cache.ids_of(at)
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        words = [self.decoded[i] for i in at.tolist()]
        for row, text in enumerate(plain):
            a, b = cut.first[row], cut.first[row + 1]
            if text is not None:
                yield ids[ends[a] : ends[b]], " ".join(words[a:b])
                continue
            parts = [p for p in self.split.split(texts[row]) if p]
            some = [(np.array([self.special[p]], np.int32), p) if p in self.special else next(self.encode([p])) for p in parts]
            yield np.concatenate([i for i, _ in some]), " ".join(d for i, d in some if len(i))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_chunks(column: pa.Array) -> Iterator[list[str]]:
    """Texts of a column in lists of about CHUNK_POINTS bytes; nulls are empty."""
    _, offsets = common.utf8(column)
    for i, j in common.chunks(offsets, CHUNK_POINTS):
        yield [t or "" for t in column.slice(i, j - i).to_pylist()]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``decoded`` string; a null text is taken as empty.

    Other columns pass through, whatever their names; ones named like the two new ones are replaced.
    Repeated rows get equal results.
    """
    docs = docs.drop("ids", "decoded")
    rows = docs.select(common.whole(docs).alias("row"), "text")
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids, decoded = [], []
            for texts in text_chunks(batch.column(1)):
                for i, d in own.encode(texts):
                    ids.append(i)
                    decoded.append(d)
            flat = common.list_array(np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array([len(i) for i in ids], np.int64), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array(decoded, pa.string())], ["row", "ids", "decoded"])

    return rows.mapInArrow(stage, schema).select("row.*", "ids", "decoded")


def decode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``decoded`` for their ``ids``: the tokens joined by one space, special ones included; null ids decode to null."""
    docs = docs.drop("decoded")
    rows = docs.select(common.whole(docs).alias("row"), "ids")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path).tokens
        for batch in batches:
            texts = [None if r is None else " ".join([tokens[i] for i in r]) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "decoded"])

    return rows.mapInArrow(stage, T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())])).select("row.*", "decoded")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each document, by the same encoder without sending ids to the JVM."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n, ids_hash, decoded_hash = [], [], []
            for texts in text_chunks(batch.column(1)):
                for ids, decoded in own.encode(texts):
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    decoded_hash.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(stage, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
