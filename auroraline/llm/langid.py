"""Language of words and documents by a linear-chain conditional random field.

A text is a sequence of words (runs of letters a-z after lower-casing and of bytes from 0x80 on).
Each word has hashed features: its beginnings and ends of 1 to 3 bytes, all its byte trigrams, and
the word itself as the lexicon's entry.  Weights of features and of transitions between languages
are learned together by the gradient of the log-likelihood; forward-backward gives the probability
of each language for each word, so that code-switched text is labelled word by word.

Training sequences are made of stretches of sample documents of different languages, one after
another, which is where transitions between languages come from.  A sequence has at most LENGTH
words: longer texts are cut into sequences, all of which are labelled.  A document's language is
the one with the greatest mean probability over all its words, and that mean is the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

#: Documents of each language that the field is fitted on, those with the least hash of their id, and their bytes; all languages together have TOTAL documents at most, but one each.
SAMPLE, SAMPLE_BYTES, TOTAL = 300, 4 << 20, 60_000
#: Buckets of features, and weights of all buckets and languages: with very many languages there are fewer buckets.
BUCKETS, WEIGHTS = 1 << 17, 1 << 24
LENGTH, EPOCHS, RATE, STRETCH = 256, 3, 0.5, 24

_OUT = np.ones(256, bool)
_OUT[0x61:0x7B] = False
_OUT[0x80:] = False
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document may not be learned from: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def lower_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return common.utf8(pa.array([(t or "").lower() for t in texts], pa.large_string()))


def buckets_for(langs: int) -> int:
    """Buckets of a field: a power of two, so that its weights stay within WEIGHTS however many languages there are."""
    return max(1 << 8, min(BUCKETS, 1 << (max(1, WEIGHTS // max(1, langs)).bit_length() - 1)))


def word_features(words: common.Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) pairs of all features of all words, repeats included."""
    keys = common.BYTE_KEYS[words.data]
    starts, ends = words.starts, words.ends
    size = ends - starts
    at = np.arange(len(starts))
    owner, hashes = [at], [common.span_hashes(keys, starts, ends)]
    for k in (1, 2, 3):
        long = np.flatnonzero(size >= k)
        owner += [long, long]
        hashes += [common.mix(common.span_hashes(keys, starts[long], starts[long] + k) + np.uint64(10 + k)), common.mix(common.span_hashes(keys, ends[long] - k, ends[long]) + np.uint64(20 + k))]
    n = np.maximum(size - 2, 0)
    first = common.ragged(np.arange(len(keys)), starts, n)
    owner.append(np.repeat(at, n))
    hashes.append(common.mix(common.span_hashes(keys, first, first + 3) + np.uint64(30)))
    return np.concatenate(owner), (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64)


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the sequences of texts with so many words."""
    pieces = -(-lengths // LENGTH)
    first = np.repeat(np.cumsum(lengths) - lengths, pieces) + LENGTH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    ends = np.repeat(np.cumsum(lengths), pieces)
    return first, np.minimum(LENGTH, ends - first)


@dataclass
class Field:
    """Languages, a weight for each bucket and language, transitions and starts."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, words: common.Words) -> np.ndarray:
        owner, bucket = word_features(words, len(self.weights))
        out = np.empty((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, self.weights[bucket, k], len(words))
        return out

    def forward_backward(self, emissions: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each word's languages, and the sum of those of neighbouring pairs; all sequences go side by side, scaled at each word."""
        n, k = len(first), len(self.langs)
        e = np.exp(emissions - emissions.max(1, keepdims=True)) if len(emissions) else emissions
        a = np.exp(self.moves - self.moves.max())
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        alive = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size.max()) if n else 0)]
        alpha = np.empty_like(e)
        previous = np.empty((0, k))
        for t, m in enumerate(alive):
            at = first[:m] + t
            now = e[at] if t == 0 else e[at] * (previous[:m] @ a)
            previous = now / now.sum(1, keepdims=True)
            alpha[at] = previous
        marginal = np.empty_like(e)
        pairs = np.zeros((k, k))
        behind = np.ones((n, k))
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            at = first[:m] + t
            now = alpha[at] * behind[:m]
            marginal[at] = now / now.sum(1, keepdims=True)
            if t:
                ahead = e[at] * behind[:m]
                left = alpha[at - 1]
                total = np.einsum("nk,kj,nj->n", left, a, ahead)
                pairs += a * (left.T @ (ahead / total[:, None]))
                stepped = ahead @ a.T
                behind[:m] = stepped / stepped.sum(1, keepdims=True)
        return marginal, pairs


def fit(texts: list[str], langs: list[str]) -> Field:
    """A field from texts and their languages."""
    names = sorted(set(langs))
    code = {x: i for i, x in enumerate(names)}
    data, offsets = lower_bytes(texts)
    words = common.Words(data, offsets, _OUT)
    k = len(names)
    size = buckets_for(k)
    field = Field(names, np.zeros((size, k), np.float32), np.zeros((k, k)))
    if k < 2:
        return field
    owner, bucket = word_features(words, size)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    border = np.searchsorted(owner, np.arange(len(words) + 1))
    label = np.repeat([code[x] for x in langs], words.counts)
    # stretches of all documents, dealt anew to sequences
    rng = np.random.default_rng(5)
    stretch = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
    limit = np.repeat(words.first[1:], [len(range(a, b, STRETCH)) for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
    length = np.minimum(STRETCH, limit - stretch)
    squares, move_squares = np.full((size, k), 1e-6, np.float32), np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        dealt = rng.permutation(len(stretch))
        for a in range(0, len(dealt), 512):
            own = dealt[a : a + 512]
            word = common.ragged(np.arange(len(words)), stretch[own], length[own])
            truth = label[word]
            seq, n_seq = _spread(np.array([len(word)]))
            counts = border[word + 1] - border[word]
            features = common.ragged(bucket, border[word], counts)
            place = np.repeat(np.arange(len(word)), counts)
            emissions = np.stack([np.bincount(place, field.weights[features, j], len(word)) for j in range(k)], 1)
            marginal, pairs = field.forward_backward(emissions, seq, n_seq)
            error = marginal.copy()
            error[np.arange(len(word)), truth] -= 1
            inner = np.setdiff1d(np.arange(1, len(word)), seq)
            observed = np.zeros((k, k))
            np.add.at(observed, (truth[inner - 1], truth[inner]), 1)
            touched, where = np.unique(features, return_inverse=True)
            grad = np.stack([np.bincount(where, error[place, j], len(touched)) for j in range(k)], 1) / len(word)
            squares[touched] += grad**2
            field.weights[touched] -= RATE * grad / np.sqrt(squares[touched])
            grad = (pairs - observed) / len(word)
            move_squares += grad**2
            field.moves -= RATE * grad / np.sqrt(move_squares)
    return field


def fit_field(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """The field from documents that are not held out and have a language and an id.

    Of rows with one id and language, the one with the least hash of its text counts.  Null and empty texts have nothing to learn.
    """
    allowed = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    langs = allowed.select("lang").distinct().count()
    sample = max(1, min(sample, TOTAL // max(1, langs)))
    sized = allowed.select("doc_id", "lang", F.xxhash64("text").alias("th"), F.octet_length("text").cast("long").alias("bytes"))
    order = W.Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "th")
    ranked = sized.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample)
    # at most langs * sample rows from here on
    within = F.sum("bytes").over(order.rowsBetween(W.Window.unboundedPreceding, 0)) <= SAMPLE_BYTES
    chosen = ranked.withColumn("within", within | (F.col("at") == 1)).where("within").groupBy("doc_id", "lang").agg(F.min("th").alias("th"))
    keyed = allowed.select("doc_id", "lang", F.xxhash64("text").alias("th"), "text")
    rows = keyed.join(F.broadcast(chosen), ["doc_id", "lang", "th"]).dropDuplicates(["doc_id", "lang"]).orderBy("doc_id", "lang").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def _documents(field: Field, texts: list[str | None]) -> tuple[list[str], list[float]]:
    if not field.langs:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    data, offsets = lower_bytes(texts)
    words = common.Words(data, offsets, _OUT)
    first, size = _spread(words.counts)
    marginal, _ = field.forward_backward(field.emissions(words), first, size)
    sums = np.zeros((len(words) + 1, len(field.langs)))
    np.cumsum(marginal, axis=0, out=sums[1:])
    mean = (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(words.counts, 1)[:, None]
    best = mean.argmax(1)
    ascii_letter = np.add.reduceat(np.append(~_OUT[data] & (data < 128), False), offsets[:-1] - offsets[0]) * (np.diff(offsets) > 0) if len(texts) else np.zeros(0)
    known = [bool(n and (a or has_letter(t))) for t, n, a in zip(texts, words.counts.tolist(), ascii_letter.tolist(), strict=True)]
    langs = [field.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), known, strict=True)]
    scores = [min(1.0, max(0.0, float(mean[i, b]))) if ok else 0.0 for i, (b, ok) in enumerate(zip(best.tolist(), known, strict=True))]
    return langs, scores


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its text alone; ``und`` and 0 for a text that is null or without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = common.utf8(batch.column(2))
            langs, scores = [], []
            for i, j in common.chunks(offsets):
                found = _documents(shared.value, batch.column(2).slice(i, j - i).to_pylist())
                langs += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    keyed = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return keyed.mapInArrow(stage, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(field: Field, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of the words of one text."""
    data, offsets = lower_bytes([text])
    words = common.Words(data, offsets, _OUT)
    first, size = _spread(words.counts)
    marginal, _ = field.forward_backward(field.emissions(words), first, size)
    return [(bytes(words.data[a:b]).decode(), field.langs[m.argmax()], float(m.max())) for a, b, m in zip(words.starts, words.ends, marginal, strict=True)]
