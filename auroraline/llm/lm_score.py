"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from SIDE tokens to its left and SIDE to its right; the summed conditional
log-probabilities score a document.  The vocabulary is all distinct words of the corpus, whose counts
stay in a distributed table.  The network predicts the SIZE - 1 most frequent ones and one symbol for the
rest; a word of the rest is charged the symbol and its share of the rest's occurrences in all other
documents, PRIOR added to each word's, so the chances of all words sum to one and no word takes those of
another.  As a neighbour, a word of the rest has one of RARE vectors by its hash.  The network has
word vectors, one tanh layer and two softmax layers: one for the class of the token (its frequency
rank by CLASS words) and one for the token within its class.

Training goes over all documents once, in ROUNDS synchronous rounds.  A document's round and its shard
in the round follow from a hash of its id and text, and the number of shards from the number of tokens, so the model does
not depend on the partitions of the input.  In a round every shard starts from the same weights, takes AdaGrad steps over its
documents in mini-batches, and gives back its weights; their mean, weighted by the tokens seen, starts
the next round.  Means are taken by partial aggregates per weight, so what the driver gets is the
model alone, whatever the size of the corpus.

Counts of the TABLE most frequent words are broadcast (12 bytes each); those of all others are joined
to the documents that have them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import SEPARATORS_RAW

SIDE, DIM, HIDDEN = 2, 16, 32
CLASSES, CLASS = 64, 64
SIZE = CLASSES * CLASS
#: Vectors of words of the rest as neighbours; the last vector of all stands beyond a text's ends.
RARE = 512
BATCH, RATE, SEED = 8192, 0.1, 11
PRIOR = 0.5
ROUNDS, SHARD_TOKENS = 3, 4_000_000
TABLE = 1 << 20
LIMIT = 40.0


@dataclass
class Words:
    """Counts of all words (a table word, n); hashes and counts of the frequent ones, sorted by hash; the rank of each among those that the network predicts, or -1."""

    counted: DataFrame
    known: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    tokens: int
    #: Least count of the words in ``known``.
    least: int
    #: Occurrences and number of the words of the rest.
    rest: tuple[int, int]


def vocabulary(docs: DataFrame) -> Words:
    """The words of all documents; null and empty texts have none.  Ties in frequency are ordered by hash."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(0))
            for i, j in common.chunks(offsets):
                words, counts = np.unique(common.Words(data, offsets[i : j + 1], SEPARATORS_RAW).hashes(common.LOWER), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    counted = common.cut(docs.select("text").mapInArrow(stage, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # how many words have about so many occurrences: at most a thousand rows
    steps = counted.groupBy(F.floor(16 * F.log2("n")).alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    have, least = 0, 1 << 62
    for r in steps:
        have += r["words"]
        if have > TABLE:
            break
        least = r["least"]
    table = counted.where(F.col("n") >= least).toArrow()
    known, counts = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(known)
    known, counts = known[order], counts[order]
    rank = np.full(len(known), -1, np.int32)
    top = np.lexsort((known, -counts))[: SIZE - 1]
    rank[top] = np.arange(len(top))
    tokens, distinct = sum(r["tokens"] for r in steps), sum(r["words"] for r in steps)
    return Words(counted, known, counts, rank, tokens, least, (tokens - int(counts[top].sum()), distinct - len(top)))


class Network:
    """Weights of the network in one flat vector, and views of its parts."""

    SHAPES = (("vectors", (SIZE + RARE + 1, DIM)), ("w", (2 * SIDE * DIM, HIDDEN)), ("b", (HIDDEN,)), ("cw", (HIDDEN, CLASSES)), ("cb", (CLASSES,)), ("mw", (CLASSES, HIDDEN, CLASS)), ("mb", (CLASSES, CLASS)))

    def __init__(self, flat: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for _, s in self.SHAPES]
        self.flat = np.zeros(sum(sizes), np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for (name, shape), n in zip(self.SHAPES, sizes, strict=True):
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls) -> Network:
        net, rng = cls(), np.random.default_rng(SEED)
        net.vectors[:-1] = rng.normal(0, 0.3, (SIZE + RARE, DIM))
        net.w[:] = rng.normal(0, (2 * SIDE * DIM) ** -0.5, net.w.shape)
        net.cw[:] = rng.normal(0, 0.1, net.cw.shape)
        return net

    def _forward(self, near: np.ndarray, token: np.ndarray):
        """Inputs, hidden values and logits of both layers for tokens in the order of their classes, and the borders of the classes."""
        bounds = np.searchsorted(token // CLASS, np.arange(CLASSES + 1))
        x = self.vectors.take(near.reshape(-1), axis=0).reshape(len(near), -1)
        h = np.tanh(x @ self.w + self.b)
        member = np.empty((len(near), CLASS), np.float32)
        for c in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[c], bounds[c + 1])
            np.matmul(h[own], self.mw[c], out=member[own])
            member[own] += self.mb[c]
        return x, h, h @ self.cw + self.cb, member, bounds

    def log_probability(self, near: np.ndarray, token: np.ndarray) -> np.ndarray:
        order = np.argsort(token // CLASS, kind="stable")
        token = token[order]
        _, _, of_class, member, _ = self._forward(near.take(order, axis=0), token)
        out = np.empty(len(token), np.float32)
        out[order] = _log_chance(of_class, token // CLASS) + _log_chance(member, token % CLASS)
        return out

    def step(self, near: np.ndarray, token: np.ndarray, seen: Network) -> None:
        """One AdaGrad step; ``seen`` has the sums of squared gradients."""
        order = np.argsort(token // CLASS, kind="stable")
        near, token = near.take(order, axis=0), token[order]
        x, h, of_class, member, bounds = self._forward(near, token)
        d_class, d_member = _error(of_class, token // CLASS), _error(member, token % CLASS)
        d_h = d_class @ self.cw.T
        one = np.ones((len(token), 1), np.float32)
        h1 = np.concatenate([h, one], axis=1)  # the last column is for the biases
        by_class, by_member = h1.T @ d_class, np.zeros((CLASSES, HIDDEN + 1, CLASS), np.float32)
        for c in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[c], bounds[c + 1])
            d_h[own] += d_member[own] @ self.mw[c].T
            np.matmul(h1[own].T, d_member[own], out=by_member[c])
        d_h *= 1 - h * h
        grads: list[tuple[str, object, np.ndarray]] = [("cw", slice(None), by_class[:-1]), ("cb", slice(None), by_class[-1]), ("mw", slice(None), by_member[:, :-1]), ("mb", slice(None), by_member[:, -1])]
        grads += [("w", slice(None), x.T @ d_h), ("b", slice(None), (one.T @ d_h)[0])]
        flat = near.reshape(-1)
        d_x = (d_h @ self.w.T).reshape(-1, DIM)
        by_token = np.argsort(flat.astype(np.int16), kind="stable")
        first = np.flatnonzero(np.diff(flat[by_token], prepend=-1))
        touched = flat[by_token][first]
        d_v = np.add.reduceat(d_x.take(by_token, axis=0), first, axis=0)
        real = touched < SIZE + RARE  # the vector beyond a text's ends stays zero
        grads.append(("vectors", touched[real], d_v[real]))
        for name, where, grad in grads:
            squares, weights = getattr(seen, name), getattr(self, name)
            summed = squares[where] + grad * grad
            squares[where] = summed
            weights[where] -= RATE * grad / (np.sqrt(summed) + 1e-6)


def _chances(logits: np.ndarray) -> np.ndarray:
    """exp of the logits, which stay within LIMIT, in their place."""
    np.clip(logits, -LIMIT, LIMIT, out=logits)
    return np.exp(logits, out=logits)


def _log_chance(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-softmax of each row at its target; the logits are used up."""
    own = np.clip(logits[np.arange(len(target)), target], -LIMIT, LIMIT)
    return own - np.log(_chances(logits) @ np.ones(logits.shape[1], np.float32))


def _error(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gradient of the mean loss by the logits, in their place."""
    total = _chances(logits) @ np.ones(logits.shape[1], np.float32)
    logits *= (1 / (total * len(target)))[:, None]
    logits[np.arange(len(target)), target] -= np.float32(1 / len(target))
    return logits


def _find(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return np.where(known[at] == hashes, at, -1)


def _windows(words: common.Words, known: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(neighbours, token, hash) of all words; beyond a text's ends stands the symbol SIZE + RARE."""
    hashes, rows = words.hashes(common.LOWER), words.rows()
    at = _find(hashes, known)
    token = np.where(at >= 0, rank[at], SIZE - 1) if len(known) else np.full(len(hashes), SIZE - 1)
    shown = np.where(token < SIZE - 1, token, SIZE + (hashes >> np.uint64(40)).astype(np.int64) % RARE)
    near = np.full((len(token), 2 * SIDE), SIZE + RARE, np.int64)
    for k in range(1, SIDE + 1):
        same = rows[k:] == rows[:-k]
        near[k:, SIDE - k][same] = shown[:-k][same]
        near[:-k, SIDE + k - 1][same] = shown[k:][same]
    return near, token, hashes


def _predicted(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ranks of the words that the network predicts."""
    own = words.rank >= 0
    return words.known[own], words.rank[own].astype(np.int64)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array | None]]:
    """(shard, texts of CHUNK_BYTES or a little more) and, at the end of each shard, (shard, None), however rows come in batches."""
    shard, waiting, size = None, [], 0
    for batch in batches:
        shards, texts = batch.column(0).to_numpy(), batch.column(1)
        _, offsets = common.utf8(texts)
        for k in range(len(batch)):
            if shard is not None and shards[k] != shard or size >= common.CHUNK_BYTES:
                yield shard, pa.concat_arrays(waiting)
                waiting, size = [], 0
                if shards[k] != shard:
                    yield shard, None
            shard = shards[k]
            waiting.append(texts.slice(k, 1))
            size += int(offsets[k + 1] - offsets[k])
    if shard is not None:
        yield shard, pa.concat_arrays(waiting)
        yield shard, None


def train(docs: DataFrame, words: Words) -> np.ndarray:
    """Flat weights of the model after one pass over all documents; repeated rows are seen as often as they are there."""
    spark = docs.sparkSession
    known, rank = _predicted(words)
    flat = Network.start().flat.astype(np.float64)
    shards = max(1, -(-words.tokens // (ROUNDS * SHARD_TOKENS)))
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS * shards))
    for round_ in range(ROUNDS if words.tokens else 0):
        shared = spark.sparkContext.broadcast((flat.astype(np.float32), known, rank))

        def stage(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            flat, known, rank = shared.value
            net, seen, n = Network(flat.copy()), Network(), 0
            for _, texts in _by_shard(batches):
                if texts is not None:
                    data, offsets = common.utf8(texts)
                    near, token, _ = _windows(common.Words(data, offsets, SEPARATORS_RAW), known, rank)
                    shuffled = np.random.default_rng(len(token)).permutation(len(token))
                    for a in range(0, len(token), BATCH):
                        own = shuffled[a : a + BATCH]
                        net.step(near.take(own, axis=0), token[own], seen)
                    n += len(token)
                    continue
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(net.flat), dtype=np.int32)), pa.array(net.flat.astype(np.float64) * n), pa.array(np.full(len(net.flat), n, np.int64))], ["at", "v", "n"])
                net, seen, n = Network(flat.copy()), Network(), 0

        own = docs.where(slot % ROUNDS == round_).select(F.floor(slot / ROUNDS).cast("int").alias("shard"), "text", F.xxhash64("text", "doc_id").alias("h"))
        dealt = own.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h").select("shard", "text")
        sums = dealt.mapInArrow(stage, "at int, v double, n long").groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        rows = sums.toArrow()  # a row per weight of the model
        if len(rows):
            flat[rows.column("at").to_numpy()] = rows.column("v").to_numpy() / rows.column("n").to_numpy()
        shared.destroy()
    return flat


def score(docs: DataFrame, words: Words, flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood and its mean per token.

    A text without words, or null, has 0 tokens, 0 and null.  Repeated rows count as documents of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast((flat.astype(np.float32), words.known, words.rank, words.counts))
    occurrences, distinct = words.rest

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, known, rank, counts = shared.value
        own, net = rank >= 0, Network(flat)
        predicted = known[own], rank[own].astype(np.int64)
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            total, count, joined, times, n_joined = [], [], [], [], []
            for i, j in common.chunks(offsets):
                found = common.Words(data, offsets[i : j + 1], SEPARATORS_RAW)
                near, token, hashes = _windows(found, *predicted)
                parts = [net.log_probability(near[a : a + BATCH], token[a : a + BATCH]) for a in range(0, len(token), BATCH)]
                sums = np.zeros(len(token) + 1)
                np.cumsum(np.concatenate(parts) if parts else [], out=sums[1:])
                # words of the rest, once for each text
                rest = np.flatnonzero(token == SIZE - 1)
                order = rest[np.argsort(hashes[rest], kind="stable")]  # rows ascend among equal words
                rows, words_ = found.rows()[order], hashes[order]
                first = np.ones(len(rows), bool)
                first[1:] = (rows[1:] != rows[:-1]) | (words_[1:] != words_[:-1])
                begin = np.flatnonzero(first)
                k = np.diff(np.append(begin, len(rows)))
                rows, words_ = rows[begin], words_[begin]
                at = _find(words_, known)
                here = at >= 0
                share = np.bincount(rows[here], k[here] * np.log(counts[at[here]] - k[here] + PRIOR), j - i)
                n_rest = np.bincount(rows, k, j - i)
                share = share - n_rest * np.log(np.maximum(occurrences - n_rest, 0) + PRIOR * max(distinct, 1))
                far = np.flatnonzero(~here)
                far = far[np.argsort(rows[far], kind="stable")]
                total.append(sums[found.first[1:]] - sums[found.first[:-1]] + share)
                count.append(found.counts)
                joined.append(words_[far])
                times.append(k[far])
                n_joined.append(np.bincount(rows[far], minlength=j - i))
            flat_ = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (count, total, joined, times, n_joined)]
            lists = [common.list_array(v, flat_[4], pa.int64()) for v in (flat_[2].view(np.int64), flat_[3].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat_[0].astype(np.int64)), pa.array(flat_[1].astype(np.float64)), *lists], ["row", "doc_id", "n_tokens", "known", "words", "times"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    scored = common.cut(numbered.mapInArrow(stage, "row long, doc_id long, n_tokens long, known double, words array<long>, times array<long>"), "scored")
    # words with fewer occurrences than any that is broadcast, so none is a hot key; one that a document alone has needs no row of ``counted``
    fewer = words.counted.where((F.col("n") < words.least) & (F.col("n") > 1))
    in_doc = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    others = F.coalesce("n", "times") - F.col("times") + PRIOR
    charged = in_doc.join(fewer.select(F.col("word").alias("words"), "n").hint("merge"), "words", "left").groupBy("row").agg(F.sum(F.col("times") * F.log(others)).alias("share"))
    whole = scored.drop("words", "times").join(charged.hint("merge"), "row", "left").withColumn("pseudo_log_likelihood", F.col("known") + F.coalesce("share", F.lit(0.0)))
    return whole.select("doc_id", "n_tokens", "pseudo_log_likelihood", F.expr("if(n_tokens = 0, null, pseudo_log_likelihood / n_tokens)").alias("mean_log_probability"))


def fit_and_score(docs: DataFrame) -> DataFrame:
    words = vocabulary(docs)
    return score(docs, words, train(docs, words))
