"""Toxicity by a chain of linear models.

The chain goes through the categories in order.  Model k is logistic regression on the words of a
document and on the logits of categories 1 .. k-1.  While fitting, those earlier logits are
out-of-fold predictions, so a later model sees them as good as they will be on new documents and
not as good as they are on documents the earlier model has learned.

Words are lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  Features are words and
beginnings of words that MIN_DOCS or more sample documents have, present or not.  Fitting takes at most ``sample`` labelled
documents of SAMPLE_BYTES together, those with the least hash of their id; documents are scored whole.

The labels have two flags, and the categories of CATEGORIES are made of them: text of low quality, toxic text,
and text that is toxic though it is well written, which needs the other two.
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

#: Bound of the documents that the models are fitted on.
SAMPLE, SAMPLE_BYTES = 6000, 64 << 20
MIN_DOCS, FOLDS = 5, 5
#: Categories in the order of the chain: name -> condition on the columns of ``labels``.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_prose": "toxic = 1 AND quality = 1"}
#: Lengths in bytes of word beginnings that are features beside the words.
PREFIXES = (4, 5, 6, 7)
CHOSEN = 3000
PENALTY, STEPS, RATE = 0.2, 100, 0.3


def feature_hashes(words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and of the first PREFIXES bytes of longer ones; repeats stay."""
    folded, rows = common.BYTE_KEYS[common.LOWER[words.data]], words.rows()
    hashes, owners = [common.span_hashes(folded, words.starts, words.ends)], [rows]
    for size in PREFIXES:
        long = np.flatnonzero(words.ends - words.starts > size)
        hashes.append(common.mix(common.span_hashes(folded, words.starts[long], words.starts[long] + size) + np.uint64(size)))
        owners.append(rows[long])
    return np.concatenate(owners), np.concatenate(hashes)


def feature_sets(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index of a known feature), distinct, in order of rows."""
    rows, hashes = feature_hashes(common.Words(data, offsets, SEPARATORS_RAW))
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    hit = known[at] == hashes
    pairs = np.unique(rows[hit] * len(known) + at[hit])
    return pairs // len(known), pairs % len(known)


@dataclass
class Chain:
    """Hashes of the feature words, and for each category its word weights, bias and weights of earlier logits."""

    names: list[str]
    known: np.ndarray
    weights: list[np.ndarray]
    biases: list[float]
    earlier: list[np.ndarray]

    def predict(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """Probabilities, a row per document and a column per category."""
        logits = np.zeros((n, len(self.names)))
        for k in range(len(self.names)):
            logits[:, k] = np.bincount(rows, self.weights[k][features], n) + self.biases[k] + logits[:, :k] @ self.earlier[k]
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def _fit(rows: np.ndarray, features: np.ndarray, extra: np.ndarray, target: np.ndarray, width: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic regression with an L2 penalty by full-batch Adam, on the CHOSEN features that tell the target best (chi-square)."""
    n, positive = len(target), target.sum()
    seen, hit = np.bincount(features, minlength=width), np.bincount(features, target[rows], width)
    expected = seen * (positive / max(n, 1))
    strength = np.where(seen >= MIN_DOCS, (hit - expected) ** 2 / np.maximum(expected, 1e-9) + (hit - expected) ** 2 / np.maximum(seen - expected, 1e-9), -1)
    best = np.sort(np.argsort(-strength, kind="stable")[:CHOSEN])
    place = np.full(width, -1)
    place[best] = np.arange(len(best))
    use = place[features] >= 0
    rows, features, size = rows[use], place[features[use]], len(best)
    bias = float(np.log((positive + 1) / (n - positive + 1)))
    theta = np.concatenate([np.zeros(size), [bias], np.zeros(extra.shape[1])])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        logit = np.bincount(rows, theta[features], n) + theta[size] + extra @ theta[size + 1 :]
        error = 1 / (1 + np.exp(-np.clip(logit, -50, 50))) - target
        grad = np.concatenate([np.bincount(features, error[rows], size) + PENALTY * theta[:size], [error.sum()], extra.T @ error + PENALTY * theta[size + 1 :]]) / max(n, 1)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta = theta - RATE * (1 - t / (STEPS + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(width)
    weights[best] = theta[:size]
    return weights, float(theta[size]), theta[size + 1 :]


def fit(ids: list[int], texts: list[str | None], targets: dict[str, np.ndarray]) -> Chain:
    """The chain from sample documents; a category that has no example of its own is never predicted."""
    data, offsets = common.utf8(pa.array(texts, pa.large_string()))
    seen, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i, j in common.chunks(offsets):  # one chunk's features at a time
        rows, hashes = feature_hashes(common.Words(data, offsets[i : j + 1], SEPARATORS_RAW))
        order = np.lexsort((rows, hashes))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        found, n_docs = np.unique(hashes[new], return_counts=True)
        both, where = np.unique(np.concatenate([seen, found]), return_inverse=True)
        docs = np.bincount(where, np.concatenate([docs, n_docs]), len(both)).astype(np.int64)
        seen = both
    known = seen[docs >= MIN_DOCS]
    parts = [(i + r, f) for i, j in common.chunks(offsets) for r, f in [feature_sets(data, offsets[i : j + 1], known)]]
    rows, features = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    n = len(ids)
    fold = (common.mix(np.array(ids, np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64) if n else np.zeros(0, np.int64)
    chain = Chain(list(targets), known, [], [], [])
    held = np.zeros((n, len(targets)))  # out-of-fold logits
    for k, target in enumerate(targets.values()):
        for f in range(FOLDS):
            own = fold != f
            place = np.cumsum(own) - 1
            use = own[rows]
            w, b, v = _fit(place[rows[use]], features[use], held[own, :k], target[own], len(known))
            held[~own, k] = (np.bincount(rows, w[features], n) + b + held[:, :k] @ v)[~own]
        w, b, v = _fit(rows, features, held[:, :k], target, len(known))
        chain.weights.append(w)
        chain.biases.append(b)
        chain.earlier.append(v)
    used = np.flatnonzero(np.any(chain.weights, axis=0)) if chain.weights else np.zeros(0, int)
    chain.known, chain.weights = known[used], [w[used] for w in chain.weights]
    return chain


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """Labels of one document are joined by "any of them"; labels without a document or with a null id are left out before the sample is taken.

    Of rows with one id, the one with the least hash of its text counts.  Null and empty texts are examples without features.
    """
    categories = categories or CATEGORIES
    flags = [F.max(F.coalesce(F.expr(c), F.lit(False)).cast("int")).alias(f"c{k}") for k, c in enumerate(categories.values())]
    labelled = labels.where("doc_id is not null").groupBy("doc_id").agg(*flags)
    sizes = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    there = sizes.join(labelled.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("th", "bytes")).alias("d"))
    least = there.select("doc_id", "d.*").join(labelled, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()
    fitting = np.cumsum(least.column("bytes").to_numpy()) <= sample_bytes
    least = least.filter(pa.array(fitting))
    spark = docs.sparkSession
    chosen = spark.createDataFrame(list(zip(least.column("doc_id").to_pylist(), least.column("th").to_pylist(), strict=True)), "doc_id long, th long")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text")
    texts = {r["doc_id"]: r["text"] for r in keyed.join(F.broadcast(chosen), ["doc_id", "th"]).dropDuplicates(["doc_id"]).toLocalIterator()}  # ``sample`` rows at most
    order = np.argsort(least.column("doc_id").to_numpy(), kind="stable")
    ids = least.column("doc_id").to_numpy()[order].tolist()
    targets = {name: least.column(f"c{k}").to_numpy()[order].astype(float) for k, name in enumerate(categories)}
    return fit(ids, [texts.get(i) for i in ids], targets)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> of every row; a null or empty text gets what the biases say."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    columns = [f"p_{name}" for name in chain.names]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            found = [own.predict(*feature_sets(data, offsets[i : j + 1], own.known), j - i) for i, j in common.chunks(offsets)]
            p = np.concatenate(found) if found else np.zeros((0, len(columns)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(len(columns))]], ["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(stage, ", ".join(["doc_id long", *[f"{c} double" for c in columns]]))
