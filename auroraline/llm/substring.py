"""Removal of word spans that an earlier document already has, by suffix automata of reference shards.

The reference of a document is all documents with a smaller id, so it has no bound and cannot be
broadcast whole.  It is dealt to shards instead, such that equal spans meet in one shard:

1. Every window of ``span`` words has a *minimiser*, its least hash of K words.  Neighbouring windows
   with one minimiser make a *segment*.  Equal windows have equal minimisers, so only segments of
   the same minimiser can share a window.
2. Minimisers that one document alone has are dropped, by partial aggregates of their least and
   greatest doc_id.  Equal segments (by a 128-bit digest of their words) count once, for the least
   doc_id that has them: all other holders lose all its windows.
3. The distinct segments of a minimiser are its reference shard.  In ascending order of their first
   doc_id, each segment is streamed over the suffix automaton of those before it; where the matching
   statistic reaches ``span`` words, the window is in a smaller document.
4. A shard of more than SHARD segments (a passage in very many contexts) is dealt anew by a longer
   minimiser, step by step of LONGER, which tells its contexts apart; each step keeps or drops windows
   by the same rules.  The last minimiser is the window itself, and then a shard has one segment.  So the
   automata and the tasks that hold them are bounded, and the work grows with the number of segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN = 50
K, LONGER = 16, 2
#: Segments of a shard, and so of an automaton.
SHARD = 256


class SuffixAutomaton:
    """All substrings of the sequences that were added; sequences stay apart."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[str]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _clone(self, p: int, q: int, word: str) -> int:
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        copy = len(self.next) - 1
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: str) -> int:
        q = self.next[last].get(word)
        if q is not None:  # an earlier sequence has this prefix
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        new, p = len(self.next) - 1, last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return new

    def matches(self, words: list[str], span: int) -> list[int]:
        """Starts of the windows of ``span`` words that a sequence has, from the matching statistics."""
        state = have = 0
        found = []
        follow, link, length = self.next, self.link, self.length
        for i, word in enumerate(words):
            while state and word not in follow[state]:
                state = link[state]
                have = length[state]
            step = follow[state].get(word)
            if step is None:
                have = 0
                continue
            state, have = step, have + 1
            if have >= span:
                found.append(i - span + 1)
        return found


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least of every ``width`` neighbouring values, by doubling."""
    at = np.arange(len(values))
    size = 1
    while size < width:
        step = min(size, width - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        size += step
    return at


class Segments:
    """Segments of some rows of text: row, start (word in the chunk), number of windows and minimiser of k words."""

    def __init__(self, words: common.Words, span: int, k: int):
        hashes, rows = words.hashes(), words.rows()
        n = len(hashes) - span + 1
        self.row = self.start = self.windows = np.zeros(0, np.int64)
        self.minimiser = np.zeros(0, np.uint64)
        if n <= 0:
            return
        grams = common.window_hashes(hashes, k)
        place = _least_places(grams, span - k + 1)[:n]
        valid = rows[:n] == rows[span - 1 :]
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        start = np.flatnonzero(first)
        ending = np.flatnonzero(valid & np.append(first[1:] | ~valid[1:], True))
        self.start, self.windows = start, ending - start + 1
        self.row = rows[start]
        self.minimiser = grams[place[start]]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(common.doc_rank().alias("did"), F.xxhash64("text").alias("th"), "text")


def _shared(docs: DataFrame, span: int) -> DataFrame:
    """m: the minimisers that documents of different ids have."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did = batch.column(0).to_numpy()
            data, offsets = common.utf8(batch.column(1))
            for i, j in common.chunks(offsets):
                found = Segments(common.Words(data, offsets[i : j + 1], common.WHITE), span, min(K, span))
                order = np.argsort(found.minimiser, kind="stable")
                m, own = found.minimiser[order], did[i + found.row[order]]
                first = np.flatnonzero(np.diff(m, prepend=~m[:1]))
                yield pa.RecordBatch.from_arrays([pa.array(m[first].view(np.int64)), pa.array(np.minimum.reduceat(own, first) if len(m) else own), pa.array(np.maximum.reduceat(own, first) if len(m) else own)], ["m", "lo", "hi"])

    held = docs.select(common.doc_rank().alias("did"), "text").mapInArrow(stage, "m long, lo long, hi long")
    return held.groupBy("m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("m")


def _segments(rows: DataFrame, span: int, k: int, with_words: bool) -> DataFrame:
    """m, seg, at, windows (and words) of the segments of texts; the text is the last column and the others (longs) are kept."""
    names = rows.columns[:-1]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names))
            data, offsets = common.utf8(column)
            for i, j in common.chunks(offsets):
                words = common.Words(data, offsets[i : j + 1], common.WHITE)
                found = Segments(words, span, min(k, span))
                at = found.start - words.first[found.row]
                digests, parts, own, row = [], [], [], -1
                for r, a, n in zip(found.row.tolist(), at.tolist(), found.windows.tolist(), strict=True):
                    if r != row:
                        row, own = r, column[i + r].as_buffer().to_pybytes().split()
                    part = b" ".join(own[a : a + n + span - 1])
                    digests.append(hashlib.blake2b(part, digest_size=16).digest())
                    if with_words:
                        parts.append(part.decode("utf-8", "surrogatepass"))
                kept = [batch.column(c).take(pa.array(i + found.row)) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(found.minimiser.view(np.int64)), pa.array(digests, pa.binary()), pa.array(at.astype(np.int32)), pa.array(found.windows.astype(np.int32)), *([pa.array(parts, pa.string())] if with_words else [])],
                    [*names, "m", "seg", "at", "windows", *(["words"] if with_words else [])],
                )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(stage, ", ".join([*kinds, "m long", "seg binary", "at int", "windows int", *(["words string"] if with_words else [])]))


def _fetch(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """m, seg, first, words of the wanted segments (m, seg, did, th, at, windows), from the whole texts."""
    lists = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("m", "seg", "at", "windows")).alias("segs"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, text, segs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                cut = [b" ".join(words[s["at"] : s["at"] + s["windows"] + span - 1]).decode("utf-8", "surrogatepass") for s in segs]
                yield pa.RecordBatch.from_arrays([pa.array([s["m"] for s in segs], pa.int64()), pa.array([s["seg"] for s in segs], pa.binary()), pa.array([did] * len(segs), pa.int64()), pa.array(cut, pa.string())], ["m", "seg", "first", "words"])

    # a row that is there more than once gives its segments once
    joined = _keyed(docs).join(lists.hint("merge"), ["did", "th"]).select("did", "text", "segs")
    return joined.mapInArrow(stage, "m long, seg binary, first long, words string").dropDuplicates(["m", "seg"])


def _stream(shards: DataFrame, span: int) -> DataFrame:
    """m, seg and the starts (in the segment) of the windows that a segment with a smaller first doc_id has."""

    def judge(group: list[tuple]) -> Iterator[tuple]:
        automaton, waiting, at = SuffixAutomaton(), [], None
        for m, seg, first, text in group:
            words = text.split(" ")
            if first != at:
                for earlier in waiting:
                    automaton.add(earlier)
                waiting, at = [], first
            if found := automaton.matches(words, span):
                yield m, seg, found
            waiting.append(words)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and group[0][0] != row[0]:
                    out += judge(group)
                    group = []
                group.append(row)
            yield _verdicts(out)
        yield _verdicts(list(judge(group)))

    dealt = shards.select("m", "seg", "first", "words").repartition("m").sortWithinPartitions("m", "first", "seg")
    return dealt.mapInArrow(stage, "m long, seg binary, hits array<int>")


def _verdicts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["m", "seg", "hits"])


def _several(firsts: DataFrame) -> DataFrame:
    """``firsts`` of the minimisers that have several, with their number as ``size``."""
    sizes = common.cut(firsts.groupBy("m").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    return firsts.join(sizes.hint("merge"), "m")


def _late(segments: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """``segments`` with ``starts``: the windows that one of a smaller ``order`` has; ``known`` has the first holder and the hits of each distinct segment."""
    judged = segments.join(known.hint("merge"), ["m", "seg"])
    every = F.sequence(F.lit(0), F.col("windows") - 1)
    hits = F.when(F.col(order) > F.col("least"), every).otherwise(F.col("hits"))
    return judged.withColumn("starts", F.transform(hits, lambda h: h + F.col("at"))).where("starts is not null")


def _judge(shards: DataFrame, span: int, k: int) -> DataFrame:
    """m, seg, hits of distinct segments (m, seg, first, words, size) with a minimiser of k words."""
    if k >= span:  # segments of one window; only hashes that clash bring two together
        return _stream(shards, span)
    verdicts = _stream(shards.where(F.col("size") <= SHARD), span)
    hot = shards.where(F.col("size") > SHARD)
    if not hot.limit(1).count():
        return verdicts
    k = min(k * LONGER, span)
    parents = hot.select(F.xxhash64("m", "seg").alias("parent"), "first", "words")
    parts = common.cut(_segments(parents, span, k, True), "parts")
    firsts = common.cut(parts.groupBy("m", "seg").agg(F.min("first").alias("first"), F.first("words").alias("words")), "firsts")
    deeper = _judge(common.cut(_several(firsts), "several"), span, k)
    known = common.cut(firsts.select("m", "seg", F.col("first").alias("least")).join(deeper.hint("merge"), ["m", "seg"], "left"), "known")
    late = _late(parts.drop("words"), known, "first").groupBy("parent").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("hits"))
    named = hot.select("m", "seg", F.xxhash64("m", "seg").alias("parent")).join(late.hint("merge"), "parent").select("m", "seg", "hits")
    return verdicts.unionByName(named)


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """did, th and ``starts``: first words of the windows of ``span`` words that start in a document with a smaller doc_id too."""
    shared = common.cut(_shared(docs, span), "shared")
    # joins of sorted sides, so that a minimiser with very many segments is split between tasks
    candidates = common.cut(_segments(_keyed(docs), span, K, False).join(shared.hint("merge"), "m"), "candidates")
    common.release(shared)
    firsts = candidates.groupBy("m", "seg").agg(F.min(F.struct("did", "th", "at", "windows")).alias("f")).select("m", "seg", "f.*")
    firsts = common.cut(firsts, "firsts")
    several = common.cut(_several(firsts), "several")
    words = _fetch(docs, several.drop("size"), span)
    shards = common.cut(words.join(several.select("m", "seg", "size").hint("merge"), ["m", "seg"]), "shards")
    common.release(several)
    verdicts = common.cut(_judge(shards, span, min(K, span)), "verdicts")
    common.release(shards)
    known = common.cut(firsts.select("m", "seg", F.col("did").alias("least")).join(verdicts.hint("merge"), ["m", "seg"], "left"), "known")
    spans = _late(candidates, known, "did").groupBy("did", "th").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    spans = common.cut(spans, "spans")
    common.release(candidates, firsts, verdicts, known)
    return spans


def _joined(docs: DataFrame, span: int) -> DataFrame:
    """row (all columns of ``docs``) and starts (null where nothing repeats)."""
    keyed = docs.select(common.whole(docs).alias("row"), common.doc_rank().alias("did"), F.xxhash64("text").alias("th"))
    return keyed.join(repeated_spans(docs, span).hint("merge"), ["did", "th"], "left").select("row", "starts")


def _gone(starts: list[int], n: int, span: int) -> np.ndarray:
    return common.union_length(np.array(starts, np.int64), span, n)


def remove(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; white space between kept words stays.

    Null and short texts stay as they are, and so do all other columns, whatever their names.  Rows without a doc_id come after all others and are no
    reference for each other; neither are rows with equal ids.  A text may become empty.
    """

    def shorten(text: bytes, starts: list[int]) -> bytes:
        words = common.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), common.WHITE)
        gone = _gone(starts, len(words), span)
        if gone.all():
            return b""
        parts, at, lost = [], 0, False
        for a, x in zip(words.starts.tolist(), gone.tolist(), strict=True):
            if x and not lost:
                parts.append(text[at:a])
            elif lost and not x:
                at = a
            lost = x
        parts.append(text[at:] if not lost else b"")
        return b"".join(parts).rstrip(b" \t\n\r\x0b\x0c") if lost else b"".join(parts)

    at = docs.columns.index("text")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, starts = batch.column(0).flatten(), batch.column(1).to_pylist()
            texts = [t.as_py() if not s else shorten(t.as_buffer().to_pybytes(), s).decode("utf-8", "surrogatepass") for t, s in zip(fields[at], starts, strict=True)]
            fields[at] = pa.array(texts, fields[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(batch.schema.field(0).type))], ["row"])

    joined = _joined(docs, span)
    return joined.mapInArrow(stage, joined.select("row").schema).select("row.*")


def digest(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) of every row."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sums = [], [], []
            ids, texts = batch.column(0).flatten()
            for text, starts in zip(texts, batch.column(1).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                total.append(len(words))
                if starts:
                    words = [w for w, x in zip(words, _gone(starts, len(words), span).tolist(), strict=True) if not x]
                removed.append(total[-1] - len(words))
                sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _joined(docs.select("doc_id", "text"), span).mapInArrow(stage, "doc_id long, n_words long, n_removed long, kept_sha256 string")
