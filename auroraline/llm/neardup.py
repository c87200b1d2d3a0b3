"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. One hash of every shingle is all the hashing there is: its high bits choose one of BANDS * ROWS
   bins and the least hash of a bin is its value.  An empty bin takes the value of another one that
   a fixed random sequence of the bin meets first (optimal densification), so that bins agree with
   the probability of the sets' similarity.  Documents with the same set are one *class* from there on.
2. ROWS neighbouring bins make a band; classes with an equal band share a bucket.  A pair of
   similarity 0.8 misses all 40 bands with probability 5e-6, one of 0.85 with 6e-9.
3. A bucket's candidates are stars: its least class to all others and, while it holds several components,
   the class with the most links to all others.  Each edge is confirmed on the full sets, and
   confirmed links are joined to components.
4. The classes of buckets that still hold several components are *unsettled*.  All links between their
   components are found by an exact prefix join: shingles are put in one order, first those that a single
   component has and then by their frequency; two sets can only be alike if they share a shingle in
   their first few and enough shingles follow it in both.  Classes that merely share bands have
   their own shingles up front, so a crowd just below the limit makes no candidate, and a link
   of two classes that share a band is never lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BANDS, ROWS = 40, 6
#: Rounds of stars around the class with the most links, before the exact join.
STARS = 2
BINS = BANDS * ROWS
WIDTH, PERCENT = 5, 80
_NO_ID = 2**63 - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the number for each.

    A text of fewer words than ``width`` has one shingle, the whole sequence; one without words has none.
    """
    words = common.Words(data, offsets, common.WHITE)
    hashes, rows, counts = words.hashes(common.LOWER), words.rows(), words.counts
    shingles = common.window_hashes(hashes, width)
    inside = rows[: len(shingles)] == rows[width - 1 :] if len(shingles) else np.zeros(0, bool)
    shingles, owner = shingles[inside], rows[: len(shingles)][inside]
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        if len(short):
            shingles = np.concatenate([shingles, common.window_hashes(hashes, size)[words.first[short]]])
            owner = np.concatenate([owner, short])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.bincount(owner[new], minlength=len(counts))


def signatures(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of BINS values for each set; zeros for empty sets."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    place = ((sets >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64) + owner * BINS
    first = np.ones(len(sets), bool)
    first[1:] = place[1:] != place[:-1]
    values, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    values[place[first]] = sets[first]
    filled[place[first]] = True
    empty = np.flatnonzero(~filled & np.repeat(counts > 0, BINS))
    attempt = 0
    while len(empty):
        attempt += 1
        row, bin_ = empty // BINS, empty % BINS
        if attempt < 5000:
            tried = common.mix((bin_ + 1).astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt))
            source = row * BINS + (tried % np.uint64(BINS)).astype(np.int64)
        else:
            source = row * BINS + (bin_ + attempt) % BINS
        found = filled[source]
        values[empty[found]] = values[source[found]]
        empty = empty[~found]
    return values.reshape(n, BINS)


def band_keys(values: np.ndarray) -> np.ndarray:
    """BANDS keys for each row of values."""
    banded = values.reshape(len(values), BANDS, ROWS)
    keys = np.broadcast_to(common.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), banded.shape[:2]).copy()
    for r in range(ROWS):
        keys = common.mix(keys ^ banded[:, :, r])
    return keys.view(np.int64)


def _sign(docs: DataFrame, width: int) -> DataFrame:
    """did, th, set_id (null for an empty set), n and bands of every row."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            ids, sizes, bands = [], [], []
            for i, j in common.chunks(offsets):
                sets, counts = shingle_sets(data, offsets[i : j + 1], width)
                ends = np.cumsum(counts)
                ids += [hashlib.blake2b(sets[e - n : e], digest_size=16).digest() if n else None for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                sizes.append(counts)
                bands.append(band_keys(signatures(sets, counts)))
            flat = np.concatenate(bands).reshape(-1) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), common.list_array(flat, np.full(len(ids), BANDS), pa.int64())],
                ["did", "th", "set_id", "n", "bands"],
            )

    keyed = docs.select(common.doc_rank().alias("did"), F.xxhash64("text").alias("th"), "text")
    return keyed.mapInArrow(stage, "did long, th long, set_id binary, n long, bands array<long>")


def _confirm(edges: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``edges`` whose sets are similar enough, from the full texts of their classes."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    wanted = nodes.join(classes.select("node", "did", "th"), "node")
    keyed = docs.select(common.doc_rank().alias("did"), F.xxhash64("text").alias("th"), "text")
    texts = common.cut(keyed.join(wanted, ["did", "th"]).groupBy("node").agg(F.first("text").alias("text")), "texts")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            one, two = common.utf8(batch.column(2)), common.utf8(batch.column(3))
            for i, j in common.chunks(one[1] + two[1]):
                a, n_a = shingle_sets(one[0], one[1][i : j + 1], width)
                b, n_b = shingle_sets(two[0], two[1][i : j + 1], width)
                at_a = at_b = 0
                for k, (x, y) in enumerate(zip(n_a.tolist(), n_b.tolist(), strict=True)):
                    same = len(np.intersect1d(a[at_a : at_a + x], b[at_b : at_b + y], assume_unique=True))
                    good[i + k] = 100 * same >= percent * (x + y - same)
                    at_a, at_b = at_a + x, at_b + y
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    paired = edges.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    good = common.cut(paired.mapInArrow(stage, "a long, b long"), "confirmed")
    common.release(texts)
    return good


def _pair(x: Column | str, y: Column | str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _can(x: str, y: str, percent: int) -> Column:
    """Whether sets of so many shingles can be alike: |A & B| / |A | B| is no more than the smaller size by the larger one."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links: only the components that they touch are joined anew."""
    ends = links
    for end in ("a", "b"):
        own = found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        ends = ends.join(own, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    ends = common.cut(ends, "ends")
    names = components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).where("a <> b").distinct())
    names = names.select(F.col("node").alias("component"), F.col("component").alias("now"))
    alone = ends.select(F.col("a").alias("node"), F.col("of_a").alias("component")).union(ends.select("b", "of_b")).where("node = component")
    every = found.union(alone).distinct()
    merged = common.cut(every.join(names, "component", "left").select("node", F.coalesce("now", "component").alias("component")), "merged")
    common.release(ends)
    return merged


def _sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """node, component, n and the shingles of the classes in ``nodes`` (node, component), from their full texts."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            for i, j in common.chunks(offsets):
                sets, counts = shingle_sets(data, offsets[i : j + 1], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(counts, pa.int64()), common.list_array(sets.view(np.int64), counts, pa.int64())], ["node", "component", "n", "shingles"])

    wanted = nodes.join(classes.select("node", "did", "th").hint("merge"), "node")
    keyed = docs.select(common.doc_rank().alias("did"), F.xxhash64("text").alias("th"), "text")
    # rows with one id and text stand for one class and count once
    texts = keyed.join(wanted.hint("merge"), ["did", "th"]).select("node", "component", "text").dropDuplicates(["node"])
    return texts.mapInArrow(stage, "node long, component long, n long, shingles array<long>")


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that can be alike, so all that are, and few others.

    With sizes x <= y, alike sets share o = ceil(percent * (x + y) / (100 + percent)) shingles or more.  So they
    share one that is among the first x - ceil(2 * percent * x / (100 + percent)) + 1 of the smaller set and
    the first y - ceil(percent * y / 100) + 1 of the larger one, and o - 1 shingles stand behind it in both.
    """
    rows = sets.select("node", "component", F.explode("shingles").alias("s"))
    spread = rows.groupBy("s").agg(F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    # a shingle of one component alone cannot match: 0, and so the first in the order
    weight = F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(F.col("f"))
    ordered = rows.select("s", "node").join(spread.select("s", weight.alias("f")).hint("merge"), "s")
    n = F.col("n")
    probe = (n - F.ceil(n * percent / F.lit(100)) + 1).cast("int")
    index = (n - F.ceil(n * (2 * percent) / F.lit(100 + percent)) + 1).cast("int")
    lists = ordered.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("all"))
    kept = lists.join(sets.select("node", "component", "n").hint("merge"), "node").select("node", "component", "n", index.alias("index"), F.slice("all", F.lit(1), probe).alias("first"))
    prefixes = common.cut(kept.select("node", "component", "n", "index", F.posexplode("first").alias("at", "x")).where("x.f > 0").select("node", "component", "n", F.expr("at < index").alias("short"), "at", F.col("x.s").alias("s")), "prefixes")
    small = prefixes.where("short").select("s", F.col("node").alias("a"), F.col("component").alias("of_a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    large = prefixes.select("s", F.col("node").alias("b"), F.col("component").alias("of_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    shared = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100 + percent))
    can = (
        (F.col("of_a") != F.col("of_b")) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
        & (100 * F.col("n_a") >= percent * F.col("n_b")) & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= shared)
    )
    pairs = small.hint("merge").join(large, (small["s"] == large["s"]) & can).select(*_pair("a", "b")).distinct()
    found = common.cut(pairs, "pairs")
    common.release(prefixes)
    return found


def _links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have a link."""
    dealt = classes.select("node", "n", F.explode("bands").alias("key"))
    # tables of their own, so that both sides of a join are sorted from files and a hot key is split
    shared = common.cut(dealt.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("lo")).where("size > 1"), "shared")
    buckets = common.cut(dealt.join(shared.hint("merge"), "key"), "buckets")
    common.release(shared)
    tested = buckets.where((F.col("node") != F.col("lo.node")) & _can("n", "lo.n", percent)).select(*_pair("lo.node", "node")).distinct()
    tested = common.cut(tested, "stars")
    links = _confirm(tested, docs, classes, width, percent)
    found = components(links)
    crowds = common.cut(buckets.where("size > 2").select("key", "node", "n"), "crowds")  # of two, the only pair has been tested
    common.release(buckets)
    for round_ in range(STARS + 1):
        degrees = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
        known = found.join(degrees, "node").select("node", "component", "degree")
        named = crowds.select("key", "node", "n").join(known.hint("merge"), "node", "left")
        named = common.cut(named.select("key", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "node", "n", F.coalesce("component", "node").alias("component")).alias("own")), "named")
        mixed = named.groupBy("key").agg(F.max("own").alias("c"), F.min("own.component").alias("x"), F.max("own.component").alias("y")).where("x <> y")
        mixed = common.cut(mixed.select("key", "c"), "mixed")
        open_ = common.cut(named.join(mixed.hint("merge"), "key").select("key", "own.node", "own.n", "own.component", "c"), "unsettled")
        common.release(named, mixed, crowds)
        crowds = open_
        if not open_.limit(1).count():
            break
        if round_ < STARS:
            fresh = open_.where((F.col("component") != F.col("c.component")) & _can("n", "c.n", percent)).select(*_pair("node", "c.node")).distinct()
        else:
            sets = common.cut(_sets(open_.select("node", "component").distinct(), docs, classes, width), "sets")
            fresh = _prefix_pairs(sets, percent)
            common.release(sets)
        fresh = common.cut(fresh.join(tested.hint("merge"), ["a", "b"], "left_anti"), "stars")
        more = _confirm(fresh, docs, classes, width, percent)
        if more.limit(1).count():
            links = links.unionByName(more)
            found = _merged(found, more)
        tested = tested.unionByName(fresh)
    return found


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable) and kept of every row of ``docs`` (doc_id, text).

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased.  A null or empty text has an empty set and is
    linked with nothing.  Rows without a doc_id rank after all others: their component_id is null where
    no row with an id is in the group, and then they are kept.  Repeated rows get equal results.
    """
    signed = common.cut(_sign(docs, width), "signed")
    classes = signed.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct("did", "th")).alias("m"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes = common.cut(classes.select(F.monotonically_increasing_id().alias("node"), "set_id", "m.did", "m.th", "n", "bands", "copies"), "classes")
    found = common.cut(_links(docs, classes, width, percent).join(classes.select("node", "set_id", "did").hint("merge"), "node"), "found")
    least = found.groupBy("component").agg(F.min("did").alias("least"))
    linked = found.join(least, "component").select("set_id", "least")
    copied = classes.where("copies > 1").select("set_id", F.col("did").alias("own"))
    groups = common.cut(copied.join(linked, "set_id", "full").select("set_id", F.coalesce("least", "own").alias("least")), "groups")
    common.release(classes, found)
    named = signed.select("did", "th", "set_id", "n").join(groups.hint("merge"), "set_id", "left")
    component = F.coalesce("least", "did")
    return named.select(
        F.nullif("did", F.lit(_NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, F.lit(_NO_ID)).alias("component_id"), (F.col("did") == component).alias("kept"), "th"
    )


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group, the one with the least doc_id; repeated rows of it stay once.

    Columns of any name and type pass through.  Rows without an id stay once per text where no row with an id is in their group.
    """
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("did"), "th").distinct()
    keyed = docs.select(common.whole(docs).alias("row"), common.doc_rank().alias("did"), F.xxhash64("text").alias("th"))
    return keyed.join(gone, ["did", "th"], "left_anti").dropDuplicates(["did", "th"]).select("row.*")
