"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Each document gets a few counts.  Fixed base rules reject what is hardly text.  On top of them,
each *controlled rule* rejects documents whose score is above a cutoff.  The cutoffs come from
labelled documents: for every stratum and rule the grid of cutoffs is walked from the mildest to
the strictest, and a step is taken while an exact binomial test rejects "more than ``risk`` of the
good documents would be lost".  Testing in a fixed order keeps the error of one walk at its level,
and the level is the total ``delta`` divided by the number of walks (Bonferroni over strata and
rules), so with probability 1 - ``delta`` no rule in any stratum loses more than its share.
The union of the rules then loses no more than ``alpha`` = risk * number of rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: name -> (score of a document, cutoffs from the mildest to the strictest)
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "repeats": ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / n_words", (0.2, 0.1, 0.05, 0.04, 0.03, 0.02, 0.01, 0.005)),
    "word_chars": ("word_chars / n_words", (30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5)),
}
ALPHA, DELTA = 0.02, 0.05
MAX_STRATA = 4096


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text has twice or more.

    Windows are sorted by (hash of the three words, position); equal neighbours are repeats.
    Each repeated position adds the words up to the next repeated position, three at most.
    """

    def windows(w: Column) -> Column:
        return F.array_sort(
            F.transform(
                F.sequence(F.lit(1), F.size(w) - 2),
                lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")),
            )
        )

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    counted = let(words, lambda w: let(windows(w), lambda s: let(positions(s), covered)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(counted)


def features(docs: DataFrame, keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Counts of every document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text has no words and no lines; an empty one likewise.  Both fail the base rules.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = docs.select(
        "doc_id",
        *[c for c in keep if c in docs.columns],
        F.array_remove(F.split(text, WORD_SPLIT), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    words, lines = F.col("_words"), F.col("_lines")
    n = F.size(words).cast("long")
    counted = worded.select(
        "doc_id",
        *[c for c in keep if c in docs.columns],
        n.alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _score(rule: str) -> Column:
    top, bottom = RULES[rule][0].split(" / ")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, and back by the recurrence; about 1e-12 exact."""
    y = x + F.lit(8.0)
    back = F.lit(0.0)
    for k in range(8):
        back = back + F.log(x + F.lit(float(k)))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - back


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) where k < n * p, else 1 (no evidence).

    The sum starts at the term of k and goes down; terms fall at least as fast as a geometric
    series, so it ends where the rest is below 1e-17 of the first term.
    """
    n, k = n.cast("double"), k.cast("double")
    log_term = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = lambda i: i * F.lit((1 - p) / p) / (n - i + 1)  # noqa: E731  term(i - 1) / term(i)
    steps = F.least(k, F.ceil(F.lit(40.0) / -F.log(ratio(k)))).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    summed = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        start,
        lambda a, j: let(a["term"] * ratio(k - j + 1), lambda t: F.struct(t.alias("term"), (a["total"] + t).alias("total"))),
        lambda a: a["total"],
    )
    return F.when(n * p <= k, F.lit(1.0)).when(k == 0, F.exp(n * math.log1p(-p))).otherwise(F.exp(log_term) * summed)


def cutoffs(feats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the strictest cutoff that the walk reached; rules without one are absent.

    Good documents are those with quality 1 that pass the base rules; a document with several
    labels counts once, as good only if all of its labels are.  Only as many rows as strata times
    rules leave this plan.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_good")).where("_good = 1").select(F.col("doc_id").alias("_id"))
    held = feats.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    key = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    # how many cutoffs of the grid a score is above: one number a rule instead of one row a cutoff
    above = [sum((F.when(_score(r) > c, 1).otherwise(0) for c in RULES[r][1]), F.lit(0)).alias(r) for r in RULES]
    levels = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("above")) for r in RULES]))
    counted = held.select(key.alias("stratum"), *above).select("stratum", levels.alias("x")).groupBy("stratum", "x.rule", "x.above").agg(F.count("*").alias("m"))
    walks = counted.groupBy("stratum", "rule").agg(F.sum("m").alias("n"), F.map_from_entries(F.collect_list(F.struct("above", "m"))).alias("by"))
    walks = common.cut(walks, "walks")
    level = delta / max(1, walks.select("stratum").distinct().count() * len(RULES))
    grid = F.create_map(*[x for r in RULES for x in (F.lit(r), F.array(*[F.lit(c) for c in RULES[r][1]]))])
    steps = walks.select("stratum", "rule", "n", "by", F.size(grid[F.col("rule")]).alias("n_steps"), F.posexplode(grid[F.col("rule")]).alias("step", "cutoff"))
    # cutoffs fall, so a score above that of step s is above all later ones too: documents lost there are above n_steps - s or more
    lost = F.aggregate(F.map_entries("by"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] >= F.col("n_steps") - F.col("step"), e["value"]).otherwise(0))
    tested = steps.select("stratum", "rule", "step", "cutoff", binomial_tail(F.col("n"), lost, alpha / len(RULES)).alias("p"))
    passed = tested.groupBy("stratum", "rule").agg(
        F.min(F.when(F.col("p") > level, F.col("step"))).alias("stop"),
        F.collect_list(F.struct("step", "cutoff")).alias("all"),
    )
    last = F.array_max(F.filter("all", lambda x: F.col("stop").isNull() | (x["step"] < F.col("stop"))))
    return passed.select("stratum", "rule", last["cutoff"].alias("cutoff")).where("cutoff is not null")


def _wide(found: DataFrame) -> DataFrame:
    """A row per stratum with a column _<rule> for each cutoff, with a hint to broadcast while it is small; beyond that size Spark shuffles and splits hot strata."""
    wide = found.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES])
    return wide.hint("broadcast") if found.count() <= MAX_STRATA * len(RULES) else wide


def _broken() -> Column:
    return F.coalesce(*[F.when(_score(r) > F.col(f"_{r}"), F.lit(r)) for r in RULES])


def keep_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs`` without those that a base or controlled rule rejects; columns of any name, and their values, as before.

    Null and empty texts are rejected by the base rules; null doc_ids carry no label but are judged like others;
    repeated rows are judged one by one.  Each text is looked at once: its row is written with its counts.
    """
    own = F.col(stratum).cast("string") if stratum in docs.columns else F.lit(None).cast("string")
    rows = docs.select(common.whole(docs).alias("_row"), F.col("doc_id"), F.col("text"), F.coalesce(own, F.lit("")).alias("_stratum"))
    feats = common.cut(features(rows, ("_row", "_stratum")), "quality")
    found = common.cut(cutoffs(feats.drop("_row"), labels, "_stratum", alpha, delta), "cutoffs")
    judged = feats.join(_wide(found), F.col("_stratum") == F.col("stratum"), "left")
    return judged.where(~F.col("base_failed") & _broken().isNull()).select("_row.*")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The features of each document, ``base_failed``, ``failed_rule`` (null if none) and ``kept``.

    Null doc_ids carry no label but are judged like others; repeated rows are judged one by one.
    Without labels no cutoff can be shown safe, and only the base rules reject.
    """
    spark = docs.sparkSession
    feats = common.cut(features(docs, (stratum,)), "quality")
    if stratum not in feats.columns:
        feats = feats.withColumn(stratum, F.lit(None).cast("string"))
    found = common.cut(cutoffs(feats, labels, stratum, alpha, delta), "cutoffs")
    key = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    judged = feats.withColumn("_stratum", key).join(_wide(found), F.col("_stratum") == F.col("stratum"), "left")
    broken = _broken()
    return judged.select(
        "doc_id", F.col("_stratum").alias("stratum"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(~F.col("base_failed"), broken).alias("failed_rule"),
        (~F.col("base_failed") & broken.isNull()).alias("kept"),
    )
