"""One query per operator over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, lm_score, neardup, quality, rollup, substring, tokenstore, toxicity
from .common import cut, scratch_path, table
from .oracles import ORACLES


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.fit_and_score(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.mark(docs, table(spark, sf_dir, "benchmark")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 3, 85).drop("th")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.5)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenstore.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), path)
    return tokenstore.read_digest(spark, path)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "failed_rule"
    )


#: The text of a revised document: symbols become spaces, which changes the counts of both versions.
REDACTED = "regexp_replace(text, '[#*$%&|<>@_-]', ' ')"


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; those that a label calls bad are deleted; those that a label calls toxic, and none bad, are replaced by a text without symbols; then all batches come again."""
    names = list(rollup.TOKENIZERS)
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    bad, changed = marks.where("quality = 0").select("doc_id"), marks.where("toxic = 1 and quality <> 0").select("doc_id")
    # both texts are counted in one pass, so only counts are joined to labels; a symbol's space keeps n_chars
    redacted = {f"new {name}": sql.replace("coalesce(text, '')", f"coalesce({REDACTED}, '')") for name, sql in rollup.TOKENIZERS.items()}
    counts = cut(rollup.counted(docs, rollup.TOKENIZERS | redacted), "counts")
    new = counts.select("doc_id", "source", "lang", "n_chars", *[F.col(f"`new {name}`").alias(name) for name in names])
    counts = counts.drop(*redacted)
    ledger = rollup.Ledger(spark, scratch_path(spark, "ledger"))
    batches = {
        "inserts": rollup.deltas(counts, names),
        "deletes": rollup.deltas(counts.join(bad, "doc_id", "left_semi"), names, -1),
        "revisions": rollup.revisions(*[c.join(changed, "doc_id", "left_semi") for c in (counts, new)], names),
    }
    for name in [*batches, *batches]:
        ledger.commit(name, batches[name])
    return ledger.totals()


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit_field(docs))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
