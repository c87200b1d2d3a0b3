"""Archive scans on unreadable input, direct trees and truth that never comes."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from auroraline.operators.trees import DirectTrees
from auroraline.sources import archives
from auroraline.streaming import live


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_model_index_leaves_other_lines_out(spark):
    rows = archives.parse_model_index(lines(spark, "2024/060-05:10:00  -31.5", " 2024/366-23:59:59 7 ", "2024/000-00:00:00 1", "2024/001-24:00:00 1", "2024/001-01:00:00", "text", "", None)).collect()
    assert sorted((str(r[0]), r[1]) for r in rows) == [("2024-02-29 05:10:00", -31.5), ("2024-12-31 23:59:59", 7.0)]


def test_kp_table_fills_comments_and_short_lines(spark):
    kps, aps = ["0.333", "-1.000", *["2.0"] * 6], ["2", "-1", *["7"] * 6]
    day = lambda y, m, d: " ".join([y, m, d, "0", "0", "0", "0", *kps, *aps, "5", "10", "90", "91", "1"])
    rows = archives.parse_kp_table(lines(spark, "# y m d", "", day("2024", "02", "29"), day("2023", "02", "29"), "2024 01 01 0", None)).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in rows)[0] == ("2024-02-29 00:00:00", 0.333, 2, 1)
    assert sorted(r[0].hour for r in rows) == [0, 6, 9, 12, 15, 18, 21]


def test_minutes_shift_and_fills(spark):
    words = ["0"] * 28
    words[:4] = ["2024", "1", "2", "3"]
    words[9], words[17], words[18], words[21], words[25], words[27] = "999999", "9999.99", "-3.5", "99999.9", "4.5", "99.99"
    shifted = [*words[:9], "600", *words[10:]]
    rows = archives.parse_minutes(lines(spark, " ".join(words), " ".join(shifted), " ".join(words[:20]), "x " * 28, None)).orderBy("measured_at").collect()
    assert [(str(r["arrives_at"]), str(r["measured_at"])) for r in rows] == [("2024-01-01 02:03:00", "2024-01-01 01:53:00"), ("2024-01-01 02:03:00", "2024-01-01 02:03:00")]
    assert all((r["by_gsm"], r["bz"], r["v"], r["n"], r["pdyn"]) == (None, -3.5, None, 4.5, None) for r in rows)


def test_observatory_needs_both_components(spark):
    times = [f"2024-01-01T00:0{i}:00.000Z" for i in range(4)]
    document = lambda **of: json.dumps({"times": times, "values": [{"id": k, "metadata": {"element": k}, "values": v} for k, v in of.items()]})
    x, y = [1.0, 4.0, None, 5.0], [1.0, 5.0, 5.0, 5.0]
    rows = spark.createDataFrame([("a", document(X=x, Y=y)), ("b", document(X=x)), ("c", document(X=x, Y=y[:2])), ("d", "{"), ("e", None)], "k string, value string")
    samples = archives.parse_observatory(rows, ["k"])
    assert sorted(r["k"] for r in samples.collect()) == ["a"] * 4
    assert [(r["k"], r["rate"]) for r in archives.field_rates(samples, ["k"]).collect()] == [("a", 5.0)]


def test_direct_trees_learn_and_persist(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit("kept").alias("other"))
    rows = rows.withColumn("y", F.when(F.col("a") > 9, F.col("b")).otherwise(-F.col("b")))
    with_null = rows.unionByName(spark.range(1).select(F.lit(None).cast("double").alias("a"), F.lit(0.0).alias("b"), F.lit("x").alias("other"), F.lit(1e6).alias("y")))
    model = DirectTrees.fit(with_null, ["a", "b"], "y")
    model.save(f"{tmp_path}/trees")
    made = model.predict(rows, "made")
    assert made.columns == [*rows.columns, "made"]
    again = DirectTrees.load(f"{tmp_path}/trees").predict(rows, "made")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, again.collect()))
    assert math.sqrt(made.agg(F.avg(F.pow(F.col("made") - F.col("y"), F.lit(2)))).first()[0]) < 0.3


def test_truth_that_never_comes(spark):
    at = lambda h: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(h) * 3600)
    f = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 500)], "k string, h int").select("k", "h", at("h").alias("target"))
    t = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 6.0), ("b", 500, 7.0)], "k2 string, h2 int, truth double").select("k2", at("h2").alias("seen"), "truth")
    found = live.with_late_truth(f, t, ["k"], ["k2"]).select("k", "h", "truth").collect()
    assert sorted((r[0], r[1], r[2] is None or r[2]) for r in found) == [("a", 1, 5.0), ("a", 2, True), ("b", 1, True), ("b", 500, 7.0)]
    assert not live.with_late_truth(f.limit(0), t.limit(0), ["k"], ["k2"]).collect()
