"""Boosted shallow trees over binned features; each level costs one aggregation, and only histograms leave the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, DEPTH, ROUNDS, RATE = 16, 2, 8, 0.3


def _bin(feature: str, edges: list[float]) -> Column:
    return sum((F.when(F.col(feature) > e, 1).otherwise(0) for e in edges), F.lit(0))


def _tree(tree: dict, binned: list[str]) -> Column:
    if "value" in tree:
        return F.lit(float(tree["value"]))
    return F.when(F.col(binned[tree["feature"]]) <= tree["bin"], _tree(tree["left"], binned)).otherwise(_tree(tree["right"], binned))


def _grow(rows: DataFrame, binned: list[str], node: Column, depth: int) -> dict[int, dict]:
    """The best split of every node of a level from one grouped sum over (node, feature, bin)."""
    long = rows.select(node.alias("node"), "_r", F.posexplode(F.array(*binned)).alias("feature", "bin"))
    sums: dict[tuple, tuple] = {(r["node"], r["feature"], r["bin"]): (r["n"], r["s"]) for r in long.groupBy("node", "feature", "bin").agg(F.count("*").alias("n"), F.sum("_r").alias("s")).collect()}
    out = {}
    for k in {k for k, _, _ in sums}:
        own = {(f, b): v for (n, f, b), v in sums.items() if n == k}
        n = sum(v[0] for (f, _), v in own.items() if f == 0)
        s = sum(v[1] for (f, _), v in own.items() if f == 0)
        best = {"gain": 1e-9, "value": s / n}
        for f in range(len(binned)):
            left_n = left_s = 0.0
            for b in range(BINS):
                m, x = own.get((f, b), (0, 0.0))
                left_n, left_s = left_n + m, left_s + x
                if 20 <= left_n <= n - 20:
                    gain = left_s**2 / left_n + (s - left_s) ** 2 / (n - left_n) - s**2 / n
                    if gain > best["gain"]:
                        best = {"gain": gain, "feature": f, "bin": b, "value": s / n, "ends": (left_s / left_n, (s - left_s) / (n - left_n))}
        out[k] = best
    return out


def boosted_residual(rows: DataFrame, features: list[str], base: str, target: str) -> DataFrame:
    """RMSE by step before and after ROUNDS trees of depth DEPTH on the residual of ``base``."""
    probabilities = [(i + 1) / BINS for i in range(BINS - 1)]
    edges = rows.agg(*[F.percentile_approx(f, probabilities, 10000).alias(f) for f in features]).first()
    binned = [f"_b{i}" for i in range(len(features))]
    rows = rows.select("step", F.col(target).alias("_y"), F.col(base).alias("_base"), *[_bin(f, sorted(set(edges[f]))).alias(b) for f, b in zip(features, binned, strict=True)]).persist()
    made = F.lit(0.0)
    for _ in range(ROUNDS):
        current = rows.withColumn("_r", F.col("_y") - F.col("_base") - made)
        root = _grow(current, binned, F.lit(0), 0)[0]
        tree: dict = {"value": root["value"]}
        if "feature" in root:
            below = F.when(F.col(binned[root["feature"]]) <= root["bin"], 1).otherwise(2)
            level = _grow(current, binned, below, 1)
            ends = []
            for k in (1, 2):
                x = level.get(k, {"value": root["ends"][k - 1]})
                ends.append({"feature": x["feature"], "bin": x["bin"], "left": {"value": x["ends"][0]}, "right": {"value": x["ends"][1]}} if "feature" in x else {"value": x["value"]})
            tree = {"feature": root["feature"], "bin": root["bin"], "left": ends[0], "right": ends[1]}
        made = made + RATE * _tree(tree, binned)
    rmse = lambda e: F.sqrt(F.avg(F.pow(F.col("_y") - e, F.lit(2))))
    return rows.groupBy("step").agg(F.count("*").alias("n_rows"), rmse(F.col("_base")).alias("rmse_before"), rmse(F.col("_base") + made).alias("rmse_after"))


