"""Grouped figures: hourly means, scores, conformal widths, quantiles, moments."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import order_statistics as Q
from ..operators.inference import block_bootstrap, interval, paired_bootstrap
from .base import CLEAN, FRAME, LOG, SECONDS, clean, frame, log, query, since, table
from .windows import ANALOG_SQL, analog_features


@query(
    "hourly_mean_gate", "h n_samples", "mean_value",
    f"""x AS (SELECT CAST(floor({SECONDS} / 3600) AS BIGINT) AS h, value FROM events), res AS (SELECT h, count(value) AS n_samples, CASE WHEN count(value) >= 10 THEN avg(value) END AS mean_value FROM x GROUP BY h)""",
)
def hourly_mean_gate(spark, sf_dir):
    """A mean only where an hour has ten samples or more."""
    rows = table(spark, sf_dir, "events").select(since("HOUR").alias("h"), "value")
    return rows.groupBy("h").agg(F.count("value").alias("n_samples"), F.when(F.count("value") >= 10, F.avg("value")).alias("mean_value"))


@query(
    "latest_common_hour", "series common_h", "",
    f"""{FRAME}, res AS (SELECT series, least(max(CASE WHEN v IS NOT NULL THEN h END), max(CASE WHEN bz IS NOT NULL THEN h END), max(CASE WHEN dst IS NOT NULL THEN h END)) AS common_h FROM frame GROUP BY series)""",
)
def latest_common_hour(spark, sf_dir):
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col("h")))
    return frame(spark, sf_dir).groupBy("series").agg(F.least(last("v"), last("bz"), last("dst")).alias("common_h"))


@query(
    "arrival_bins", "bin n_rows digest", "median_value",
    f"""x AS (SELECT event_id, value, CAST(floor(({SECONDS} + 1500000.0 / (300 + 2 * value)) / 1800) AS BIGINT) AS bin FROM events WHERE event_type = 'view'),
res AS (SELECT bin, count(*) AS n_rows, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS digest, median(value) AS median_value FROM x GROUP BY bin)""",
)
def arrival_bins(spark, sf_dir):
    """Half-hour bins of arrival: the event time and the ballistic delay at the measured speed."""
    arrival = since("SECOND") + 1500000.0 / (300 + 2 * F.col("value"))
    rows = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "value", F.floor(arrival / 1800).alias("bin"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("bin").agg(F.count("*").alias("n_rows"), F.sha2(ids, 256).alias("digest"), F.median("value").alias("median_value"))


def scores(predicted: Column, observed: Column) -> list[Column]:
    """RMSE, MAE, correlation (null where degenerate), prediction efficiency and the number of rows."""
    d = observed - predicted
    mse, spread = F.avg(d * d), F.var_pop(observed)
    corr = F.when((F.var_pop(predicted) > 0) & (spread > 0), F.corr(predicted, observed))
    return [F.count("*").alias("n_points"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(d)).alias("mae"), corr.alias("corr"), (1 - F.try_divide(mse, spread)).alias("pe")]


@query(
    "score_table", "step regime n_points", "rmse mae corr pe",
    f"""{LOG}, x AS (SELECT *, CASE WHEN latest > -30 THEN 'quiet' ELSE 'disturbed' END AS regime FROM log WHERE obs IS NOT NULL),
res AS (SELECT coalesce(step, 0) AS step, coalesce(regime, 'all') AS regime, count(*) AS n_points, sqrt(avg((obs - burton) ** 2)) AS rmse, avg(abs(obs - burton)) AS mae, corr(burton, obs) AS corr, 1 - avg((obs - burton) ** 2) / var_pop(obs) AS pe
 FROM x GROUP BY GROUPING SETS ((), (step), (regime), (step, regime)))""",
)
def score_table(spark, sf_dir):
    """All scores by lead, by regime, by both and over all rows, in one pass."""
    rows = log(spark, sf_dir).where("obs is not null").withColumn("regime", P.activity("latest"))
    agg = rows.groupingSets([[], ["step"], ["regime"], ["step", "regime"]], "step", "regime").agg(*scores(F.col("burton"), F.col("obs")))
    return agg.withColumns({"step": F.coalesce("step", F.lit(0)), "regime": F.coalesce("regime", F.lit("all"))})


@query(
    "contingency", "step hits misses false_alarms correct_negatives", "pod precision far csi bias",
    f"""{LOG}, x AS (SELECT step, burton <= -50 AS f, obs <= -50 AS o FROM log WHERE obs IS NOT NULL),
c AS (SELECT step, count(*) FILTER (WHERE f AND o) AS hits, count(*) FILTER (WHERE NOT f AND o) AS misses, count(*) FILTER (WHERE f AND NOT o) AS false_alarms, count(*) FILTER (WHERE NOT f AND NOT o) AS correct_negatives FROM x GROUP BY step),
res AS (SELECT *, hits / nullif(hits + misses, 0) AS pod, hits / nullif(hits + false_alarms, 0) AS precision, false_alarms / nullif(hits + false_alarms, 0) AS far, hits / nullif(hits + misses + false_alarms, 0) AS csi, (hits + false_alarms) / nullif(hits + misses, 0) AS bias FROM c)""",
)
def contingency(spark, sf_dir):
    f, o = F.col("burton") <= -50, F.col("obs") <= -50
    count = lambda c: F.count_if(c)
    c = log(spark, sf_dir).where("obs is not null").groupBy("step").agg(count(f & o).alias("hits"), count(~f & o).alias("misses"), count(f & ~o).alias("false_alarms"), count(~f & ~o).alias("correct_negatives"))
    h, m, x = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return c.select("*", F.try_divide(h, h + m).alias("pod"), F.try_divide(h, h + x).alias("precision"), F.try_divide(x, h + x).alias("far"), F.try_divide(h, h + m + x).alias("csi"), F.try_divide(h + x, h + m).alias("bias"))


_BINS = "CASE WHEN step < 2 THEN 1 WHEN step < 4 THEN 2 ELSE 3 END"
_RESIDUALS = f"""{LOG}, r AS (SELECT {_BINS} AS bin, CASE WHEN latest > -30 THEN 'quiet' ELSE 'disturbed' END AS regime, CASE WHEN latest <= -100 THEN 'deep' WHEN latest <= -50 THEN 'moderate' ELSE 'shallow' END AS depth, step, abs(obs - burton) AS r FROM log WHERE obs IS NOT NULL)"""


def _residuals(spark, sf_dir):
    return log(spark, sf_dir).where("obs is not null").select(P.horizon_bin("step").alias("bin"), P.activity("latest").alias("regime"), P.depth("latest").alias("depth"), "step", F.abs(F.col("obs") - F.col("burton")).alias("r"))


@query(
    "conformal_fit", "bin regime n", "half_width coverage_floor",
    f"""{_RESIDUALS}, s AS (SELECT bin, regime, r FROM r UNION ALL SELECT 0, 'global', r FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY bin, regime ORDER BY r) AS i, count(*) OVER (PARTITION BY bin, regime) AS n FROM s),
res AS (SELECT bin, regime, n, r AS half_width, i / (n + 1) AS coverage_floor FROM k WHERE i = least(n, CAST(ceil((n + 1) * 0.9) AS BIGINT)))""",
)
def conformal_fit(spark, sf_dir):
    """Half-widths by lead bin and activity and over all: the ceil((n + 1) c)-th smallest residual."""
    return Q.conformal(_residuals(spark, sf_dir), ["bin", "regime"], "r", 0.9).select(F.coalesce("bin", F.lit(0)).alias("bin"), F.coalesce("regime", F.lit("global")).alias("regime"), "n", "half_width", "coverage_floor")


_FIT = f"""{_RESIDUALS}, s AS (SELECT bin, regime, r FROM r UNION ALL SELECT 0, 'global', r FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY bin, regime ORDER BY r) AS i, count(*) OVER (PARTITION BY bin, regime) AS n FROM s),
fit AS (SELECT bin, regime, n, r AS half_width FROM k WHERE i = least(n, CAST(ceil((n + 1) * 0.9) AS BIGINT)))"""


@query(
    "conformal_resolve", "bin regime", "half_width",
    f"""{_FIT}, q AS (SELECT DISTINCT bin, regime FROM fit WHERE bin > 0),
res AS (SELECT q.bin, q.regime, CASE WHEN any_value(own.n) >= 400 THEN any_value(own.half_width) ELSE greatest(any_value(g.half_width), max(f.half_width)) END AS half_width
 FROM q JOIN fit own ON own.bin = q.bin AND own.regime = q.regime JOIN fit g ON g.bin = 0 LEFT JOIN fit f ON f.bin BETWEEN 1 AND q.bin AND f.n >= 400 AND (f.regime = q.regime OR (q.regime = 'disturbed' AND f.regime = 'quiet')) GROUP BY ALL)""",
)
def conformal_resolve(spark, sf_dir):
    """The width that a query gets: its cell's if that has enough rows, else the widest of those it dominates."""
    cells = Q.conformal(_residuals(spark, sf_dir), ["bin", "regime"], "r", 0.9)
    return Q.monotone_width(cells, 400)


@query(
    "depth_conformal", "step depth n", "half_width",
    f"""{_RESIDUALS}, s AS (SELECT step, depth, r FROM r UNION ALL SELECT step, 'pooled', r FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY step, depth ORDER BY r) AS i, count(*) OVER (PARTITION BY step, depth) AS n FROM s),
f AS (SELECT step, depth, n, r AS half_width FROM k WHERE i = least(n, CAST(ceil((n + 1) * 0.9) AS BIGINT))),
res AS (SELECT f.step, f.depth, f.n, CASE WHEN f.n >= 20 THEN f.half_width ELSE p.half_width END AS half_width FROM f JOIN f p ON p.step = f.step AND p.depth = 'pooled')""",
)
def depth_conformal(spark, sf_dir):
    """Widths by lead and depth; a small cell takes the width of all depths of its lead."""
    rows = _residuals(spark, sf_dir)
    both = rows.select("step", F.explode(F.array("depth", F.lit("pooled"))).alias("depth"), "r")
    cells = Q.kth_smallest(both, ["step", "depth"], "r", 0.9)
    pooled = cells.where("depth = 'pooled'").select("step", F.col("half_width").alias("wide"))
    return cells.join(F.broadcast(pooled), "step").select("step", "depth", "n", F.when(F.col("n") >= 20, F.col("half_width")).otherwise(F.col("wide")).alias("half_width"))


@query(
    "interval_coverage", "step regime n_rows", "coverage",
    f"""{LOG}, x AS (SELECT step, CASE WHEN latest > -30 THEN 'quiet' ELSE 'disturbed' END AS regime, CASE WHEN obs IS NOT NULL THEN CASE WHEN abs(obs - burton) <= 25 THEN 1.0 ELSE 0.0 END END AS c FROM log),
res AS (SELECT step, regime, count(*) AS n_rows, avg(c) AS coverage FROM x GROUP BY ALL)""",
)
def interval_coverage(spark, sf_dir):
    """Coverage over rows that could be observed; others are neither hits nor misses."""
    covered = (F.abs(F.col("obs") - F.col("burton")) <= 25).cast("double")
    return log(spark, sf_dir).groupBy("step", P.activity("latest").alias("regime")).agg(F.count("*").alias("n_rows"), F.avg(covered).alias("coverage"))


@query(
    "quantiles", "step", "q05 q50 q95 rank_q90",
    f"""{LOG}, d AS (SELECT step, obs - burton AS d FROM log WHERE obs IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY d) AS i, count(*) OVER (PARTITION BY step) AS n FROM d),
res AS (SELECT step, quantile_cont(d, 0.05) AS q05, quantile_cont(d, 0.5) AS q50, quantile_cont(d, 0.95) AS q95, max(CASE WHEN i = ceil(0.9 * n) THEN d END) AS rank_q90 FROM k GROUP BY step)""",
)
def quantiles(spark, sf_dir):
    """Interpolated quantiles, and the ceil(q n)-th value."""
    rows = log(spark, sf_dir).where("obs is not null").select("step", (F.col("obs") - F.col("burton")).alias("d"))
    q = lambda x: F.percentile("d", F.lit(x))
    smooth = rows.groupBy("step").agg(q(0.05).alias("q05"), q(0.5).alias("q50"), q(0.95).alias("q95"))
    return smooth.join(Q.rank_quantile(rows, ["step"], "d", 0.9, "rank_q90"), "step")


_FEATURES = "bz_mean bz_sd bperp_mean log_n_mean vbs_mean v_change dst_1".split()


@query(
    "standardised", "series h", " ".join(_FEATURES),
    f"""{ANALOG_SQL}, m AS (SELECT {", ".join(f"avg({c}) AS {c}_m, greatest(stddev_samp({c}), 1e-9) AS {c}_s" for c in _FEATURES)} FROM features), res AS (SELECT series, h, {", ".join(f"({c} - {c}_m) / {c}_s AS {c}" for c in _FEATURES)} FROM features, m)""",
)
def standardised(spark, sf_dir):
    rows = analog_features(clean(spark, sf_dir))
    # one row of figures, brought to the driver as literals
    m = rows.agg(*[F.avg(c).alias(f"{c}_m") for c in _FEATURES], *[F.greatest(F.stddev_samp(c), F.lit(1e-9)).alias(f"{c}_s") for c in _FEATURES]).first()
    return rows.select("series", "h", *[((F.col(c) - m[f"{c}_m"]) / m[f"{c}_s"]).alias(c) for c in _FEATURES])


@query(
    "block_sse", "step block n_rows", "sse_burton sse_persistence",
    f"""{LOG}, res AS (SELECT step, issue_h // 168 AS block, count(*) AS n_rows, sum((obs - burton) ** 2) AS sse_burton, sum((obs - persistence) ** 2) AS sse_persistence FROM log WHERE obs IS NOT NULL GROUP BY ALL)""",
)
def block_sse(spark, sf_dir):
    sse = lambda c: F.sum(F.pow(F.col("obs") - F.col(c), F.lit(2)))
    rows = log(spark, sf_dir).where("obs is not null")
    return rows.groupBy("step", F.floor(F.col("issue_h") / 168).alias("block")).agg(F.count("*").alias("n_rows"), sse("burton").alias("sse_burton"), sse("persistence").alias("sse_persistence"))


@query(
    "inclusion_figures", "label n_draws", "inclusion median_nonzero q025 q975",
    """x AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS c FROM embeddings), y AS (SELECT label, CASE WHEN abs(c) > 0.05 THEN c ELSE 0.0 END AS c FROM x),
res AS (SELECT label, count(*) AS n_draws, avg(CASE WHEN c <> 0 THEN 1.0 ELSE 0.0 END) AS inclusion, median(c) FILTER (WHERE c <> 0) AS median_nonzero, quantile_cont(c, 0.025) FILTER (WHERE c <> 0) AS q025, quantile_cont(c, 0.975) FILTER (WHERE c <> 0) AS q975 FROM y GROUP BY label)""",
)
def inclusion_figures(spark, sf_dir):
    """How often a coefficient is kept over the draws of an ensemble, and its quantiles where it is."""
    c = F.get("embedding", F.lit(0)).cast("double")
    rows = table(spark, sf_dir, "embeddings").select("label", F.when(F.abs(c) > 0.05, c).otherwise(0.0).alias("c"))
    kept = F.when(F.col("c") != 0, F.col("c"))
    return rows.groupBy("label").agg(F.count("*").alias("n_draws"), F.avg((F.col("c") != 0).cast("double")).alias("inclusion"), F.median(kept).alias("median_nonzero"), F.percentile(kept, F.lit(0.025)).alias("q025"), F.percentile(kept, F.lit(0.975)).alias("q975"))


@query(
    "moments", "a b n_rows", "product",
    f"""{CLEAN}, t AS (SELECT 1.0 AS one, v, bs, dst_star, v * bs AS v_bs FROM clean WHERE quality = 1),
res AS ({" UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, count(*) AS n_rows, avg({x} * {y}) AS product FROM t" for i, x in enumerate(("one", "v", "bs", "dst_star", "v_bs")) for y in ("one", "v", "bs", "dst_star", "v_bs")[i:])})""",
)
def moments(spark, sf_dir):
    """Second moments of model terms: what every least-squares fit needs, from one pass."""
    names = ["one", "v", "bs", "dst_star", "v_bs"]
    rows = clean(spark, sf_dir).where("quality = 1").select(F.lit(1.0).alias("one"), "v", "bs", "dst_star", (F.col("v") * F.col("bs")).alias("v_bs"))
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i:]]
    wide = rows.agg(F.count("*").alias("n_rows"), *[F.avg(F.col(x) * F.col(y)).alias(f"{x}|{y}") for x, y in pairs])
    long = F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{x}|{y}`").alias("product")) for x, y in pairs]))
    return wide.select("n_rows", long.alias("m")).select("n_rows", "m.*")


@query(
    "source_summary", "event_type n_rows n_scored n_hours", "rmse",
    f"""x AS (SELECT event_type, CAST(floor({SECONDS} / 3600) AS BIGINT) AS h, value, CASE WHEN event_id % 4 <> 0 THEN value - 15 END AS e FROM events),
res AS (SELECT event_type, count(*) AS n_rows, count(e) AS n_scored, count(DISTINCT h) AS n_hours, sqrt(avg(e * e)) AS rmse FROM x GROUP BY event_type)""",
)
def source_summary(spark, sf_dir):
    e = F.when(F.col("event_id") % 4 != 0, F.col("value") - 15)
    rows = table(spark, sf_dir, "events").select("event_type", since("HOUR").alias("h"), e.alias("e"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count("e").alias("n_scored"), F.count_distinct("h").alias("n_hours"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


@query(
    "cadence", "event_type n_gaps", "median_seconds",
    f"""x AS (SELECT event_type, user_id % 8 AS g, {SECONDS} AS s, event_id FROM events), d AS (SELECT event_type, s - lag(s) OVER (PARTITION BY event_type, g ORDER BY s, event_id) AS d FROM x),
res AS (SELECT event_type, count(d) AS n_gaps, median(d) AS median_seconds FROM d GROUP BY event_type)""",
)
def cadence(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 8).alias("g"), since("SECOND").alias("s"), "event_id")
    d = F.col("s") - F.lag("s").over(Window.partitionBy("event_type", "g").orderBy("s", "event_id"))
    return rows.select("event_type", d.alias("d")).groupBy("event_type").agg(F.count("d").alias("n_gaps"), F.median("d").alias("median_seconds"))


_STORMS = """s AS (SELECT l_suppkey AS storm, sqrt(avg(l_discount * l_discount)) - sqrt(avg(l_tax * l_tax)) AS d FROM lineitem GROUP BY 1), n AS (SELECT storm, d, row_number() OVER (ORDER BY storm) - 1 AS i, count(*) OVER () AS n FROM s),
p AS (SELECT draw, slot, ((draw * 7919 + slot * 104729 + (draw * slot) % 613) * 31 + 17) % n AS pick FROM range(10000) a(draw), (SELECT i AS slot, n FROM n)),
res AS (SELECT draw, count(*) AS n_storms, median(d) AS median_difference FROM p JOIN n ON n.i = p.pick GROUP BY draw)"""

_BLOCKS = f"""{LOG}, b AS (SELECT issue_h // 168 AS block, sum((obs - burton) ** 2) AS a, sum((obs - persistence) ** 2) AS p, count(*) AS m FROM log WHERE obs IS NOT NULL AND step = 1 GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS n FROM b),
p AS (SELECT draw, ((draw * 7919 + slot * 104729 + (draw * slot) % 613) * 31 + 17) % n AS pick FROM range(10000) t(draw), (SELECT i AS slot, n FROM n)),
res AS (SELECT draw, sqrt(sum(n.p) / sum(m)) - sqrt(sum(a) / sum(m)) AS gain FROM p JOIN n ON n.i = p.pick GROUP BY draw)"""


def _interval_sql(draws: str, gain: str) -> str:
    return f"""{draws.replace("res AS", "drawn AS")},
res AS (SELECT count(*) AS draws, quantile_cont({gain}, 0.5) AS median, quantile_cont({gain}, 0.025) AS low, quantile_cont({gain}, 0.975) AS high, (count(*) FILTER (WHERE {gain} <= 0) + 1) / (count(*) + 1) AS p FROM drawn)"""


@query(
    "storm_bootstrap", "draw n_storms", "median_difference",
    _STORMS,
)
def storm_bootstrap(spark, sf_dir):
    """Medians of paired differences over whole storms drawn again; draws come from a formula, so they can be repeated."""
    return _storm_draws(spark, sf_dir, 10_000)


@query("storm_bootstrap_interval", "draws", "median low high p", _interval_sql(_STORMS, "median_difference"))
def storm_bootstrap_interval(spark, sf_dir):
    return interval(_storm_draws(spark, sf_dir, 10_000), "median_difference")


def _storm_draws(spark, sf_dir, draws):
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    storms = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("storm")).agg((rms("l_discount") - rms("l_tax")).alias("d"))
    return paired_bootstrap(storms, "storm", "d", draws)


@query(
    "block_bootstrap", "draw", "gain",
    _BLOCKS,
)
def block_gain(spark, sf_dir):
    """RMSE gain over persistence in week-long blocks drawn again."""
    return _block_draws(spark, sf_dir, 10_000)


@query("block_bootstrap_interval", "draws", "median low high p", _interval_sql(_BLOCKS, "gain"))
def block_bootstrap_interval(spark, sf_dir):
    return interval(_block_draws(spark, sf_dir, 10_000), "gain")


def _block_draws(spark, sf_dir, draws):
    sse = lambda c: F.sum(F.pow(F.col("obs") - F.col(c), F.lit(2)))
    rows = log(spark, sf_dir).where("obs is not null and step = 1")
    blocks = rows.groupBy(F.floor(F.col("issue_h") / 168).alias("block")).agg(sse("burton").alias("a"), sse("persistence").alias("p"), F.count("*").alias("m"))
    return block_bootstrap(blocks, "block", "a", "p", "m", draws)
