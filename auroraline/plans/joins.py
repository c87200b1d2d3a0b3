"""Join semantics: by equal hours, by nearness, by interval, with fallbacks, and checks of sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import asof, gaps
from ..operators.analog import nearest_neighbours
from .base import CLEAN, FRAME, KEYS, LOG, SECONDS, clean, frame, log, query, since, table
from .windows import W


@query(
    "three_hour_join", "series bin n_hours level", "kp mean_dst",
    f"""{CLEAN}, k AS (SELECT series, h // 3 AS bin, max(bs) / 3 AS kp FROM clean GROUP BY ALL), d AS (SELECT series, h // 3 AS bin, count(dst) AS n_hours, avg(dst) AS mean_dst FROM clean GROUP BY ALL HAVING count(dst) > 0),
res AS (SELECT d.series, d.bin, n_hours, CASE WHEN kp >= 9 THEN 5 WHEN kp >= 8 THEN 4 WHEN kp >= 7 THEN 3 WHEN kp >= 6 THEN 2 WHEN kp >= 5 THEN 1 ELSE 0 END AS level, kp, mean_dst FROM d JOIN k ON k.series = d.series AND k.bin = d.bin)""",
)
def three_hour_join(spark, sf_dir):
    rows = clean(spark, sf_dir).withColumn("bin", F.floor(F.col("h") / 3))
    kp = rows.groupBy("series", "bin").agg((F.max("bs") / 3).alias("kp"))
    dst = rows.groupBy("series", "bin").agg(F.count("dst").alias("n_hours"), F.avg("dst").alias("mean_dst")).where("n_hours > 0")
    return dst.join(kp, ["series", "bin"]).withColumn("level", P.g_level("kp"))


@query(
    "anchor_lookup", "event_id", "dst",
    f"""{FRAME}, res AS (SELECT event_id, f.dst FROM (SELECT event_id, user_id % 2 AS series, CAST(floor({SECONDS} / 3600) AS BIGINT) AS h FROM events WHERE event_type = 'click') c LEFT JOIN frame f ON f.series = c.series AND f.h = c.h)""",
)
def anchor_lookup(spark, sf_dir):
    """The hourly index of each sample's hour."""
    samples = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", (F.col("user_id") % 2).alias("series"), since("HOUR").alias("h"))
    return samples.join(frame(spark, sf_dir).select("series", "h", "dst"), ["series", "h"], "left")


@query(
    "complete_history", "series h", "",
    f"""{FRAME}, x AS (SELECT series, h, count(dst) OVER ({W} RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS n FROM frame), res AS (SELECT series, h FROM x WHERE n = 7)""",
)
def complete_history(spark, sf_dir):
    past = gaps.ordered(KEYS).rangeBetween(-7, -1)
    return frame(spark, sf_dir).withColumn("n", F.count("dst").over(past)).where("n = 7")


@query(
    "nearest_click", "event_id r_s r_event_id", "",
    f"""x AS (SELECT event_id, event_type, user_id % 16 AS g, {SECONDS} AS s FROM events), a AS (SELECT * FROM x WHERE event_type = 'error'), b AS (SELECT * FROM x WHERE event_type = 'click'),
p AS (SELECT a.event_id, b.s AS r_s, b.event_id AS r_event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.s - a.s), b.s, b.event_id) AS k FROM a JOIN b ON a.g = b.g AND b.s BETWEEN a.s - 1800 AND a.s + 1800),
res AS (SELECT a.event_id, r_s, r_event_id FROM a LEFT JOIN (SELECT * FROM p WHERE k = 1) q USING (event_id))""",
)
def nearest_click(spark, sf_dir):
    """The click nearest to each error within half an hour, the earlier one of two."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 16).alias("g"), since("SECOND").alias("s"))
    left = rows.where("event_type = 'error'").drop("event_type")
    right = rows.where("event_type = 'click'").groupBy("g", "s").agg(F.min("event_id").alias("event_id"))
    return asof.nearest(left, right, ["g"], "event_id", "s", 1800)


@query(
    "speed_around", "event_id", "back ahead",
    f"""x AS (SELECT event_id, event_type, user_id % 16 AS g, {SECONDS} AS s, value FROM events), a AS (SELECT * FROM x WHERE event_type = 'click'), b AS (SELECT g, s, max(value) AS value FROM x WHERE event_type = 'view' GROUP BY ALL),
res AS (SELECT a.event_id, p.value AS back, q.value AS ahead FROM a ASOF LEFT JOIN b p ON a.g = p.g AND a.s >= p.s ASOF LEFT JOIN b q ON a.g = q.g AND a.s <= q.s)""",
)
def speed_around(spark, sf_dir):
    """The speed before and after each field sample."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 16).alias("g"), F.floor(since("MICROSECOND") / 1_000_000).alias("s"), "value")
    speeds = rows.where("event_type = 'view'").groupBy("g", "s").agg(F.max("value").alias("value"))
    return asof.backward_forward(rows.where("event_type = 'click'").select("event_id", "g", "s"), speeds, ["g"], "s", "value")


@query(
    "rows_in_gaps", "series first n_clicks", "mean_value",
    f"""{FRAME}, m AS (SELECT series, h, h - row_number() OVER ({W}) AS run FROM frame WHERE dst IS NULL), g AS (SELECT series, min(h) AS first, max(h) AS last FROM m GROUP BY series, run),
c AS (SELECT user_id % 2 AS series, CAST(floor({SECONDS} / 3600) AS BIGINT) AS h, value FROM events WHERE event_type = 'click'),
res AS (SELECT g.series, first, count(*) AS n_clicks, avg(value) AS mean_value FROM c JOIN g ON c.series = g.series AND c.h BETWEEN g.first AND g.last GROUP BY ALL)""",
)
def rows_in_gaps(spark, sf_dir):
    """Samples inside each outage of the index: points joined to intervals."""
    outages = gaps.islands(frame(spark, sf_dir), F.col("dst").isNull(), KEYS)
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select((F.col("user_id") % 2).alias("series"), since("HOUR").alias("h"), "value")
    return asof.in_intervals(clicks, outages, KEYS, "h").groupBy("series", "first").agg(F.count("*").alias("n_clicks"), F.avg("value").alias("mean_value"))


@query(
    "nearest_analogs", "query_id rank vec_id", "distance",
    """q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT query_id, vec_id, sqrt(list_sum([(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) ** 2 FOR x, i IN e FOR y IN [embedding[i]]])) AS distance FROM q, embeddings WHERE abs(vec_id - query_id) >= 16)
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM p), res AS (SELECT * FROM r WHERE rank <= 25)""".replace(
        "list_sum([(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) ** 2 FOR x, i IN e FOR y IN [embedding[i]]])", "list_sum(list_transform(range(1, len(e) + 1), lambda i: (CAST(e[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)) ** 2))"
    ),
)
def nearest_analogs(spark, sf_dir):
    """The 25 nearest vectors of each stated query, none closer in time than 16; ties go to the smaller id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 25, 16)


@query(
    "fallback_lookup", "series issue_h step source", "weight",
    f"""{LOG}, x AS (SELECT *, CASE WHEN latest > -30 THEN 'quiet' ELSE 'disturbed' END AS regime, CASE WHEN latest <= -100 THEN 'deep' WHEN latest <= -50 THEN 'moderate' ELSE 'shallow' END AS depth FROM log),
c AS (SELECT step, regime, depth, count(*) AS n, avg(burton - persistence) AS w FROM x GROUP BY CUBE (step, regime, depth)),
a AS (SELECT * FROM c WHERE step IS NOT NULL AND regime IS NOT NULL AND depth IS NOT NULL AND n >= 40), b AS (SELECT * FROM c WHERE step IS NOT NULL AND regime IS NOT NULL AND depth IS NULL AND n >= 200), d AS (SELECT * FROM c WHERE step IS NOT NULL AND regime IS NULL AND depth IS NULL),
res AS (SELECT x.series, x.issue_h, x.step, CASE WHEN a.w IS NOT NULL THEN 'cell' WHEN b.w IS NOT NULL THEN 'regime' ELSE 'pooled' END AS source, coalesce(a.w, b.w, d.w) AS weight
 FROM x LEFT JOIN a ON a.step = x.step AND a.regime = x.regime AND a.depth = x.depth LEFT JOIN b ON b.step = x.step AND b.regime = x.regime LEFT JOIN d ON d.step = x.step)""",
)
def fallback_lookup(spark, sf_dir):
    """The weight of a row's cell, else of its regime, else of its lead; one pass makes all levels."""
    rows = log(spark, sf_dir).withColumns({"regime": P.activity("latest"), "depth": P.depth("latest")})
    levels = rows.groupingSets([["step", "regime", "depth"], ["step", "regime"], ["step"]], "step", "regime", "depth").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg(F.col("burton") - F.col("persistence")).alias("w"))
    # at most leads * regimes * depths rows
    cell = levels.where("g = 0 and n >= 40").select("step", "regime", "depth", F.col("w").alias("w0"))
    regime = levels.where("g = 1 and n >= 200").select("step", "regime", F.col("w").alias("w1"))
    pooled = levels.where("g = 3").select("step", F.col("w").alias("w2"))
    joined = rows.join(F.broadcast(cell), ["step", "regime", "depth"], "left").join(F.broadcast(regime), ["step", "regime"], "left").join(F.broadcast(pooled), "step", "left")
    source = F.when(F.col("w0").isNotNull(), "cell").when(F.col("w1").isNotNull(), "regime").otherwise("pooled")
    return joined.select("series", "issue_h", "step", source.alias("source"), F.coalesce("w0", "w1", "w2").alias("weight"))


@query(
    "paired_sets", "side n_ids", "",
    """a AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'N' AND l_discount > 0.02),
res AS (SELECT CASE WHEN a.id IS NULL THEN 'reference_only' WHEN b.id IS NULL THEN 'model_only' ELSE 'both' END AS side, count(*) AS n_ids FROM a FULL JOIN b ON a.id = b.id GROUP BY 1)""",
)
def paired_sets(spark, sf_dir):
    """Storms that both result sets have, and those that only one has."""
    rows = table(spark, sf_dir, "lineitem")
    a = rows.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("a")).distinct()
    b = rows.where("l_returnflag = 'N' and l_discount > 0.02").select(F.col("l_suppkey").alias("b")).distinct()
    side = F.when(F.col("a").isNull(), "reference_only").when(F.col("b").isNull(), "model_only").otherwise("both")
    return a.join(b, F.col("a") == F.col("b"), "full").groupBy(side.alias("side")).agg(F.count("*").alias("n_ids"))


@query(
    "same_row_cohort", "step n_rows", "rmse_burton rmse_obrien",
    f"""{LOG}, c AS (SELECT series, issue_h FROM log WHERE obs IS NOT NULL GROUP BY ALL HAVING count(*) = 4),
res AS (SELECT step, count(*) AS n_rows, sqrt(avg((obs - burton) ** 2)) AS rmse_burton, sqrt(avg((obs - obrien) ** 2)) AS rmse_obrien FROM log SEMI JOIN c USING (series, issue_h) GROUP BY step)""",
)
def same_row_cohort(spark, sf_dir):
    """Skill over issue hours for which every lead has been verified."""
    rows = log(spark, sf_dir)
    whole = rows.where("obs is not null").groupBy("series", "issue_h").count().where("count = 4")
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col("obs") - F.col(c), F.lit(2))))
    return rows.join(whole, ["series", "issue_h"], "left_semi").groupBy("step").agg(F.count("*").alias("n_rows"), rmse("burton").alias("rmse_burton"), rmse("obrien").alias("rmse_obrien"))


@query(
    "truth_join", "series status n_rows", "",
    f"""{LOG}, res AS (SELECT series, CASE WHEN obs IS NOT NULL THEN 'verified' WHEN target_h > 719 THEN 'pending' ELSE 'missing' END AS status, count(*) AS n_rows FROM log GROUP BY ALL)""",
)
def truth_join(spark, sf_dir):
    status = F.when(F.col("obs").isNotNull(), "verified").when(F.col("target_h") > 719, "pending").otherwise("missing")
    return log(spark, sf_dir).groupBy("series", status.alias("status")).agg(F.count("*").alias("n_rows"))


@query(
    "receipt_pairs", "g m click_id view_id", "",
    f"""x AS (SELECT event_id, event_type, user_id % 4 AS g, CAST(floor({SECONDS} / 600) AS BIGINT) AS m, {SECONDS} + event_id % 900 AS received FROM events),
a AS (SELECT g, m, arg_max(event_id, (received, event_id)) AS click_id FROM x WHERE event_type = 'click' AND received <= 2000000 GROUP BY ALL), b AS (SELECT g, m, arg_max(event_id, (received, event_id)) AS view_id FROM x WHERE event_type = 'view' AND received <= 2000000 GROUP BY ALL),
res AS (SELECT a.g, a.m, click_id, view_id FROM a JOIN b ON a.g = b.g AND a.m = b.m)""",
)
def receipt_pairs(spark, sf_dir):
    """Field and plasma receipts of one measurement time, the last of each that had come by the cutoff."""
    x = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 4).alias("g"), F.floor(since("SECOND") / 600).alias("m"), (since("SECOND") + F.col("event_id") % 900).alias("received")).where("received <= 2000000")
    last = lambda kind, to: x.where(F.col("event_type") == kind).groupBy("g", "m").agg(F.max_by("event_id", F.struct("received", "event_id")).alias(to))
    return last("click", "click_id").join(last("view", "view_id"), ["g", "m"])


@query(
    "newer_wins", "g m event_id", "value",
    f"""x AS (SELECT event_id, user_id % 4 AS g, CAST(floor({SECONDS} / 3600) AS BIGINT) AS m, value, event_id % 3 = 0 AS fetched FROM events WHERE event_type = 'signup'),
res AS (SELECT g, m, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY g, m ORDER BY fetched DESC, event_id DESC) AS k FROM x) WHERE k = 1)""",
)
def newer_wins(spark, sf_dir):
    """Fetched and cached rows of one key: a fetched one wins, then the later one."""
    x = table(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", (F.col("user_id") % 4).alias("g"), F.floor(since("SECOND") / 3600).alias("m"), "value")
    fetched, cached = (x.where(c).withColumn("fetched", F.lit(f)) for c, f in (("event_id % 3 = 0", 1), ("event_id % 3 <> 0", 0)))
    best = fetched.unionByName(cached).groupBy("g", "m").agg(F.max_by(F.struct("event_id", "value"), F.struct("fetched", "event_id")).alias("b"))
    return best.select("g", "m", "b.*")
