"""Text archives and observatory documents, the replay of storms, the warm start of a monitor, direct trees, and truth that never comes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import physics as P
from ..operators import folds
from ..operators.scratch import folder
from ..operators.trees import DirectTrees
from ..sources import archives
from ..streaming import live
from . import registry
from .base import CLEAN, FRAME, KEYS, LOG, SECONDS, START, clean, frame, log, query, since, table
from .folds import sparse_rate, storm_sessions
from .realtime import _rate_sql
from .windows import lag_ladder


def _seconds(c: str):
    return F.expr(f"timestampdiff(SECOND, timestamp'{START}', {c})")


def _spoken(words: dict[int, object], n: int):
    """A line of n words, those that are not given being 0."""
    return F.concat_ws(" ", *[words.get(k, F.lit("0")) for k in range(1, n + 1)])


@query(
    "model_index_scan", "event_second", "dst",
    f"x AS (SELECT {SECONDS} AS s, value, event_id % 5 AS k FROM events WHERE event_type = 'error'), res AS (SELECT s AS event_second, -value AS dst FROM x WHERE k <> 0)",
)
def model_index_scan(spark, sf_dir):
    """Lines with the day of the year; every fifth one is cut off before its value."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    line = F.concat(F.date_format("ts", "  yyyy/DDD-HH:mm:ss  "), F.when(F.col("event_id") % 5 == 0, "").otherwise((-F.col("value")).cast("string")))
    return archives.parse_model_index(rows.select(line.alias("value"))).select(_seconds("valid_at").alias("event_second"), "dst")


@query(
    "kp_table_scan", "h ap definitive", "kp",
    f"""{FRAME}, m AS (SELECT h // 24 AS d, (h % 24) // 3 * 3 AS bin, max(round(greatest(-bz, 0.0) / 3 + 2.3e-8, 2)) AS kp FROM frame WHERE bz IS NOT NULL GROUP BY ALL),
res AS (SELECT d * 24 + bin AS h, CAST(floor(kp * 4) AS INTEGER) AS ap, CAST(d % 3 AS INTEGER) AS definitive, kp FROM m)""",
)
def kp_table_scan(spark, sf_dir):
    """A line a day with eight values and eight amplitudes, fills for missing bins, and comments between them."""
    rows = frame(spark, sf_dir).where("bz is not null")
    d, kp = F.floor(F.col("h") / 24).alias("d"), F.round(F.greatest(-F.col("bz"), F.lit(0.0)) / 3 + 2.3e-8, 2)
    bins = [F.max(F.when(F.floor(F.col("h") % 24 / 3) == i, kp)).alias(f"k{i}") for i in range(8)]
    days = rows.groupBy(d).agg(*bins).withColumn("day", F.expr(f"date_add(date'{START[:10]}', cast(d as int))"))
    words = {1: F.date_format("day", "yyyy"), 2: F.date_format("day", "MM"), 3: F.date_format("day", "dd"), archives.DEFINITIVE_WORD: (F.col("d") % 3).cast("string")}
    for i in range(8):
        words[archives.KP_WORD + i] = F.coalesce(F.col(f"k{i}"), F.lit(-1.0)).cast("string")
        words[archives.AP_WORD + i] = F.coalesce(F.floor(F.col(f"k{i}") * 4), F.lit(-1)).cast("string")
    lines = days.select(F.explode(F.array(F.lit("# a comment"), F.lit(""), _spoken(words, 28))).alias("value"))
    return archives.parse_kp_table(lines).select((_seconds("valid_at") / 3600).cast("long").alias("h"), "ap", "definitive", "kp")


@query(
    "minute_archive_scan", "arrival_second measured_second", "v bz by_gsm n pdyn",
    f"""x AS (SELECT {SECONDS} // 60 * 60 AS s, event_id AS i, value FROM events WHERE event_type = 'view'),
res AS (SELECT s AS arrival_second, CASE WHEN i % 4 = 0 THEN s ELSE s - i % 3000 END AS measured_second, CASE WHEN i % 7 <> 1 THEN 300 + value END AS v, CASE WHEN i % 7 <> 2 THEN 6 - value / 4 END AS bz,
 CASE WHEN i % 7 <> 3 THEN value - 10 END AS by_gsm, CASE WHEN i % 7 <> 4 THEN value / 8 END AS n, CASE WHEN i % 7 <> 5 THEN value / 16 END AS pdyn FROM x WHERE i % 11 <> 0)""",
)
def minute_archive_scan(spark, sf_dir):
    """Lines of 28 words with fills; every eleventh is short."""
    rows = table(spark, sf_dir, "events").where("event_type = 'view'")
    i, value = F.col("event_id"), F.col("value")
    cell = lambda k, fill, x: F.when(i % 7 == k, fill).otherwise(x.cast("string"))
    words = {1: F.date_format("ts", "yyyy"), 2: F.date_format("ts", "DDD"), 3: F.date_format("ts", "HH"), 4: F.date_format("ts", "mm"), 10: F.when(i % 4 == 0, "999999").otherwise((i % 3000).cast("string")),
             18: cell(3, "9999.99", value - 10), 19: cell(2, "9999.99", 6 - value / 4), 22: cell(1, "99999.9", 300 + value), 26: cell(4, "999.99", value / 8), 28: cell(5, "99.99", value / 16)}
    line = F.when(i % 11 == 0, _spoken(words, 20)).otherwise(_spoken(words, 28))
    parsed = archives.parse_minutes(rows.select(line.alias("value")))
    return parsed.select(_seconds("arrives_at").alias("arrival_second"), _seconds("measured_at").alias("measured_second"), "v", "bz", "by_gsm", "n", "pdyn")


@query(
    "observatory_scan", "station s", "rate",
    f"""x AS (SELECT user_id % 3 AS station, {SECONDS} AS s, max(value) AS x, min(value) AS y FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
p AS (SELECT *, lag(s) OVER o AS ps, lag(x) OVER o AS px, lag(y) OVER o AS py FROM x WHERE (s // 3600) % 17 <> 5 WINDOW o AS (PARTITION BY station ORDER BY s)),
res AS (SELECT station, s, sqrt((x - px) ** 2 + (y - py) ** 2) / ((s - ps) / 60.0) AS rate FROM p WHERE ps IS NOT NULL)""",
)
def observatory_scan(spark, sf_dir):
    """A document for each station and hour, some without one component, read into samples and rates."""
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'view')").withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    samples = rows.groupBy((F.col("user_id") % 3).alias("station"), F.floor(since("SECOND") / 3600).alias("hour"), "at").agg(F.max("value").alias("x"), F.min("value").alias("y"))
    whole = samples.groupBy("station", "hour").agg(F.sort_array(F.collect_list(F.struct("at", "x", "y"))).alias("r"))
    element = lambda name, c: F.struct(F.struct(F.lit(name).alias("element")).alias("metadata"), F.col(f"r.{c}").alias("values"))
    values = F.when(F.col("hour") % 17 == 5, F.array(element("X", "x"))).otherwise(F.array(element("X", "x"), element("Y", "y")))
    documents = whole.select("station", F.to_json(F.struct(F.col("r.at").alias("times"), values.alias("values"))).alias("value"))
    return archives.field_rates(archives.parse_observatory(documents, ["station"]), ["station"]).select("station", _seconds("at").alias("s"), "rate")


_SESSIONS = registry.ORACLES["storm_sessions"].partition("\nSELECT")[0].partition(FRAME)[2]
_STORMS = _SESSIONS.partition("x AS (SELECT series, h, -dst AS p")[2].replace("res AS", "storms AS")


@query(
    "api_storm_replay", "series first last n_scored", "rmse_burton rmse_obrien rmse_persistence",
    f"""{LOG}, x AS (SELECT series, h, -dst AS p{_STORMS},
res AS (SELECT s.series, s.first, s.last, count(*) AS n_scored, sqrt(avg((burton - obs) ** 2)) AS rmse_burton, sqrt(avg((obrien - obs) ** 2)) AS rmse_obrien, sqrt(avg((persistence - obs) ** 2)) AS rmse_persistence
 FROM storms s JOIN log ON log.series = s.series AND target_h BETWEEN s.first AND s.last WHERE obs IS NOT NULL GROUP BY ALL)""",
)
def api_storm_replay(spark, sf_dir):
    """Scored forecasts of each storm; the hours of a storm are exploded, so the join is one of equal hours."""
    hours = storm_sessions(spark, sf_dir).select("series", "first", "last", F.explode(F.sequence("first", "last")).alias("target_h"))
    scored = log(spark, sf_dir).where("obs is not null").join(hours, ["series", "target_h"])
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("obs"), F.lit(2)))).alias(f"rmse_{c}")
    return scored.groupBy("series", "first", "last").agg(F.count("*").alias("n_scored"), rmse("burton"), rmse("obrien"), rmse("persistence"))


_STEP = f"least(greatest(sim.state + {_rate_sql('sim.state').replace('v * bs', 'g.v * g.bs')}, -2000.0), 50.0)"


@query(
    "warm_start", "series from_h last_h anchored", "state forecast",
    f"""RECURSIVE {CLEAN}, r AS (SELECT series, h, v, bs, dst_star, h - row_number() OVER (PARTITION BY series ORDER BY h) AS run FROM clean WHERE v IS NOT NULL AND bz IS NOT NULL),
t AS (SELECT r.* FROM r JOIN (SELECT series, max(run) AS run FROM r GROUP BY series) USING (series, run)),
a AS (SELECT series, coalesce(min(h) FILTER (WHERE dst_star IS NOT NULL), min(h)) AS from_h, count(dst_star) > 0 AS anchored, max(h) AS last_h FROM t GROUP BY series),
g AS (SELECT series, h, from_h, last_h, anchored, dst_star, lag(v) OVER (PARTITION BY series ORDER BY h) AS v, lag(bs) OVER (PARTITION BY series ORDER BY h) AS bs FROM t JOIN a USING (series)),
sim AS (SELECT series, h, from_h, last_h, anchored, coalesce(dst_star, 0.0) AS state, CAST(NULL AS DOUBLE) AS forecast FROM g WHERE h = from_h
 UNION ALL SELECT g.series, g.h, g.from_h, g.last_h, g.anchored, coalesce(g.dst_star, {_STEP}), {_STEP} FROM sim JOIN g ON g.series = sim.series AND g.h = sim.h + 1),
res AS (SELECT series, from_h, last_h, anchored, state, forecast FROM sim WHERE h = last_h)""",
)
def warm_start(spark, sf_dir):
    """The state at the latest hour with drivers, replayed from the first observation of the unbroken run that ends there.

    A step into an hour takes the drivers of the hour before; without an observation the run starts from zero.
    """
    w = Window.partitionBy("series").orderBy("h")
    run = clean(spark, sf_dir).where("v is not null and bz is not null").withColumn("run", F.col("h") - F.row_number().over(w))
    run = run.withColumn("last_run", F.max("run").over(Window.partitionBy("series"))).where("run = last_run")
    moved = run.select("series", "h", "dst_star", F.lag("v").over(w).alias("v"), F.lag("bs").over(w).alias("bs"))
    folded = folds.collected(moved, KEYS, "h", ["dst_star", "v", "bs"])
    seen = F.filter("rows", lambda r: r["dst_star"].isNotNull())
    start = folded.select("series", "rows", (F.size(seen) > 0).alias("anchored"), F.coalesce(F.get(seen, F.lit(0))["h"], F.get("rows", F.lit(0))["h"]).alias("from_h"))
    zero = F.struct(F.lit(0.0).alias("state"), F.lit(None).cast("double").alias("forecast"))

    def step(s, r):
        into = lambda f: F.struct(F.coalesce(r["dst_star"], f).alias("state"), f.alias("forecast"))
        begin = F.struct(F.coalesce(r["dst_star"], F.lit(0.0)).alias("state"), F.lit(None).cast("double").alias("forecast"))
        return F.when(r["h"] == F.col("from_h"), begin).otherwise(folds.let(P.euler(s["state"], sparse_rate(r["v"], r["bs"], s["state"])), into))

    replayed = F.aggregate(F.filter("rows", lambda r: r["h"] >= F.col("from_h")), zero, step)
    return start.select("series", "from_h", F.element_at("rows", -1)["h"].alias("last_h"), "anchored", replayed.alias("z")).select("series", "from_h", "last_h", "anchored", "z.*")


@query("direct_trees", "split n_rows", "rmse_trees rmse_persistence")
def direct_trees(spark, sf_dir):
    """Trees that predict the next hour's index from its lags and the coupling; fitted before hour 500, saved, loaded and scored on both sides."""
    ladder = lag_ladder(spark, sf_dir).join(clean(spark, sf_dir).where("dst is not null").select("series", "h", "dst"), ["series", "h"])
    features = [c for c in ladder.columns if c.startswith(("dst_", "vbs_"))]
    path = folder(spark, "trees")
    DirectTrees.fit(ladder.where("h < 500"), features, "dst").save(path)
    made = DirectTrees.load(path).predict(ladder, "made")
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("dst"), F.lit(2))))
    return made.groupBy(F.when(F.col("h") < 500, "fit").otherwise("later").alias("split")).agg(F.count("*").alias("n_rows"), rmse("made").alias("rmse_trees"), rmse("dst_1").alias("rmse_persistence"))


@query(
    "stream_pending_truth", "series issue_h step", "point truth",
    f"{LOG}, res AS (SELECT series, issue_h, step, burton AS point, obs AS truth FROM log)",
)
def stream_pending_truth(spark, sf_dir):
    """Every forecast of the log once: with its observation, or with none where the watermark has passed its hour without one."""
    hour = lambda c: F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + F.col(c) * 3600)
    forecasts = log(spark, sf_dir).select("series", "issue_h", "step", hour("target_h").alias("target"), F.col("burton").alias("point"))
    truth = clean(spark, sf_dir).where("dst is not null").select(F.col("series").alias("g2"), hour("h").alias("seen"), F.col("dst").alias("truth"))
    return live.with_late_truth(forecasts, truth, ["series"], ["g2"]).select("series", "issue_h", "step", "point", "truth")
