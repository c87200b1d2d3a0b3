"""Every query that has SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from auroraline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(SF):
        connection.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return connection


def rows_of(spark, name):
    df = registry.queries()[name](spark, SF)
    return df.columns, [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    columns, found = rows_of(spark, name)
    result = duck.sql(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(columns) == sorted(names)
    place = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in place) for r in result.fetchall()]
    assert sorted(map(str, found)) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    columns, found = rows_of(spark, name)
    assert columns and len(set(columns)) == len(columns)
    assert found or name == "storm_catalog"  # the smallest table may hold no storm


@pytest.mark.parametrize(("name", "steps"), [("ensemble_rollout", 6), ("affine_trajectory", 4), ("history_rollout", 7)])
def test_every_issue_hour(spark, name, steps):
    """All valid hours are issue hours."""
    from auroraline.plans.base import clean

    valid = {(r["series"], r["h"]) for r in clean(spark, SF).where("quality = 1").collect()}
    found = rows_of(spark, name)[1]
    assert {r[:2] for r in found} == valid and len(found) == steps * len(valid)


def test_draws_are_those_of_the_reference(spark, monkeypatch):
    from auroraline.plans import fits

    for name in ("storm_bootstrap_interval", "block_bootstrap_interval"):
        columns, [row] = rows_of(spark, name)
        found = dict(zip(columns, row, strict=True))
        assert found["draws"] == 10_000 and found["low"] <= found["median"] <= found["high"] and 1 / 10_001 <= found["p"] + 1e-6 <= 1 + 2e-6
    calls, fit = [], fits.L.stlsq
    monkeypatch.setattr(fits.L, "stlsq", lambda *a: calls.append(a) or fit(*a))
    registry.queries()["ensemble_discovery"](spark, "/root/testdata/sf0.01")  # each draw has rows there
    assert len(calls) == 500


def test_folds_thresholds_and_lags_are_whole(spark):
    from auroraline.plans.base import log

    rows = log(spark, SF).select("issue_h", "target_h").collect()
    want = {}
    for k in range(max(r["issue_h"] for r in rows) // 72 + 1):
        want[k, "query"] = sum(k * 72 <= r["issue_h"] < k * 72 + 72 for r in rows)
        want[k, "train"] = sum(r["target_h"] < k * 72 - 168 for r in rows)
    assert {r[:2]: r[2] for r in rows_of(spark, "rolling_folds")[1]} == {k: n for k, n in want.items() if n}
    assert len(rows_of(spark, "storm_threshold")[1]) == 60
    assert sorted(r[0] for r in rows_of(spark, "error_subset")[1]) == [1, 2, 3, 4, 6, 9, 12, 18, 24]


def test_events_outside_the_month_have_hours(spark, tmp_path):
    from auroraline.plans.base import frame

    rows = "select 2L as user_id, timestamp'{}' as ts, 'view' as event_type, 5.0D as value"
    spark.sql(" union all ".join(rows.format(t) for t in ("2023-12-31 22:30:00", "2024-02-02 01:30:00"))).write.parquet(f"{tmp_path}/events.parquet")
    found = frame(spark, str(tmp_path))
    assert [r["h"] for r in found.where("v is not null").orderBy("h").collect()] == [-2, 769] and found.count() == 2 * 772


def odd_rows(spark, folder, name, events):
    """Rows of a query and of its SQL on a table of (event_id, ts, user_id, event_type, value), as texts."""
    values = ", ".join(f"({i}, timestamp_ntz'{ts}', {u}, '{kind}', cast({v} as double))" if ts else f"({i}, cast(null as timestamp_ntz), {u}, '{kind}', cast({v} as double))" for i, ts, u, kind, v in events)
    spark.sql(f"select cast(event_id as bigint) event_id, ts, cast(user_id as bigint) user_id, event_type, value from values {values} as t(event_id, ts, user_id, event_type, value)").coalesce(1).write.parquet(f"{folder}/events.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    result = connection.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, str(folder)).select(*[c[0] for c in result.description])
    return sorted(str(tuple(r)) for r in df.collect()), sorted(map(str, result.fetchall()))


def test_speed_around_of_odd_events(spark, tmp_path):
    """A null value is a match, rows without a user or a time match nothing, and seconds before the first hour are floored."""
    events = [
        (1, "2024-01-01 00:00:05", 3, "view", 10.0), (2, "2024-01-01 00:00:09", 3, "view", "null"), (3, "2024-01-01 00:00:10", 3, "click", 1.0), (4, "2024-01-01 00:00:07", 3, "click", 1.0),
        (5, "2024-01-01 00:00:08", "null", "click", 1.0), (6, "2024-01-01 00:00:08", "null", "view", 20.0), (7, None, 3, "click", 1.0), (8, None, 3, "view", 30.0),
        (9, "2023-12-31 23:59:58.5", 3, "view", 40.0), (10, "2023-12-31 23:59:59.5", 3, "click", 1.0), (11, "2024-01-01 00:00:00.2", 3, "view", 50.0), (12, "2024-03-01 00:00:00", 3, "click", 1.0), (13, "2024-02-01 00:00:00", -3, "click", 1.0), (14, "2024-02-02 00:00:00", -3, "view", 60.0),
    ]
    found, want = odd_rows(spark, tmp_path, "speed_around", events)
    assert found == want and len(want) == 7


def test_plasma_scan_of_dense_wind(spark, tmp_path):
    events = [(i, "2024-02-10 12:00:00.7", 1, "view", v) for i, v in ((0, 501.0), (1, 501.01), (2, 600.0), (4, 900.5), (5, 25000.0), (6, 20.0))]
    found, want = odd_rows(spark, tmp_path, "plasma_scan", events)
    assert found == want and len(want) == 5


def test_plasma_scan_of_odd_events(spark, tmp_path):
    """Ids below zero or missing, and events without a time or a value, as in the SQL."""
    events = [(i, "2024-02-10 12:00:00.7", 1, "view", v) for i, v in ((9, "'infinity'"), (10, "'nan'"), (14, "null"), (-1, 7.0), (-2, 8.0), (-3, 9.0), (-4, 10.0), ("null", 11.0))]
    events += [(15, None, 1, "view", 30.0), (20, "2023-12-31 23:59:59.5", 1, "view", 1.0), (24, "2024-07-01 00:00:00", 1, "click", 2.0)]
    found, want = odd_rows(spark, tmp_path, "plasma_scan", events)
    assert found == want and len(want) == 9
