"""All queries of the engine by name, and their SQL; the modules of this package add to them."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODULES = ("physics", "windows", "joins", "aggregates", "folds", "fits", "sources", "serving", "forecasts", "arrivals", "streams", "realtime", "validation", "archives")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__package__}.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
