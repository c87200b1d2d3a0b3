"""Adaptive conformal intervals: the miss rate steers the level, one stream per key."""

from __future__ import annotations

import bisect
import math
from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Stream:
    """State of one stream: the level and the last residuals, also in sorted order."""

    target: float = 0.9
    gamma: float = 0.02
    window: int = 500
    warmup: int = 20
    alpha: float | None = None
    recent: deque = field(default_factory=deque)
    ordered: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.alpha = 1 - self.target if self.alpha is None else self.alpha
        self.recent = deque(self.recent)
        self.ordered = sorted(self.recent)

    def width(self) -> float:
        if not self.ordered:
            return math.inf
        level = min(1.0, max(0.0, 1.0 - self.alpha))
        if len(self.ordered) < self.warmup:
            return self.ordered[-1]
        if level <= 0:
            return 0.0
        k = math.ceil((len(self.ordered) + 1) * level)
        return self.ordered[min(max(k, 1), len(self.ordered)) - 1]

    def step(self, point: float | None, observed: float | None) -> tuple[float | None, float | None, bool | None, float]:
        """(low, high, covered, level after the step); a missing value leaves the state as it is and is no verdict."""
        half = self.width()
        known = point is not None and math.isfinite(point)
        low, high = (point - half, point + half) if known else (None, None)
        if not known or observed is None or not math.isfinite(observed):
            return low, high, None, self.alpha
        residual = abs(observed - point)
        covered = residual <= half
        self.alpha = min(1.0, max(0.0, self.alpha + self.gamma * ((1 - self.target) - (0.0 if covered else 1.0))))
        self.recent.append(residual)
        bisect.insort(self.ordered, residual)
        if len(self.recent) > self.window:
            self.ordered.pop(bisect.bisect_left(self.ordered, self.recent.popleft()))
        return low, high, covered, self.alpha


def run_adaptive(rows: DataFrame, keys: list[str], time: str, **options) -> DataFrame:
    """low, high, covered (null where nothing was observed) and alpha of every row, in order of time; infinite ends are null."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in [*keys, time]], "low double, high double, covered boolean, alpha double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time)
        stream = Stream(**options)
        out = [stream.step(*(None if pd.isna(x) else float(x) for x in pair)) for pair in zip(group.point, group.observed, strict=True)]
        result = group[[*keys, time]].copy()
        finite = lambda x: x if x is not None and math.isfinite(x) else None
        result["low"], result["high"] = [finite(o[0]) for o in out], [finite(o[1]) for o in out]
        result["covered"], result["alpha"] = pd.array([o[2] for o in out], dtype="boolean"), [o[3] for o in out]
        return result

    return rows.select(*keys, time, "point", "observed").groupBy(*keys).applyInPandas(run, schema)
