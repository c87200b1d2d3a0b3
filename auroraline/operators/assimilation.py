"""Extended Kalman filter of the ring-current index and its decay rate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Filter:
    """State (index, decay rate); injection is the Burton term.  The update is in Joseph form; states stay in bounds."""

    LOW, HIGH = np.array([-2000.0, 1e-3]), np.array([50.0, 1.0])

    def __init__(self, start: float, decay: float = 1 / 7.7, spread=(15.0, 0.02), noise=(3.0, 0.002), error: float = 4.0):
        self.mean = np.array([start, decay])
        self.cov = np.diag(np.square(spread))
        self.noise, self.error = np.diag(np.square(noise)), error**2

    def predict(self, v: float, bs: float) -> None:
        x, r = self.mean
        rate = float(np.clip(-5.4e-3 * v * bs - r * x, -200, 200))
        jacobian = np.array([[1 - r, -x], [0.0, 1.0]])
        self.mean = np.clip([x + rate, r], self.LOW, self.HIGH)
        self.cov = jacobian @ self.cov @ jacobian.T + self.noise

    def update(self, observed: float) -> None:
        h = np.array([1.0, 0.0])
        gain = self.cov @ h / (h @ self.cov @ h + self.error)
        self.mean = np.clip(self.mean + gain * (observed - self.mean[0]), self.LOW, self.HIGH)
        keep = np.eye(2) - np.outer(gain, h)
        self.cov = keep @ self.cov @ keep.T + np.outer(gain, gain) * self.error
        self.cov = (self.cov + self.cov.T) / 2


def run_filter(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """dst_mean, decay and dst_sd after each row's update; a null observation only predicts."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in [*keys, time]], "dst_mean double, decay double, dst_sd double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time)
        known = group.dst_star.dropna()
        state = Filter(float(known.iloc[0]) if len(known) else -10.0)
        out = []
        for v, bs, seen in zip(group.v, group.bs, group.dst_star, strict=True):
            if not pd.isna(seen):
                state.update(float(seen))
            out.append((state.mean[0], state.mean[1], float(np.sqrt(state.cov[0, 0]))))
            state.predict(float(v), float(bs))
        result = group[[*keys, time]].copy()
        result[["dst_mean", "decay", "dst_sd"]] = out
        return result

    return rows.groupBy(*keys).applyInPandas(run, schema)
