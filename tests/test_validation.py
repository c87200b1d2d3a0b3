"""Artifacts are read by kind and version only, and fits without SQL give what numpy gives on the collected rows."""

from __future__ import annotations

import numpy as np
import pytest

from auroraline.plans import registry
from auroraline.plans.base import log
from auroraline.sources import artifacts

SF = "/root/testdata/sf0.001"


def by_hand(spark):
    rows = log(spark, SF).where("obs is not null and issue_h < 500").collect()
    x = np.array([[1.0, r["latest"], r["burton"], r["obrien"], r["step"]] for r in rows], float)
    y = np.array([r["obs"] for r in rows], float)
    scale = np.sqrt((x**2).mean(0))
    z = x / scale
    shrink = np.diag([0.0, 100.0, 100.0, 100.0, 100.0])
    return np.linalg.solve(z.T @ z + shrink, z.T @ y) / scale


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", None)], "term string, coefficient double")
    artifacts.write_artifact(rows, f"{tmp_path}/a", "calibration", 2)
    read = lambda kind, version, schema="term string, coefficient double": artifacts.read_artifact(spark, f"{tmp_path}/a", kind, version, schema).collect()
    assert sorted(map(tuple, read("calibration", 2))) == [("a", 1.5), ("b", None)]
    for wrong in (("calibration", 1), ("conformal", 2), ("calibration", 2, "name string, coefficient double")):
        with pytest.raises(Exception):
            read(*wrong)


def test_an_artifact_without_rows(spark, tmp_path):
    artifacts.write_artifact(spark.createDataFrame([], "term string, coefficient double"), f"{tmp_path}/a", "calibration", 2)
    assert not artifacts.read_artifact(spark, f"{tmp_path}/a", "calibration", 2, "term string, coefficient double").collect()


def test_ridge_and_its_artifact(spark):
    want = by_hand(spark)
    found = {r["term"]: r["coefficient"] for r in registry.queries()["ridge_calibration"](spark, SF).collect()}
    assert np.allclose([found[k] for k in ("one", "latest", "burton", "obrien", "step")], want, atol=1e-5)
    centers = {(r["series"], r["issue_h"], r["step"]): r["center"] for r in registry.queries()["calibration_artifact"](spark, SF).collect()}
    rows = log(spark, SF).collect()
    assert len(centers) == len(rows)
    for r in rows:
        assert abs(centers[r["series"], r["issue_h"], r["step"]] - want @ [1.0, r["latest"], r["burton"], r["obrien"], r["step"]]) < 1e-4


def test_joint_draws_have_the_point_as_their_mean(spark):
    from auroraline.plans.base import frame

    rows = frame(spark, SF).where("v is not null and dst is not null").collect()
    v = np.array([r["v"] for r in rows])
    dst = np.array([r["dst"] for r in rows])
    kinds = {(round(5.4 + 0.001 * (a - v.mean()), 5), round(-0.13 + 0.001 * (b - dst.mean()), 5)) for a, b in zip(v, dst, strict=True)}
    found = registry.queries()["joint_draws"](spark, SF).collect()
    assert len(found) == 500 and all(r["pressure_term"] == 0.0 for r in found)
    near = lambda r: any(abs(r["coupling"] - a) < 2e-5 and abs(r["decay"] - b) < 2e-5 for a, b in kinds)
    assert all(near(r) for r in found)
