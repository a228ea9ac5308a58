"""Calibration report: tables of both kinds, errors beside them, days of both roles counted."""

import pytest
from pyspark.sql import functions as F

from tidegate.operators import calibration as ca

SHAPE = "fold int, role string, date int, raw double, label double"


def test_tables_add_up_and_shared_days_show(spark):
    cal = [(1, "cal", d, 0.2 + 0.6 * (d % 5) / 4, float(d % 5 > 2)) for d in range(40)]
    test = [(1, "test", d, 0.2 + 0.6 * (d % 5) / 4, float(d % 5 > 1)) for d in range(38, 60)]
    other = [(None, "cal", 1, 0.4, 1.0), (None, "cal", 2, 0.6, 0.0), (None, "test", 3, 0.5, 1.0)]
    skipped = [(1, "test", 50, None, 1.0), (1, "test", 50, 0.3, None), (1, "embargo", 38, 0.3, 1.0)]
    rows = spark.createDataFrame([*cal, *test, *other, *skipped], SHAPE)
    got = ca.calibrate_and_report(rows, ["fold"]).collect()
    one = [r for r in got if r.fold == 1]
    assert {r.shared_days for r in one} == {2} and {r.shared_days for r in got if r.fold is None} == {0}
    for kind in ("raw", "calibrated"):
        part = [r for r in one if r.kind == kind]
        assert len({(r.ece, r.rmse) for r in part}) == 1
    raw = [r for r in one if r.kind == "raw"]
    assert sum(r.n for r in raw) == len(test)
    assert raw[0].ece == pytest.approx(sum(r.n * abs(r.mean_p - r.share_y) for r in raw) / len(test))
    # in fold 1 the calibrator is a step from 0 to 1; scores in its bin 0 are in no bin
    ones = [r for r in one if r.kind == "calibrated"]
    assert [(r.bin, r.n, r.mean_p) for r in ones] == [(10, sum(d % 5 > 2 for d in range(38, 60)), 1.0)]
    # the two scores of the key NULL are pooled to a half
    none = {r.kind: r for r in got if r.fold is None}
    assert none["calibrated"].mean_p == 0.5 and none["calibrated"].rmse == 0.5
    assert ca.calibrate_and_report(rows.filter(F.lit(False)), ["fold"]).count() == 0
