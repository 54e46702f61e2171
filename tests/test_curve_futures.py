import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions.curve import interpolate_rate
from riskloom.operators.pricing import futures_fair_value

CURVES = {"normal": (5.125, 5.375, 5.5), "flat": (5.75, 5.75, 5.75), "steep": (3.0, 5.0, 9.0)}
DTES = [0, 45, 91, 182, 365, 400, 730]


def _rates(spark, curve):
    r3, r6, r1 = CURVES[curve]
    df = spark.createDataFrame([(d, r3, r6, r1) for d in DTES], "dte int, rate_3m double, rate_6m double, rate_1y double")
    return {r.dte: r.rate for r in df.withColumn("rate", interpolate_rate()).collect()}


def test_pillars_and_flat_ends(spark):
    r = _rates(spark, "steep")
    assert r[0] == r[45] == r[91] == pytest.approx(0.03)
    assert r[182] == pytest.approx(0.05)
    assert r[365] == r[400] == r[730] == pytest.approx(0.09)


def test_linear_segments_and_monotone(spark):
    r = _rates(spark, "steep")
    df = spark.createDataFrame([(d, 3.0, 5.0, 9.0) for d in range(0, 800)], "dte int, rate_3m double, rate_6m double, rate_1y double")
    vals = [x.rate for x in df.withColumn("rate", interpolate_rate()).orderBy("dte").collect()]
    assert all(b >= a - 1e-15 for a, b in zip(vals, vals[1:]))
    assert vals[136] == pytest.approx(0.03 + (136 - 91) / 91 * 0.02)
    assert _rates(spark, "flat")[400] == pytest.approx(0.0575)


def test_futures_fair_value(spark):
    df = spark.createDataFrame([(22000.0, 30, 0.065, 1.0, 22100.0), (22000.0, 0, 0.065, 6.5, 22000.0)],
                               "spot double, dte int, rate double, div_yield double, settle double")
    out = futures_fair_value(df).collect()
    T = 30 / 365
    assert out[0].theoretical_price == pytest.approx(22000 * math.exp((0.065 - 0.01) * T), abs=1e-6)
    assert out[0].basis == pytest.approx(22100 - out[0].theoretical_price, abs=1e-9)
    assert out[1].theoretical_price == pytest.approx(22000.0, abs=1e-9) and out[1].delta == 1.0
