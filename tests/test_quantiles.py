"""Exact quantiles against Spark's own, which holds all values of a group, and against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import quantiles


def _expected(rows, q):
    own = {}
    for g, v in rows:
        if v is not None:
            own.setdefault(g, []).append(v)
    out = {}
    for g, values in own.items():
        values = sorted(values, key=lambda v: (v != v, v))
        at = (len(values) - 1) * q
        low, high = values[int(at)], values[-int(-at // 1)]
        out[g] = low if at == int(at) else (int(at) + 1 - at) * low + (at - int(at)) * high
    return out


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_quantiles_equal_sorted_lists(spark, most):
    r = random.Random(5)
    rows = [("distinct", r.gauss(0, 1e6)) for _ in range(5000)] + [("ties", float(r.choice([1, 1, 1, 2, 5]))) for _ in range(3000)]
    rows += [("half", 7.0)] * 2000 + [("half", 7 + r.random()) for _ in range(2000)]  # the median lies at the end of the ties
    rows += [("scale", 10.0 ** r.uniform(-300, 300)) for _ in range(3000)] + [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None), (None, 4.0), (None, 6.0)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = quantiles.exact_quantiles(d, "g", "v", [0.5, 0.0, 0.31, 1.0], most).collect()
    for q in (0.5, 0.0, 0.31, 1.0):
        assert {x.g: x.value for x in got if x.quantile == q} == pytest.approx(_expected(rows, q), rel=1e-12)


def test_quantiles_of_no_numbers_and_nan(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", [0.5]).count() == 0
    d = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0), ("b", float("inf")), ("b", float("-inf")), ("b", 0.0)], "g string, v double")
    for most in (1, 100):
        got = {(x.g, x.quantile): x.value for x in quantiles.exact_quantiles(d, "g", "v", [0.0, 0.5, 1.0], most).collect()}
        assert got.pop(("a", 1.0)) != got.get(("a", 1.0))  # NaN
        assert got == {("a", 0.0): 1.0, ("a", 0.5): 2.0, ("b", 0.0): float("-inf"), ("b", 0.5): 0.0, ("b", 1.0): float("inf")}


def test_quantiles_agree_with_spark(spark):
    d = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    want = {(r.g, r.m) for r in d.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert {(r.g, r.value) for r in quantiles.exact_quantiles(d, "g", "v", [0.5], 100).collect()} == want
