import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import quantiles as q


@pytest.fixture
def tight(monkeypatch):
    """Small sketches and lists, so that several rounds are needed."""
    monkeypatch.setattr(q, "SKETCH_ACCURACY", 20)
    monkeypatch.setattr(q, "LIST_LIMIT", 15)


def check(spark, values, probs=(0.0, 0.25, 0.5, 0.75, 1.0)):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    n = sum(v is not None for v in values)
    got = q.quantiles(df, {"v": F.col("v")}, probs, {"v": n}, exact_rows=0)["v"]
    expected = np.quantile([v for v in values if v is not None], probs)
    assert np.allclose(got, expected, rtol=1e-12, atol=0)


def test_refined_quantiles(spark, tight):
    rnd = random.Random(3)
    check(spark, [rnd.gauss(0, 100) for _ in range(1500)] + [None] * 20)
    # A third of the rows share one value; another shares the top.
    check(spark, [5.0] * 500 + [rnd.uniform(0, 10) for _ in range(700)] + [10.0] * 300)
    check(spark, [1.0] * 200)
    check(spark, [float(i) for i in range(40)])


def test_order_statistics_of_large_integers(spark, tight):
    base = 2 ** 60
    values = [base + i for i in range(300)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(4)
    got = q.order_statistics(df, {"v": F.col("v")}, {"v": [0, 150, 299]}, {"v": 300})
    assert got == {("v", 0): base, ("v", 150): base + 150, ("v", 299): base + 299}


def test_builtin_and_refined_agree(spark):
    rnd = random.Random(9)
    values = [round(rnd.expovariate(0.01), 2) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    args = ({"v": F.col("v")}, [0.25, 0.5, 0.75], {"v": 3000})
    a, b = q.quantiles(df, *args, exact_rows=10_000)["v"], q.quantiles(df, *args, exact_rows=10)["v"]
    assert all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b))
    assert q.quantiles(df.limit(0), {"v": F.col("v")}, [0.5], {"v": 0}, 10) == {"v": [None]}
