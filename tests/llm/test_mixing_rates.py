import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import mixing


def cdf(rate, low, top):
    p = [math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(low, top + 1)]
    return np.cumsum(p)


@pytest.mark.parametrize("rate", [0.3, 1.0, 7.5, 100.0, 431.0, 3000.0, 1e6])
def test_distribution_at_any_rate(spark, rate):
    row = mixing.poisson_steps(spark.createDataFrame([(None, rate)], "source string, rate double")).first()
    want = cdf(rate, row.low, row.low + len(row.cdf) - 1)
    assert np.allclose(row.cdf, want, atol=1e-7) and row.cdf[-1] == pytest.approx(1, abs=1e-6)
    assert len(row.cdf) <= 24 * math.sqrt(rate) + 43 and (row.low == 0 or row.cdf[0] < 1e-20)


def test_zero_rates_draw_nothing(spark):
    row = mixing.poisson_steps(spark.createDataFrame([("a", 0.0)], "source string, rate double")).first()
    assert row.low == 0 and set(row.cdf) == {1.0}


def test_a_rare_source_with_a_large_share(spark):
    """Copies grow with the weight and not with its square: a million copies of one document take seconds."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") == 0, "rare").otherwise("other").alias("source"))
    began = time.perf_counter()
    for total in (24_000, 2_000_000):
        got = {r.source: r.n for r in mixing.mix(docs, {"rare": 0.5, "other": 0.5}, total).groupBy("source").agg(F.count("*").alias("n")).collect()}
        assert abs(got["rare"] - total / 2) < 6 * math.sqrt(total / 2) and abs(got["other"] - total / 2) < 6 * math.sqrt(total / 2)
    assert time.perf_counter() - began < 60
    drawn = mixing.mix(docs, {"rare": 0.5, "other": 0.5}, 24_000)
    assert drawn.where("source = 'rare'").agg(F.countDistinct("copy"), F.max("copy"), F.max("copies")).first()[0:3] == (n := drawn.where("source = 'rare'").count(), n, n)
