import math

import pytest
from pyspark.sql import functions as F

from embedmesh.functions import sketch, stats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_entropy_and_llr(spark):
    assert value(spark, stats.log_likelihood_ratio(10, 0, 0, 10)) == pytest.approx(40 * math.log(2))
    assert value(spark, stats.log_likelihood_ratio(1, 1, 1, 1)) == 0
    assert value(spark, stats.entropy(1, 1)) == pytest.approx(2 * math.log(2)) and value(spark, stats.entropy(-1, 1)) is None
    assert value(spark, stats.root_log_likelihood_ratio(1, 9, 9, 1)) < 0 < value(spark, stats.root_log_likelihood_ratio(9, 1, 1, 9))
    assert value(spark, stats.root_log_likelihood_ratio(0, 0, 1, 1)) == 0


def test_ieee(spark):
    assert math.isnan(value(spark, stats.divided(0, 0))) and value(spark, stats.divided(1, 0)) == math.inf and value(spark, stats.divided(-1, 0)) == -math.inf
    assert value(spark, stats.above(F.lit(stats.NAN), 2.59)) is False and value(spark, stats.above(F.lit(3.0), 2.59)) is True
    assert math.isnan(value(spark, stats.phi_t(stats.phi(10, 1, 1, 1), 1, 1)))


def test_mean_and_std(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "k int, v double")
    got = {r.k: (r.m, r.s) for r in df.groupBy("k").agg(stats.mean("v").alias("m"), stats.sample_std("v").alias("s")).collect()}
    assert got[1] == (3.0, pytest.approx(math.sqrt(2))) and got[2][0] == 5.0 and math.isnan(got[2][1])
    assert df.where("k > 5").agg(stats.mean("v").alias("m")).first().m == 0.0


def test_compare_frequencies(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "item string") for s in ("xxxxy", "yyyyz"))
    got = [(r.item, r.score) for r in stats.compare_frequencies(a, b, threshold=-10).collect()]
    assert [x for x, _ in got] == ["x", "z", "y"] and got[1][1] < 0 and [r.item for r in stats.compare_frequencies(a, b).collect()] == ["x"]


def murmur(key, seed=0xBEEF):
    """MurmurHash3 of eight bytes."""
    h = seed
    for k in (key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def test_sketch(spark):
    ids = spark.range(3000)
    for r in ids.limit(300).select("id", sketch.murmur3(F.col("id")).alias("h"), *sketch.observed(F.col("id"))).collect():
        h = murmur(r.id)
        assert r.h & 0xFFFFFFFF == h
        rest = (h >> 4) | 0xF0000000
        want = [0] * 16
        want[h & 15] = (rest & -rest).bit_length()
        assert [r[n] for n in sketch.NAMES] == want
    seen = ids.select(*sketch.observed(F.col("id"))).agg(*sketch.merged()).select(sketch.estimate().alias("n")).first().n
    assert 1200 < seen < 7500
