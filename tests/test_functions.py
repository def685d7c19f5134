import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import metrics, nig, sq8


def one(df, c):
    return df.select(c.alias("v")).first().v


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 9))
    return a, b, spark.createDataFrame([(a.tolist(), b.tolist(), b[:5].tolist(), [0.0] * 9)], "a array<double>, b array<double>, short array<double>, zero array<double>")


def test_metrics(pair):
    a, b, df = pair
    assert one(df, metrics.l2("a", "b")) == pytest.approx(np.linalg.norm(a - b))
    assert one(df, metrics.l2_sq_prefix("a", "b", 3)) == pytest.approx(((a - b)[:3] ** 2).sum())
    assert one(df, metrics.dot("a", "b")) == pytest.approx(a @ b)
    assert one(df, metrics.dot("a", "short")) == pytest.approx(a[:5] @ b[:5])
    assert one(df, metrics.norm("a")) == pytest.approx(np.linalg.norm(a))
    assert one(df, metrics.cosine(F.col("a"), F.col("b"))) == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    w = metrics.sparse_weighted_dot("a", F.array(F.lit(1), F.lit(8)), F.array(F.lit(2.0), F.lit(-1.0)), F.lit(0.5))
    assert one(df, w) == pytest.approx(0.5 + 2 * a[1] - a[8])


def test_cosine_of_a_zero_vector(pair):
    _, _, df = pair
    with pytest.raises(Exception, match="ZeroNormVector"):
        one(df, metrics.cosine(F.col("a"), F.col("zero")))
    assert one(df, metrics.cosine(F.col("a"), F.col("zero"), on_zero_norm="skip")) is None
    with pytest.raises(metrics.ZeroNormVector):
        metrics.cosine_block(np.zeros((1, 3)), np.ones((2, 3)))
    with pytest.raises(ValueError, match="unknown metric"):
        metrics.resolve("hamming")


def test_blocks_agree_with_loops():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(3, 7)), rng.normal(size=(50, 7))
    assert np.allclose(metrics.l2_block(q, x), [[np.linalg.norm(a - b) for b in x] for a in q])
    assert np.allclose(metrics.dot_block(q, x), [[-(a @ b) for b in x] for a in q])


def test_sq8(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))
    x[:, 2] = 0.25
    lo, hi = x.min(axis=0), x.max(axis=0)
    df = spark.createDataFrame([(i, v.tolist(), lo.tolist(), hi.tolist()) for i, v in enumerate(x)], "i int, v array<double>, lo array<double>, hi array<double>")
    df = df.withColumn("c", sq8.encode(F.col("v"), F.col("lo"), F.col("hi"))).withColumn("y", sq8.decode(F.col("c"), F.col("lo"), F.col("hi")))
    rows = df.orderBy("i").collect()
    codes = np.array([r.c for r in rows])
    assert (codes == sq8.encode_block(x, lo, hi)).all() and (codes[:, 2] == 0).all() and codes.min() == 0 and codes.max() == 255
    assert (np.abs(np.array([r.y for r in rows]) - x) <= (hi - lo) / 510 + 1e-12).all()
    q = x[0].copy()
    q[2] = 9.0  # a constant dimension adds nothing to this distance, unlike to the decoded one
    got = df.select(F.sqrt(sq8.adc_l2_sq(F.array(*map(F.lit, q.tolist())), F.col("c"), F.col("lo"), F.col("hi"))).alias("d"), "i").orderBy("i").collect()
    assert np.allclose([r.d for r in got], sq8.adc_block(np.tile(q, (40, 1)), codes, lo, hi)) and got[0].d < 0.1
    assert sq8.encode_block(np.array([[np.nan, np.inf, -np.inf]]), np.zeros(3), np.ones(3)).tolist() == [[0, 255, 0]]
    odd = spark.createDataFrame([([float("nan"), 0.5, 0.5 / 255, 7.0],)], "v array<double>")
    assert one(odd, sq8.encode(F.col("v"), F.array(*[F.lit(0.0)] * 4), F.array(*[F.lit(1.0)] * 4))) == [0, 128, 1, 255]


def test_ln_gamma(spark):
    xs = [0.01, 0.3, 0.5, 0.51, 1.0, 2.5, 10.0, 1234.5, 1e6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(nig.ln_gamma(F.col("x")).alias("v")).collect()
    assert np.allclose([r.v for r in got], [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-12)


def test_combined_is_the_statistics_of_both(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=13), rng.normal(2, 3, size=8)
    stat = lambda v: (float(len(v)), float(v.mean()) if len(v) else 0.0, float(v.var() * len(v)) if len(v) else 0.0)
    kind = "struct<n:double,mean:double,m2:double>"
    df = spark.createDataFrame([(stat(a), stat(b), stat(a[:0]))], f"a {kind}, b {kind}, none {kind}")
    assert tuple(one(df, nig.combined(F.col("a"), F.col("b")))) == pytest.approx(stat(np.concatenate([a, b])))
    assert tuple(one(df, nig.combined(F.col("a"), F.col("none")))) == pytest.approx(stat(a))
    assert tuple(one(df, nig.combined(F.col("none"), F.col("b")))) == pytest.approx(stat(b))
    assert one(df, nig.bic_gain(F.array("a"), F.array("none"))) == float("-inf")
