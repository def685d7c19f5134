import numpy as np
import pytest

from lodestar.errors import CodecError, ZeroNormVector
from lodestar.operators.turbo import Turbo, TurboConfig, codebook, density, pack, trapezoid, turbo_decode, turbo_encode, turbo_scores, unpack


def units(n, d, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_config():
    for bad in ({"dimension": 0}, {"dimension": 4, "bits": 5}, {"dimension": 4, "bits": 1}, {"dimension": 4, "mode": "x"}):
        with pytest.raises(ValueError):
            TurboConfig(**bad)
    c = TurboConfig(10, 4)
    assert (c.code_bits, c.index_bytes, c.sign_bytes, c.code_size) == (3, 4, 2, 14)
    assert TurboConfig(10, 4, "mse").code_size == 9 and TurboConfig(10, mode="disabled").code_size == 40


def test_packing():
    rng = np.random.default_rng(2)
    for bits in range(1, 9):
        v = rng.integers(0, 1 << bits, (5, 13))
        assert (unpack(pack(v, bits), bits, 13) == v).all()
    assert pack(np.array([[1, 2, 3]]), 8).tolist() == [[1, 2, 3]] and pack(np.array([[1, 0, 1]]), 1).tolist() == [[5]]


def test_codebook():
    x = np.linspace(-0.9999, 0.9999, 10_000)
    assert trapezoid(density(x, 64), x) == pytest.approx(1, abs=1e-3)
    for bits in (1, 2, 3, 4):
        centers, bounds = codebook(64, bits)
        assert len(centers) == 1 << bits and (np.diff(centers) > 0).all() and np.allclose(centers, -centers[::-1], atol=1e-3)
        assert np.allclose(bounds, (centers[1:] + centers[:-1]) / 2)


def test_error_falls_with_bits():
    x = 3 * units(300, 64)
    errors = []
    for bits in (1, 2, 3, 4):
        t = Turbo(TurboConfig(64, bits, "mse"))
        errors.append((((t.decode(t.encode(x)) - x) ** 2).sum(axis=1) / 9).mean())
    assert errors == sorted(errors, reverse=True) and errors[0] < 0.4 and errors[3] < 0.02


def test_inner_products_are_estimated_without_bias():
    x, q = units(2000, 64), units(5, 64, 2)
    t = Turbo(TurboConfig(64, 3))
    codes = t.encode(x)
    off = t.inner_products(q, codes) - q @ x.T
    assert abs(off.mean()) < 2e-3 and off.std() < 0.06
    assert np.allclose(t.symmetric(codes[:20], codes[:20]), 1, atol=0.35)
    plain = Turbo(TurboConfig(64, 3, "mse"))
    assert np.allclose(plain.symmetric(plain.encode(x[:9]), plain.encode(x[:9])), (plain.decode(plain.encode(x[:9])) ** 2).sum(axis=1))


def test_refusals():
    t = Turbo(TurboConfig(8, 2))
    with pytest.raises(ZeroNormVector):
        t.encode(np.zeros((1, 8)))
    with pytest.raises(CodecError):
        t.encode(np.full((1, 8), np.nan))
    with pytest.raises(CodecError):
        t.encode(np.ones((1, 7)))
    with pytest.raises(CodecError):
        t.decode(np.zeros((1, 3), np.uint8))
    off = Turbo(TurboConfig(8, mode="disabled"))
    assert np.allclose(off.decode(off.encode(units(3, 8))), units(3, 8), atol=1e-6)


def test_frames(spark):
    x = units(50, 16)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(2)
    c = TurboConfig(16, 4)
    codes = turbo_encode(rows, c)
    got = {r.id: r.vector for r in turbo_decode(codes, c).collect()}
    t = Turbo(c)
    assert np.allclose([got[i] for i in range(50)], t.decode(t.encode(x)))
    scores = {r.id: r.score for r in turbo_scores(codes, x[0].tolist(), c).collect()}
    assert max(scores, key=scores.get) == 0 and np.allclose([scores[i] for i in range(50)], t.inner_products(x[:1], t.encode(x))[0])
    assert turbo_encode(rows.limit(0), c).count() == 0
