"""Vector functions as Column expressions, and the registry of metrics with their numpy forms.

The expressions compute in double precision. Where two vectors differ in length, the shorter decides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ZeroNormVector


def _double(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _pairwise(a, b, f: Callable[[Column, Column], Column]) -> Column:
    a, b = _double(a), _double(b)
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), f), F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def l2_sq(a, b) -> Column:
    return _pairwise(a, b, lambda x, y: (x - y) * (x - y))


def l2(a, b) -> Column:
    return F.sqrt(l2_sq(a, b))


def l2_sq_prefix(a, b, n: int) -> Column:
    """Squared distance over the first ``n`` entries."""
    return l2_sq(F.slice(_double(a), 1, n), F.slice(_double(b), 1, n))


def norm_sq(a) -> Column:
    return F.aggregate(F.transform(_double(a), lambda x: x * x), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(norm_sq(a))


def cosine_similarity(a, b, on_zero_norm: str = "raise") -> Column:
    """``on_zero_norm``: ``raise`` an error, or ``skip`` to null."""
    scale = norm(a) * norm(b)
    zero = F.raise_error(F.lit("ZeroNormVector: a vector has no length")).cast("double") if on_zero_norm == "raise" else F.lit(None).cast("double")
    return F.when(scale == 0, zero).otherwise(dot(a, b) / F.when(scale != 0, scale))


def cosine(a, b, on_zero_norm: str = "raise") -> Column:
    """1 less the cosine: 0 to 2."""
    return 1 - cosine_similarity(a, b, on_zero_norm)


def sparse_weighted_dot(v, indices, weights, bias) -> Column:
    """The weighted sum of the entries of ``v`` at ``indices`` (from 0), from ``bias`` on."""
    v = _double(v)
    terms = F.zip_with(indices, _double(weights), lambda i, w: w * F.get(v, i))
    return F.aggregate(terms, bias.cast("double"), lambda s, x: s + x)


# -- numpy forms: queries (q, d) against rows (n, d), giving (q, n)


def l2_block(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances to a block of rows, by differences: an expansion into dot products would lose digits near zero."""
    step = max(1, (1 << 22) // max(1, x.size))
    out = np.empty((len(q), len(x)))
    for a in range(0, len(q), step):
        d = q[a : a + step, None] - x[None]
        out[a : a + step] = np.sqrt(np.einsum("qnd,qnd->qn", d, d))
    return out


def cosine_block(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    if (scale == 0).any():
        raise ZeroNormVector("a vector has no length")
    return 1 - (q @ x.T) / scale


def dot_block(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Negated inner products, so that lower is better."""
    return -(q @ x.T)


COLUMNS: dict[str, Callable] = {"l2": l2, "cosine": cosine, "dot": lambda a, b: -dot(a, b)}
BLOCKS: dict[str, Callable] = {"l2": l2_block, "cosine": cosine_block, "dot": dot_block}


def resolve(metric: str | Callable) -> Callable:
    """The block form of a metric: a name, or a function of (q, d) and (n, d) arrays that gives (q, n) distances."""
    if callable(metric):
        return metric
    if metric not in BLOCKS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(sorted(BLOCKS))}")
    return BLOCKS[metric]
