"""Rotation-based vector quantisation (arXiv 2504.19874): a few bits an entry, by mean squared error or inner product."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CodecError, ZeroNormVector
from ..functions.arrowio import matrix, ship

#: Points of the grid that a codebook is fitted on, its end, and when fitting stops: fixed values, on which centroids depend.
GRID, EDGE, ROUNDS, TOLERANCE = 10_000, 0.9999, 200, 1e-10
#: What the seed of the projection differs by from that of the rotation: a fixed value.
PROJECTION_SEED = 1_000_000


@dataclass(frozen=True)
class TurboConfig:
    """``mode``: ``mse``, ``inner_product`` (one bit of each entry then goes to the residual's sign), or ``disabled``."""

    dimension: int
    bits: int = 4
    mode: str = "inner_product"
    seed: int = 42

    def __post_init__(self):
        if self.dimension < 1:
            raise ValueError("dimension must be 1 or more")
        if self.mode not in ("mse", "inner_product", "disabled"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if not 1 <= self.bits <= 4 or self.mode == "inner_product" and self.bits < 2:
            raise ValueError("bits must be 1 to 4, and 2 or more for inner products")

    @property
    def code_bits(self) -> int:
        return self.bits - (self.mode == "inner_product")

    @property
    def index_bytes(self) -> int:
        return -(-self.dimension * self.code_bits // 8)

    @property
    def sign_bytes(self) -> int:
        return -(-self.dimension // 8) if self.mode == "inner_product" else 0

    @property
    def code_size(self) -> int:
        """Bytes of a code: indices, signs and the residual's length, the vector's length."""
        if self.mode == "disabled":
            return 4 * self.dimension
        return self.index_bytes + self.sign_bytes + (8 if self.mode == "inner_product" else 4)


def density(x: np.ndarray, dim: int) -> np.ndarray:
    """Of an entry of a random unit vector of ``dim`` entries, but for rounding at the ends."""
    if dim < 3:
        return np.ones_like(x)
    log_scale = math.lgamma(dim / 2) - math.lgamma((dim - 1) / 2) - 0.5 * math.log(math.pi)
    return np.exp(log_scale + (dim - 3) / 2 * np.log1p(-x * x))


def trapezoid(y: np.ndarray, x: np.ndarray) -> float:
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


@lru_cache(maxsize=64)
def codebook(dim: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, boundaries) that minimise the mean squared error for that density: Lloyd's iteration on a grid."""
    x = np.linspace(-EDGE, EDGE, GRID)
    weight = density(x, dim)
    total = np.cumsum(weight) / weight.sum()
    n = 1 << bits
    centers = np.interp((np.arange(n) + 0.5) / n, total, x)
    for _ in range(ROUNDS):
        cell = np.searchsorted((centers[1:] + centers[:-1]) / 2, x)
        mass = np.bincount(cell, weight, n)
        new = np.where(mass > 0, np.bincount(cell, weight * x, n) / np.where(mass > 0, mass, 1), centers)
        moved = np.abs(new - centers).max()
        centers = new
        if moved < TOLERANCE:
            break
    return centers, (centers[1:] + centers[:-1]) / 2


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """(n, d) numbers of ``bits`` bits as (n, bytes), the lowest bit first."""
    if not 1 <= bits <= 8:
        raise ValueError("bits must be 1 to 8")
    each = np.unpackbits(values.astype(np.uint8)[:, :, None], axis=2, count=bits, bitorder="little")
    return np.packbits(each.reshape(len(values), -1), axis=1, bitorder="little")


def unpack(data: np.ndarray, bits: int, dim: int) -> np.ndarray:
    each = np.unpackbits(data, axis=1, count=dim * bits, bitorder="little").reshape(len(data), dim, bits)
    return np.packbits(each, axis=2, bitorder="little")[:, :, 0]


class Turbo:
    """The quantiser of a configuration: a random rotation, a codebook, and a Gaussian projection for residuals."""

    def __init__(self, config: TurboConfig):
        self.config = config
        d = config.dimension
        q, r = np.linalg.qr(np.random.default_rng(config.seed).normal(size=(d, d)))
        self.rotation = q * np.sign(np.diag(r))
        self.projection = np.random.default_rng(config.seed + PROJECTION_SEED).normal(size=(d, d))
        self.centers, self.bounds = codebook(d, config.code_bits)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n, code_size) bytes. A vector without length can't be encoded."""
        c, x = self.config, np.asarray(x, np.float64)
        if x.ndim != 2 or x.shape[1] != c.dimension:
            raise CodecError(f"vectors must have {c.dimension} entries")
        if c.mode == "disabled":
            return np.ascontiguousarray(x.astype("<f4")).view(np.uint8)
        size = np.linalg.norm(x, axis=1)
        if not np.isfinite(size).all():
            raise CodecError("a vector isn't finite")
        if (size == 0).any():
            raise ZeroNormVector("a vector has no length")
        unit = x / size[:, None]
        index = np.searchsorted(self.bounds, unit @ self.rotation)
        length = lambda v: np.ascontiguousarray(v.astype("<f4")[:, None]).view(np.uint8)
        parts = [pack(index, c.code_bits)]
        if c.mode == "inner_product":
            rest = unit - self.centers[index] @ self.rotation.T
            parts += [pack((rest @ self.projection.T >= 0).astype(np.uint8), 1), length(np.linalg.norm(rest, axis=1))]
        return np.concatenate([*parts, length(size)], axis=1)

    def parts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]:
        """(unit vectors, residual signs of -1 and 1, residual lengths, lengths) of codes."""
        c = self.config
        if codes.ndim != 2 or codes.shape[1] != c.code_size:
            raise CodecError(f"codes must have {c.code_size} bytes")
        length = lambda a: np.ascontiguousarray(codes[:, a : a + 4]).view("<f4")[:, 0].astype(np.float64)
        unit = self.centers[unpack(codes[:, : c.index_bytes], c.code_bits, c.dimension)] @ self.rotation.T
        size = length(c.code_size - 4)
        signs = rest = None
        if c.mode == "inner_product":
            signs = unpack(codes[:, c.index_bytes : c.index_bytes + c.sign_bytes], 1, c.dimension) * 2.0 - 1
            rest = length(c.code_size - 8)
        if not np.isfinite(size).all() or rest is not None and not np.isfinite(rest).all():
            raise CodecError("a length isn't finite")
        return unit, signs, rest, size

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors without their residuals."""
        if self.config.mode == "disabled":
            return np.ascontiguousarray(codes).view("<f4").astype(np.float64)
        unit, _, _, size = self.parts(codes)
        return unit * size[:, None]

    def inner_products(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, codes): estimates; without bias in ``inner_product`` mode, where residual signs are used."""
        if self.config.mode == "disabled":
            return q @ self.decode(codes).T
        unit, signs, rest, size = self.parts(codes)
        out = q @ unit.T
        if signs is not None:
            out = out + math.sqrt(math.pi / 2) / self.config.dimension * (q @ self.projection.T) @ signs.T * rest
        return out * size

    def symmetric(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row by row, the estimated inner product of two codes; with residuals, the mean of both directions."""
        x, y = self.decode(a), self.decode(b)
        if self.config.mode != "inner_product":
            return (x * y).sum(axis=1)
        one = lambda q, codes: np.array([self.inner_products(u[None], v[None])[0, 0] for u, v in zip(q, codes)])
        return (one(x, b) + one(y, a)) / 2


def turbo_encode(rows: DataFrame, config: TurboConfig) -> DataFrame:
    """(id, code) of ``rows(id, vector)``."""
    ship(rows.sparkSession)

    def run(batches):
        turbo = Turbo(config)
        for b in batches:
            if b.num_rows:
                codes = turbo.encode(matrix(b.column("vector")))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    return rows.select(F.col("id").cast("long"), "vector").mapInArrow(run, "id long, code binary")


def turbo_decode(codes: DataFrame, config: TurboConfig) -> DataFrame:
    """(id, vector) of ``codes(id, code)``."""
    ship(codes.sparkSession)

    def run(batches):
        turbo = Turbo(config)
        for b in batches:
            if b.num_rows:
                x = turbo.decode(np.stack([np.frombuffer(c, np.uint8) for c in b.column("code").to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "vector"])

    return codes.select("id", "code").mapInArrow(run, "id long, vector array<double>")


def turbo_scores(codes: DataFrame, query: list[float], config: TurboConfig) -> DataFrame:
    """(id, score): the estimated inner product of one query with each of ``codes(id, code)``."""
    ship(codes.sparkSession)

    def run(batches):
        turbo, q = Turbo(config), np.array([query], np.float64)
        for b in batches:
            if b.num_rows:
                s = turbo.inner_products(q, np.stack([np.frombuffer(c, np.uint8) for c in b.column("code").to_pylist()]))[0]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s)], ["id", "score"])

    return codes.select("id", "code").mapInArrow(run, "id long, score double")
