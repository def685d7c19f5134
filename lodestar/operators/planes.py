"""Random sparse hyperplanes: the hash functions and expert projections of a store."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..config import Config


@dataclass(frozen=True)
class Planes:
    """``hash``: (tables, bits, dimension) weights and (tables, bits) biases; ``expert`` likewise. Sparse rows, dense
    storage: one matrix product applies them all."""

    hash: np.ndarray
    hash_bias: np.ndarray
    expert: np.ndarray
    expert_bias: np.ndarray

    @property
    def tables(self) -> int:
        return self.hash.shape[0]

    @property
    def bits(self) -> int:
        return self.hash.shape[1]

    def signatures(self, x: np.ndarray) -> np.ndarray:
        """(n, tables) signed 64-bit signatures: bit b is set if plane b is positive."""
        t, b, d = self.hash.shape
        on = (x @ self.hash.reshape(t * b, d).T + self.hash_bias.reshape(-1) > 0).reshape(len(x), t, b)
        return (on.astype(np.uint64) << np.arange(b, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)

    def projections(self, x: np.ndarray) -> np.ndarray:
        """(n, tables * expert dims) projections."""
        t, e, d = self.expert.shape
        return x @ self.expert.reshape(t * e, d).T + self.expert_bias.reshape(-1)


def _sparse(rng: np.random.Generator, count: int, dim: int, taken: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    rows = np.zeros((count, dim))
    for r in rows:
        w = rng.normal(size=taken)
        r[rng.choice(dim, taken, replace=False)] = w / max(np.linalg.norm(w), 1e-9)
    return rows, spread * rng.normal(size=count)


def make_planes(config: Config, dim: int | None = None) -> Planes:
    """The planes of a configuration: each has ``lsh_dims_per_bit`` entries of unit length together, and a small bias.

    They depend on the seed and the table only, so segments sealed under one configuration share them.
    """
    dim = dim or config.dimension
    taken = min(max(config.lsh_dims_per_bit, 1), dim)
    hashes, experts = [], []
    for table in range(config.lsh_num_tables):
        rng = np.random.default_rng([config.seed, table])
        hashes.append(_sparse(rng, config.lsh_bits_per_table, dim, taken, 0.05))
        experts.append(_sparse(rng, config.lsh_bucket_expert_dims, dim, taken, 0.02))
    return Planes(*(np.stack([p[i] for p in part]) for part in (hashes, experts) for i in (0, 1)))


def planes_frame(spark: SparkSession, planes: Planes) -> DataFrame:
    """The planes as a table (table_id, kind, plane_id, indices, weights, bias)."""
    rows = []
    for kind, weights, bias in (("hash", planes.hash, planes.hash_bias), ("expert", planes.expert, planes.expert_bias)):
        for t in range(weights.shape[0]):
            for p in range(weights.shape[1]):
                at = np.flatnonzero(weights[t, p])
                rows.append((t, kind, p, at.tolist(), weights[t, p, at].tolist(), float(bias[t, p])))
    return spark.createDataFrame(rows, "table_id int, kind string, plane_id int, indices array<int>, weights array<double>, bias double")


def planes_from_rows(rows, tables: int, bits: int, experts: int, dim: int) -> Planes:
    """The inverse of ``planes_frame``, from collected rows."""
    out = Planes(np.zeros((tables, bits, dim)), np.zeros((tables, bits)), np.zeros((tables, experts, dim)), np.zeros((tables, experts)))
    for r in rows:
        w, b = (out.hash, out.hash_bias) if r["kind"] == "hash" else (out.expert, out.expert_bias)
        w[r["table_id"], r["plane_id"], r["indices"]] = r["weights"]
        b[r["table_id"], r["plane_id"]] = r["bias"]
    return out


def probe_masks(bits: int, radius: int) -> list[int]:
    """What to flip in a signature to reach all within ``radius`` bits, as signed longs; the signature itself first."""
    one = [1 << b for b in range(bits)]
    masks = [0]
    if radius >= 1:
        masks += one
    if radius >= 2:
        masks += [a | b for i, a in enumerate(one) for b in one[i + 1 :]]
    return [m - (1 << 64) if m >> 63 else m for m in masks]
