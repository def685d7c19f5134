"""Settings of a store. Setters clamp, as documented for each."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass


def _within(x, low, high):
    return min(max(x, low), high)


@dataclass(frozen=True)
class Config:
    """Defaults, which are fixed values as stores depend on them, suit 128 dimensions. Values beyond their range are moved to its nearest end."""

    dimension: int = 128
    lsh_num_tables: int = 8
    lsh_bits_per_table: int = 16
    lsh_dims_per_bit: int = 8
    lsh_probe_hamming_radius: int = 1
    lsh_bucket_expert_dims: int = 4
    lsh_max_candidates: int = 2048
    lsh_min_candidates: int = 384
    lsh_adaptive_gamma: float = 2.2
    delta: float = 0.05
    seed: int = 42
    segment_capacity_mb: int = 100
    num_workers: int = 2
    seal_queue_capacity: int = 2
    compaction_depth_cap: int = 3
    compaction_trigger: int = 8
    #: Rows in a segment; None: what ``segment_capacity_mb`` holds.
    max_segment_rows: int | None = None

    def __post_init__(self):
        if self.dimension < 1:
            raise ValueError("dimension must be 1 or more")
        put = lambda k, v: object.__setattr__(self, k, v)
        put("lsh_num_tables", max(1, self.lsh_num_tables))
        put("lsh_bits_per_table", _within(self.lsh_bits_per_table, 1, 64))
        put("lsh_dims_per_bit", max(1, self.lsh_dims_per_bit))
        put("lsh_probe_hamming_radius", _within(self.lsh_probe_hamming_radius, 0, 2))
        put("lsh_bucket_expert_dims", max(1, self.lsh_bucket_expert_dims))
        put("lsh_max_candidates", max(64, self.lsh_max_candidates))
        put("lsh_min_candidates", _within(self.lsh_min_candidates, 32, self.lsh_max_candidates))
        put("lsh_adaptive_gamma", _within(self.lsh_adaptive_gamma, 0.5, 4.0))
        put("delta", _within(self.delta, 0.0, 1.0))
        put("num_workers", max(1, self.num_workers))
        put("seal_queue_capacity", max(1, self.seal_queue_capacity))

    def with_(self, **changes) -> Config:
        return dataclasses.replace(self, **changes)

    @property
    def max_active_vectors(self) -> int:
        """Rows that a segment takes before it is full."""
        return max(1, self.max_segment_rows if self.max_segment_rows is not None else (self.segment_capacity_mb << 20) // (4 * self.dimension))

    def as_dict(self) -> dict:
        return dataclasses.asdict(self)

    @property
    def planes_key(self) -> str:
        """What the hash planes depend on, as a short text."""
        own = {k: v for k, v in self.as_dict().items() if k in ("dimension", "lsh_num_tables", "lsh_bits_per_table", "lsh_dims_per_bit", "lsh_bucket_expert_dims", "seed")}
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:16]
