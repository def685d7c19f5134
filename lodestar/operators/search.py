"""Nearest-neighbour search: exact, over codes, and through the index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from ..errors import InvalidVectorDimension
from ..functions import sq8
from ..functions.arrowio import matrix, ship
from ..functions.metrics import resolve
from . import candidates, index, routing
from .planes import Planes, probe_masks

#: Rows that may be broadcast; pairs of a query and a segment that the driver plans with; segments named in a filter.
BROADCAST_ROWS, PAIRS, PRUNED = 1_000_000, 200_000, 2000


def finish(found: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(query_id, rank, id, distance) of ``found(query_id, id, distance)``: the k nearest ids of each query.

    Distances above ``threshold`` go first; then an id's smallest distance counts, where NaN is infinity; ties go by
    id. There may be fewer than k.
    """
    if threshold is not None:
        found = found.where((F.col("distance") <= threshold) | F.isnan("distance"))
    best = found.groupBy("query_id", "id").agg(F.min(F.when(F.isnan("distance"), float("inf")).otherwise(F.col("distance"))).alias("distance"))
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def nearest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances (q, different ids), those ids): for each query an id's least distance, and NaN for ids that can't be among
    the k nearest. NaN in ``d`` is no distance."""
    known, at = np.unique(ids, return_inverse=True)
    if len(known) < len(ids):
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(known)))
        d, ids = np.fmin.reduceat(d[:, order], first, axis=1), known
    if d.shape[1] > k:
        low = np.where(np.isnan(d), np.inf, d)
        edge = np.partition(low, k - 1, axis=1)[:, k - 1 : k] if k else np.full((len(d), 1), -np.inf)
        d = np.where(low <= edge, d, np.nan)
    return d, ids


def exact_knn(rows: DataFrame, queries: DataFrame, k: int, metric: str | Callable = "l2", threshold: float | None = None) -> DataFrame:
    """The k nearest of all ``rows(id, vector)`` to each of ``queries(query_id, vector)``: (query_id, rank, id, distance).

    Queries go out in blocks of a bounded size; each Arrow batch of rows is compared with a block in numpy and passes
    on its k nearest ids for each query, so what is shuffled doesn't grow with the vectors. A query of another
    length than the rows has no result. ``metric`` is a name or a function of two matrices.
    """
    spark = rows.sparkSession
    ship(spark)
    distance = resolve(metric)
    parts = []
    for ids, q in routing.query_blocks(queries):
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches, shared=shared):
            ids, q = shared.value
            for b in batches:
                x, own = matrix(b.column("vector")), b.column("id").to_numpy()
                if not len(x) or x.shape[1] != q.shape[1]:
                    continue
                d = distance(q, x)
                d = np.where(np.isnan(d), np.inf, d) if threshold is None else np.where(d > threshold, np.nan, np.where(np.isnan(d), np.inf, d))
                d, own = nearest(d, own, k)
                at, col = np.nonzero(~np.isnan(d))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(own[col]), pa.array(d[at, col])], ["query_id", "id", "distance"])

        parts.append(rows.where(F.col("vector").isNotNull()).select(F.col("id").cast("long"), "vector").mapInArrow(run, "query_id long, id long, distance double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance double")
    return finish(reduce(DataFrame.unionByName, parts), k)


def check_dimension(queries: DataFrame, dim: int) -> None:
    """An error if a query has another length; batches without this check give such a query no result."""
    if not queries.where(F.size("vector") != dim).isEmpty():
        raise InvalidVectorDimension(f"a query doesn't have {dim} entries")


def _reranked(batches, distance, decoded):
    for b in batches:
        if not b.num_rows:
            continue
        q, codes, lo, hi = (matrix(b.column(c)) for c in ("vector", "codes", "min_vals", "max_vals"))
        if decoded:
            x = sq8.decode_block(codes, lo, hi)
            d = np.empty(len(q))
            qid = b.column("query_id").to_numpy()
            order = np.argsort(qid, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(qid[order]) != 0]))
            for part in np.split(order, cut[1:]):
                d[part] = distance(q[part[:1]], x[part])[0]
        else:
            d = sq8.adc_block(q, codes, lo, hi)
        yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("id"), pa.array(d)], ["query_id", "id", "distance"])


def rerank(chosen: DataFrame, codes: DataFrame, segments: DataFrame, queries: DataFrame, metric: str | Callable = "adc", plan: Plan | None = None, budget: int = 1 << 40) -> DataFrame:
    """(query_id, id, distance) of ``chosen(query_id, segment_id, row_id)``: codes are joined last, for these rows only.

    ``adc`` compares the plain query with the codes; any other metric with the decoded vectors. With a plan and the
    budget of each of its pairs, codes and ranges are pruned, and what is small enough goes to the codes.
    """
    ship(codes.sparkSession)
    ranges, own = segments.select("segment_id", "min_vals", "max_vals"), queries.select("query_id", "vector")
    picked = chosen.select("query_id", "segment_id", "row_id")
    if plan is not None:
        codes, ranges, own = plan.prune(codes), plan.prune(ranges), small(own, plan.queries)
        if plan.pairs is not None:
            picked, ranges = small(picked, len(plan.pairs) * budget), small(ranges, 100 * len(plan.segments))
    pairs = codes.join(picked, ["segment_id", "row_id"]).join(ranges, "segment_id").join(own, "query_id")
    distance = None if metric == "adc" else resolve(metric)
    return pairs.select("query_id", "id", "vector", "codes", "min_vals", "max_vals").mapInArrow(lambda it: _reranked(it, distance, metric != "adc"), "query_id long, id long, distance double")


@dataclass(frozen=True)
class Plan:
    """What routing has decided for a batch: the number of queries, the pairs (query_id, segment_id) and their segments.
    ``pairs`` None: more than PAIRS, so they stay distributed in ``selected``."""

    queries: int
    selected: DataFrame
    pairs: list[tuple[int, int]] | None

    @property
    def segments(self) -> list[int] | None:
        return None if self.pairs is None else sorted({s for _, s in self.pairs})

    @property
    def spread(self) -> int:
        """Segments of the query that has most."""
        return max(Counter(q for q, _ in self.pairs).values(), default=0) if self.pairs is not None else 1 << 40

    def prune(self, table: DataFrame) -> DataFrame:
        """A table of segments without partitions that no query goes to."""
        return table if self.segments is None or len(self.segments) > PRUNED else table.where(F.col("segment_id").isin(self.segments))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it can't have more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def plan_search(queries: DataFrame, segments: DataFrame, delta: float) -> Plan:
    """Route a batch. This runs at once, on the catalogue alone, so that the tables can be pruned by literal ids."""
    routed = routing.route(routing.root_scores(queries, segments), delta).where("selected").select("query_id", "segment_id")
    got = [(r.query_id, r.segment_id) for r in routed.limit(PAIRS + 1).collect()]
    if len(got) > PAIRS:
        return Plan(queries.count(), routed, None)
    own = segments.sparkSession.createDataFrame(got, "query_id long, segment_id long")
    return Plan(len({q for q, _ in got}), F.broadcast(own), got)


def ann_candidates(queries: DataFrame, segments: DataFrame, experts: DataFrame, postings: DataFrame, planes: Planes, config: Config, delta: float, plan: Plan | None = None) -> tuple[DataFrame, Plan]:
    """(candidate rows within budget, the plan) for a batch of queries.

    Buckets and postings are read where they stand: the probes, then the buckets found, go to them as broadcasts,
    as long as queries, tables, probes and segments multiply to BROADCAST_ROWS at most; beyond it they are shuffled.
    """
    plan = plan or plan_search(queries, segments, delta)
    counts = plan.prune(segments).select("segment_id", "vector_count")
    selected = small(plan.selected.join(counts, "segment_id"), len(plan.pairs) if plan.pairs is not None else 1 << 40)
    hashed = index.hashed(queries.where(F.size("vector") == planes.hash.shape[2]), planes, ["query_id"])
    tables = index.by_table(hashed, ["query_id"], planes.expert.shape[1])
    radius = candidates.effective_radius(config, delta)
    probes = plan.queries * planes.tables * len(probe_masks(planes.bits, radius))
    looked_up = small(candidates.probes(tables, planes.bits, radius), probes)
    buckets = small(candidates.bucket_scores(looked_up, plan.prune(experts), selected), probes * plan.spread)
    evidence = candidates.row_evidence(buckets, plan.prune(postings))
    return candidates.within_budget(evidence, config), plan
