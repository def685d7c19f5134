"""Compaction: which two segments to merge, what it would do, and the merge."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowio import ship
from ..functions.metrics import l2
from .segments import decode_rows

#: Rows that the drift is measured on.
DRIFT_ROWS = 1024
#: Segments that go out at once to be paired.
BLOCK = 1024


def _criterion(n: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """The information criterion over the last axis, of the dimensions with rows."""
    used = n > 0
    fit = np.where(used, -0.5 * n * np.log(2 * math.pi * np.maximum(m2 / np.maximum(n, 1), 1e-12)), 0).sum(axis=-1)
    return fit - 2.0 * used.sum(axis=-1) * np.log(np.maximum(np.where(used, n, 0).sum(axis=-1), 2.0))


def pair_gains(segments: DataFrame, depth_cap: int, newest: int | None = None) -> DataFrame:
    """(left_id, right_id, gain, centroid_distance) of each two segments under the depth cap, the smaller id left; with
    ``newest``, the largest id, only the pairs with it.

    The catalogue, which has one row for a segment, goes out in blocks of BLOCK segments, and each of its rows is
    compared with those of a block at once.
    """
    spark = segments.sparkSession
    ship(spark)
    own = segments.where((F.col("depth") < depth_cap) & (F.col("vector_count") > 0)).select("segment_id", *(F.col(f"root_stats.{c}").alias(c) for c in ("n", "mean", "m2")))
    right = own if newest is None else own.where(F.col("segment_id") == newest)
    blocks = -(-right.count() // BLOCK)
    parts = [spark.createDataFrame([], "left_id long, right_id long, gain double, centroid_distance double")]
    for k in range(blocks):
        rows = right.where(F.pmod(F.xxhash64("segment_id"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast((np.array([r.segment_id for r in rows]), *(np.array([r[c] for r in rows], np.float64) for c in ("n", "mean", "m2"))))

        def run(batches, shared=shared):
            ids, n, mean, m2 = shared.value
            for b in batches:
                for seg, *stats in zip(*(b.column(c).to_pylist() for c in ("segment_id", "n", "mean", "m2"))):
                    at = np.flatnonzero(ids > seg)
                    if not len(at):
                        continue
                    na, ma, sa = map(np.array, stats)
                    nb, mb, sb = n[at], mean[at], m2[at]
                    off = mb - ma
                    both = sa + sb + off * off * na * nb / np.maximum(na + nb, 1)
                    gain = _criterion(na + nb, both) - _criterion(na, sa) - _criterion(nb, sb)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), seg)), pa.array(ids[at]), pa.array(gain), pa.array(np.sqrt((off * off).sum(axis=1)))], ["left_id", "right_id", "gain", "centroid_distance"])

        if rows:
            parts.append(own.mapInArrow(run, "left_id long, right_id long, gain double, centroid_distance double"))
    return reduce(DataFrame.unionByName, parts[1:] or parts)


def best_pair(segments: DataFrame, depth_cap: int) -> DataFrame:
    """The pair with the largest positive gain, the first by ids among equals; no row if there is none."""
    return best_of(pair_gains(segments, depth_cap))


def best_of(gains: DataFrame) -> DataFrame:
    """The best of ``pair_gains``."""
    return gains.where("gain > 0").orderBy(F.desc("gain"), "left_id", "right_id").limit(1)


def merged_rows(codes: DataFrame, segments: DataFrame, left: int, right: int, new_id: int) -> DataFrame:
    """(segment_id, row_id, id, vector) of the two segments as one: decoded, the left one's rows first, ids kept as often
    as they are."""
    rows = decode_rows(codes.where(F.col("segment_id").isin(left, right)), segments)
    n = segments.where(F.col("segment_id") == left).select(F.col("vector_count").cast("int").alias("n"))
    shift = F.when(F.col("segment_id") == right, F.col("n")).otherwise(0)
    return rows.join(F.broadcast(n)).select(F.lit(new_id).cast("long").alias("segment_id"), (F.col("row_id") + shift).cast("int").alias("row_id"), "id", "vector")


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(drift): the distance of the first DRIFT_ROWS decoded rows before and after they were quantised again."""
    pick = lambda df, c: df.where(F.col("row_id") < DRIFT_ROWS).select("row_id", F.col("vector").alias(c))
    both = pick(before, "x").join(pick(after, "y"), "row_id")
    return both.select(F.sum(F.pow(l2("x", "y"), F.lit(2.0))).alias("s")).select(F.sqrt(F.coalesce("s", F.lit(0.0))).alias("drift"))


def report(segments: DataFrame, pair: DataFrame, dimension: int) -> DataFrame:
    """What merging the best pair would do, without the drift: no row if there is no pair."""
    side = lambda s: segments.select(F.col("segment_id").alias(f"{s}_id"), F.col("depth").alias(f"{s}_depth"), F.col("vector_count").alias(f"{s}_count"), F.col("query_visits").alias(f"{s}_visits"))
    rows = pair.join(side("left"), "left_id").join(side("right"), "right_id")
    n = F.col("left_count") + F.col("right_count")
    return rows.select("left_id", "right_id", "left_depth", "right_depth", "left_count", "right_count", "left_visits", "right_visits", "centroid_distance", "gain", n.alias("vectors_rewritten"), (n * dimension * 4).alias("bytes_rewritten"))

