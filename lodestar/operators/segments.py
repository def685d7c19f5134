"""Segments: assignment by arrival, and what is computed of one when it is sealed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import nig, sq8
from ..functions.arrowio import lists, matrix, ship

_PARTIAL = "segment_id long, n double, norms double, means array<double>, m2s array<double>, lows array<double>, highs array<double>"


def ordinals(rows: DataFrame, order: str = "ord") -> DataFrame:
    """``rows`` with ``at``: their numbers from 0 on in the order of ``order``.

    ``order`` holds stored values of ``monotonically_increasing_id``: rows are numbered within each value of the part
    above its low 33 bits, and only the counts of these parts are summed up in one place.
    """
    part = F.shiftright(order, 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    start = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    placed = rows.withColumn("_part", part).withColumn("_row", inside).join(start, "_part")
    return placed.select(*rows.columns, (F.col("_start") + F.col("_row")).cast("long").alias("at"))


def assign_segments(rows: DataFrame, capacity: int, first: int = 0, at: str = "at") -> DataFrame:
    """``rows`` with segment_id and row_id: every ``capacity`` rows by arrival make a segment, from id ``first`` on."""
    return rows.select("*", (F.floor(F.col(at) / capacity) + first).cast("long").alias("segment_id"), (F.col(at) % capacity).cast("int").alias("row_id"))


def _partials(batches):
    for b in batches:
        if not b.num_rows:
            continue
        seg, x = b.column("segment_id").to_numpy(), matrix(b.column("vector"))
        order = np.argsort(seg, kind="stable")
        seg, x = seg[order], x[order]
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        n = np.diff(np.append(first, len(seg))).astype(float)
        mean = np.add.reduceat(x, first) / n[:, None]
        m2 = np.add.reduceat((x - np.repeat(mean, n.astype(int), axis=0)) ** 2, first)
        own = [lists(v, pa.float64()) for v in (mean, m2, np.fmin.reduceat(x, first), np.fmax.reduceat(x, first))]
        yield pa.RecordBatch.from_arrays([pa.array(seg[first]), pa.array(n), pa.array(np.add.reduceat(np.sqrt((x * x).sum(axis=1)), first)), *own], ["segment_id", "n", "norms", "means", "m2s", "lows", "highs"])


def segment_stats(rows: DataFrame) -> DataFrame:
    """(segment_id, vector_count, mean_norm, centroid, min_vals, max_vals, root_stats) of ``rows(segment_id, vector)``.

    Batches are summed up in numpy, so that the shuffle has a few rows for each segment and batch; sums of squares
    are taken about the mean on both levels. root_stats is (n, mean, m2) for each dimension. A NaN is no minimum or
    maximum.
    """
    ship(rows.sparkSession)
    part = rows.select("segment_id", "vector").mapInArrow(_partials, _PARTIAL)
    each = part.select("segment_id", "n", F.posexplode(F.arrays_zip("means", "m2s", "lows", "highs")).alias("pos", "v"))
    w = W.partitionBy("segment_id", "pos")
    total, mean = F.sum("n").over(w), F.sum(F.col("n") * F.col("v.means")).over(w) / F.sum("n").over(w)
    off = each.select("segment_id", "pos", "n", "v", total.alias("total"), mean.alias("mean"))
    by_dim = off.groupBy("segment_id", "pos").agg(
        F.first("total").alias("n"), F.first("mean").alias("mean"),
        F.sum(F.col("v.m2s") + F.col("n") * (F.col("v.means") - F.col("mean")) * (F.col("v.means") - F.col("mean"))).alias("m2"),
        F.min("v.lows").alias("lo"), F.max("v.highs").alias("hi"),
    )
    listed = F.array_sort(F.collect_list(F.struct("pos", "n", "mean", "m2", "lo", "hi")))
    stats = by_dim.groupBy("segment_id").agg(listed.alias("d"))
    norms = part.groupBy("segment_id").agg(F.sum("n").cast("long").alias("vector_count"), (F.sum("norms") / F.sum("n")).alias("mean_norm"))
    return stats.join(norms, "segment_id").select(
        "segment_id", "vector_count", "mean_norm", F.col("d.mean").alias("centroid"), F.col("d.lo").alias("min_vals"), F.col("d.hi").alias("max_vals"),
        F.transform("d", lambda x: F.struct(x["n"].alias("n"), x["mean"].alias("mean"), x["m2"].alias("m2"))).alias("root_stats"),
    )


def with_posteriors(segments: DataFrame) -> DataFrame:
    """Segments with root_post: what a routing score needs of each dimension, worked out once."""
    return segments.withColumn("root_post", F.transform("root_stats", lambda s: nig.posterior(s["n"], s["mean"], s["m2"])))


def _encoded(batches):
    for b in batches:
        if not b.num_rows:
            continue
        x, lo, hi, c = (matrix(b.column(k)) for k in ("vector", "min_vals", "max_vals", "centroid"))
        yield pa.RecordBatch.from_arrays([b.column("segment_id"), b.column("row_id"), b.column("id"), lists(sq8.encode_block(x, lo, hi), pa.int16()), pa.array(((x - c) ** 2).sum(axis=1))], ["segment_id", "row_id", "id", "codes", "off"])


def encode_rows(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(segment_id, row_id, id, codes, off): the 8-bit codes of each row and its squared distance to the centroid."""
    ship(rows.sparkSession)
    joined = rows.select("segment_id", "row_id", "id", "vector").join(stats.select("segment_id", "min_vals", "max_vals", "centroid"), "segment_id")
    return joined.mapInArrow(_encoded, "segment_id long, row_id int, id long, codes array<smallint>, off double")


def radius(encoded: DataFrame) -> DataFrame:
    """(segment_id, radius_sq): the largest squared distance to the centroid."""
    return encoded.groupBy("segment_id").agg(F.max("off").alias("radius_sq"))


def decode_rows(codes: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, row_id, id, vector): what is left of each row after quantisation."""
    both = codes.join(segments.select("segment_id", "min_vals", "max_vals"), "segment_id")
    return both.select("segment_id", "row_id", "id", sq8.decode(F.col("codes"), F.col("min_vals"), F.col("max_vals")).alias("vector"))


def external_ids(codes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(segment_id, row_id)`` with the id there, null out of range."""
    return wanted.join(codes.select("segment_id", "row_id", "id"), ["segment_id", "row_id"], "left")

