"""Routing: which segments a query is sent to, and why."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arrowio import matrix, ship

#: Queries that go to executors at once; scores that come back in one batch.
QUERY_BLOCK, SCORES = 4096, 1 << 18


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK):
    """Collected blocks (ids, matrix) of ``queries(query_id, vector)``, each of about ``size`` at most, by a hash of the id."""
    queries = queries.where(F.col("vector").isNotNull() & F.col("query_id").isNotNull()).select("query_id", "vector")
    some = queries.limit(size + 1).collect()  # mostly these are all
    blocks = 1 if len(some) <= size else -(-queries.count() // size)
    for k in range(blocks):
        rows = some if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).collect()
        for dim in sorted({len(r.vector) for r in rows}):  # a query of another length meets no segment
            own = [r for r in rows if len(r.vector) == dim]
            yield np.array([r.query_id for r in own], np.int64), np.array([r.vector for r in own], np.float64)


def root_scores(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """(query_id, segment_id, score): the log density of each query under each segment's statistics, over all dimensions.

    Queries go out in blocks and meet the catalogue in numpy, where each segment is a row. A segment of another
    dimension, or an empty one, has no score.
    """
    spark = segments.sparkSession
    ship(spark)
    parts = []
    for ids, q in query_blocks(queries):
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches, shared=shared):
            ids, q = shared.value
            for b in batches:
                own = b.filter(pc.equal(pc.list_value_length(b.column("mu")), q.shape[1]))
                seg, (mu, nu, s2, logc) = own.column("segment_id").to_numpy(), (matrix(own.column(k)) for k in ("mu", "nu", "sigma2", "logc"))
                each = max(1, SCORES // len(ids))
                for a in range(0, len(seg), each):
                    part = range(a, min(a + each, len(seg)))
                    s = np.concatenate([(logc[k] - (nu[k] + 1) / 2 * np.log1p((q - mu[k]) ** 2 / (nu[k] * s2[k]))).sum(axis=1) for k in part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(part))), pa.array(np.repeat(seg[a : a + each], len(ids))), pa.array(s)], ["query_id", "segment_id", "score"])

        post = segments.where("vector_count > 0").select("segment_id", *(F.col(f"root_post.{k}").alias(k) for k in ("mu", "nu", "sigma2", "logc")))
        parts.append(post.mapInArrow(run, "query_id long, segment_id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, segment_id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def route(scores: DataFrame, delta: float) -> DataFrame:
    """``scores`` with mass, cumulative mass (its own included), and whether the segment is selected.

    Masses are the softmax of a query's scores. Segments are taken by score, then by segment_id, until their masses
    come to 1 - delta; delta is held to 0 to 0.99. One is always taken; a query with a NaN score takes all.
    """
    delta = min(max(delta, 0.0), 0.99)
    whole = W.partitionBy("query_id")
    order = whole.orderBy(F.desc("score"), "segment_id")
    odd = F.max(F.isnan("score")).over(whole)
    grown = scores.withColumn("odd", odd).withColumn("e", F.exp(F.col("score") - F.max("score").over(whole)))
    massed = grown.withColumn("mass", F.col("e") / F.sum("e").over(whole))
    before = F.coalesce(F.sum("mass").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    up_to = F.sum("mass").over(order.rowsBetween(W.unboundedPreceding, 0))
    return massed.withColumn("cumulative", up_to).withColumn("selected", F.col("odd") | (before < 1 - delta)).drop("e", "odd")


def explain_routing(scores: DataFrame, delta: float) -> DataFrame:
    """The report on ``route``: target mass, and for each segment its place (selected ones first, by score) and the
    mass reached there; for segments not selected the final mass."""
    routed = route(scores, delta)
    whole = W.partitionBy("query_id")
    final = F.max(F.when(F.col("selected"), F.col("cumulative"))).over(whole)
    place = F.row_number().over(whole.orderBy(F.desc("selected"), F.when(F.col("selected"), -F.col("score")), "segment_id")) - 1
    held = min(max(delta, 0.0), 0.99)
    return routed.select("query_id", F.lit(held).alias("delta"), F.lit(1 - held).alias("target_mass"), place.alias("place"), "segment_id", "score", "mass", F.when(F.col("selected"), F.col("cumulative")).otherwise(final).alias("cumulative_mass"), "selected")
