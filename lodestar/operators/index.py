"""The hash index of segments: postings, and buckets with statistics of the rows in them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nig
from ..functions.arrowio import lists, matrix, ship
from .planes import Planes


def hashed(rows: DataFrame, planes: Planes, keys: list[str]) -> DataFrame:
    """``rows(*keys, vector)`` as (*keys, sigs, proj): signatures for each table, projections for each table and expert
    dimension. The planes are a few numbers for each table and go out as a broadcast."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(planes)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vector"))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), lists(shared.value.signatures(x), pa.int64()), lists(shared.value.projections(x), pa.float64())], [*keys, "sigs", "proj"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, "vector").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sigs array<long>, proj array<double>")


def by_table(rows: DataFrame, keys: list[str], experts: int) -> DataFrame:
    """One row for each table: (*keys, table_id, sig, proj) with the table's projections only."""
    each = rows.select(*keys, "proj", F.posexplode("sigs").alias("table_id", "sig"))
    return each.select(*keys, "table_id", "sig", F.slice("proj", F.col("table_id") * experts + 1, experts).alias("proj"))


def postings(tables: DataFrame) -> DataFrame:
    return tables.select("segment_id", "table_id", "sig", "row_id")


def experts(tables: DataFrame, dims: int) -> DataFrame:
    """(segment_id, table_id, sig, cnt, stats, post): rows of each bucket and, for each expert dimension, (n, mean, m2)
    of their projections with the posterior. One aggregation, combined before the shuffle."""
    sums = [F.count("*").alias("cnt")]
    for j in range(dims):
        v = F.get("proj", F.lit(j))
        sums += [F.avg(v).alias(f"mean{j}"), F.var_pop(v).alias(f"var{j}")]
    got = tables.groupBy("segment_id", "table_id", "sig").agg(*sums)
    n = F.col("cnt").cast("double")
    stat = lambda j: F.struct(n.alias("n"), F.col(f"mean{j}").alias("mean"), (F.col(f"var{j}") * n).alias("m2"))
    out = got.select("segment_id", "table_id", "sig", "cnt", F.array(*map(stat, range(dims))).alias("stats"))
    return out.withColumn("post", F.transform("stats", lambda s: nig.posterior(s["n"], s["mean"], s["m2"])))


def bucket_counts(tables: DataFrame) -> DataFrame:
    """(segment_id, table_id, buckets): distinct signatures in each table."""
    return tables.groupBy("segment_id", "table_id").agg(F.countDistinct("sig").alias("buckets"))
