"""Helpers that the text operators share: Arrow passes, shared storage, folds, graph components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.arrowio import ship

#: White space of the word rules: space and tab to carriage return. ``bytes.split()`` splits at the same six.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = getattr(spark.sparkContext, "_lodestar_dir", None)
        if at is None:
            at = spark.sparkContext._lodestar_dir = tempfile.mkdtemp(prefix="lodestar-shared-")
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has written with ``materialize``, when no result of it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestar/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *dfs: DataFrame) -> None:
    """Remove tables of ``materialize`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in dfs:
        for f in {re.sub(r"/[^/]*$", "", x) for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            if "/lodestar/" in f:
                path.getFileSystem(conf).delete(path, True)


#: Rows and bytes of an Arrow batch: texts can be long, and a kernel holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Make the code importable in Python workers, and bound what a batch holds. The session's own limits stay if lower."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"[^-\d]", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def arrow(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in small batches."""

    def run(batches):
        yield from fn(batches)
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows that may be broadcast to a filter: two longs each.
BROADCAST_IDS = 400_000


def text_key() -> Column:
    """What tells apart texts that claim one doc_id, and rows without any."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text aren't in ``gone(doc_id, text_key)``; rows without doc_id all stay.

    So of rows that share a doc_id only those with a text that has to go do. Up to BROADCAST_IDS keys are broadcast, so
    that texts needn't be shuffled; more are joined by shuffle.
    """
    keys = materialize(gone.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct(), "without")
    own = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    return docs.join(own, (docs["doc_id"].cast("long") == F.col("_gone_id")) & (text_key() == F.col("_gone_key")), "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only. Pure ASCII takes the byte-wise function, which then does the same."""
    slow = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(slow)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % modulus


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected graph ``edges(a, b)``: (node, root), root the smallest node.

    Alternates large-star and small-star steps until no edge changes, so the number of rounds grows with the
    logarithm of a component's size. Neighbourhood minima are combined before the shuffle; no neighbourhood is
    ever gathered in one place. Empty input gives an empty result.
    """
    e = materialize(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), name)
    spark = edges.sparkSession

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        low2 = large.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").groupBy("u").agg(F.min("v").alias("m"))
        small = large.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").join(low2, "u").selectExpr("v AS u", "m AS v").where("u <> v")
        new = materialize(small.unionByName(low2.selectExpr("u", "m AS v")).distinct(), name)
        now = mark(new)
        discard(spark, e)
        e = new
        if now == seen:
            break
        seen = now
    return e.selectExpr("u AS node", "v AS root").unionByName(e.selectExpr("v AS node", "v AS root")).groupBy("node").agg(F.min("root").alias("root"))
