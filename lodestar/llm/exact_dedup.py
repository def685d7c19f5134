"""Exact deduplication against a minimal perfect hash over the distinct digests of a history."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow, materialize, small_batches, text_key, without

_DROP = SPACES.encode()
#: Mean number of digests in a shard of the hash, and in a bucket of a shard.
SHARD, BUCKET = 512, 4


def _digests(batches):
    for b in batches:
        texts = [(t or "") for t in b.column("text").to_pylist()]
        digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass").translate(None, _DROP)).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(digest, pa.binary()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "text_key", "digest", "n"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, digest, n): SHA-256 of each text without white space, and the code points of the text itself."""
    own = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return arrow(own, _digests, "doc_id long, text_key long, digest binary, n long")


def _number(at: int, size: int) -> Column:
    """``size`` bytes of the digest from byte ``at`` on, as a non-negative long."""
    return F.conv(F.hex(F.substring("digest", at + 1, size)), 16, 10).cast("long")


def _shard(shards: int) -> Column:
    return (_number(0, 7) % shards).cast("int")


def place(f1: np.ndarray, f2: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacements (d0, d1) of each bucket so that slot = (f1 + d0 * f2 + d1) mod n puts n keys on n slots.

    Large buckets go first; a bucket of one key takes any slot that is left, so the last ones need no search.
    """
    n = len(f1)
    f1, f2 = f1 % n, f2 % n
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(bucket.max() + 2))
    d0, d1, slot, taken = np.zeros(len(first) - 1, np.int64), np.zeros(len(first) - 1, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(first[:-1] - first[1:], kind="stable"):
        keys = order[first[b] : first[b + 1]]
        if len(keys) == 0:
            break
        if len(keys) == 1:
            free = int(np.flatnonzero(~taken)[0])
            d1[b], slot[keys], taken[free] = (free - f1[keys[0]]) % n, free, True
            continue
        shifts = np.arange(n)[:, None]
        for d in range(n):
            at = (f1[keys] + d * f2[keys]) % n
            if len(np.unique(at)) < len(keys):
                continue
            fits = np.flatnonzero(~taken[(at + shifts) % n].any(axis=1))
            if len(fits):
                d0[b], d1[b] = d, fits[0]
                slot[keys] = (at + fits[0]) % n
                taken[slot[keys]] = True
                break
        else:
            raise ValueError("no displacement fits")
    return d0, d1, slot


def _parts(digest: bytes, seed: int) -> tuple[int, int, int]:
    h = digest if not seed else hashlib.sha256(bytes([seed]) + digest).digest()
    return tuple(int.from_bytes(h[i : i + 6], "big") for i in (8, 14, 20))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("digest").reset_index(drop=True)
    n, buckets = len(pdf), -(-len(pdf) // BUCKET)
    for seed in range(256):
        parts = np.array([_parts(d, seed) for d in pdf.digest], np.int64)
        try:
            d0, d1, slot = place(parts[:, 0], parts[:, 1], parts[:, 2] % buckets)
            break
        except ValueError:
            continue
    else:
        raise ValueError("no perfect hash found")
    at = np.argsort(slot)
    return pd.DataFrame({"shard": [pdf.shard[0]], "seed": [seed], "n": [n], "buckets": [buckets], "d0": [np.pad(d0, (0, buckets - len(d0)))], "d1": [np.pad(d1, (0, buckets - len(d1)))], "slots": [[{"digest": d, "keep_id": k, "size": s} for d, k, s in zip(pdf.digest[at], pdf.keep_id[at].astype(object).where(pdf.keep_id[at].notna(), None), pdf["size"][at])]]})


_INDEX = "shard int, seed int, n long, buckets long, d0 array<long>, d1 array<long>, slots array<struct<digest: binary, keep_id: long, size: long>>"


def _winner() -> list[Column]:
    return [F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))["doc_id"].alias("keep_id"), F.count("*").alias("size")]


def build_index(rows: DataFrame) -> tuple[DataFrame, int]:
    """The minimal perfect hash over the distinct digests of ``rows(doc_id, digest, n)``, and its number of shards.

    One row a shard of about ``SHARD`` digests: displacements, and for each slot the full digest, the doc_id of the
    winning row and the number of rows. Repeats meet in a combining aggregate before any shard is built, so a shard
    holds distinct digests only and its size does not depend on how often one of them occurs.
    """
    distinct = materialize(rows.groupBy("digest").agg(*_winner()), "exact-distinct")
    shards = max(1, distinct.count() // SHARD)
    small_batches(rows.sparkSession)
    return materialize(distinct.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, _INDEX), "exact-index"), shards


def lookup(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``rows(doc_id, text_key, digest, n)`` with (member, keep_id, size) from the slot that the hash names.

    A slot counts only if the digest in it is the row's, byte for byte. Skewed shards are split by the adaptive join.
    """
    base = rows.withColumn("shard", _shard(shards)).join(index.withColumnRenamed("n", "n_slots"), "shard", "left")
    h = F.when(F.col("seed") == 0, F.hex("digest")).otherwise(F.upper(F.sha2(F.concat(F.unhex(F.lpad(F.hex("seed"), 2, "0")), F.col("digest")), 256)))
    part = lambda i: F.conv(F.substring(h, 2 * i + 1, 12), 16, 10).cast("long")
    bucket = (part(20) % F.col("buckets")).cast("int")
    d0, d1, n = F.get("d0", bucket), F.get("d1", bucket), F.col("n_slots")
    slot = F.get("slots", ((part(8) % n + d0 * (part(14) % n) + d1) % n).cast("int"))
    hit = F.coalesce(slot["digest"] == F.col("digest"), F.lit(False))
    return base.select("doc_id", "text_key", "digest", rows["n"], hit.alias("member"), F.when(hit, slot["keep_id"]).alias("keep_id"), F.when(hit, slot["size"]).alias("size"))


def _verdicts(docs: DataFrame, history: DataFrame | None) -> DataFrame:
    """``exact_duplicates`` with the ``text_key`` of each row."""
    rows = materialize(digests(docs), "exact-digests")
    past = rows if history is None else digests(history)
    index, shards = build_index(past)
    found = lookup(rows, index, shards)
    own = history is None
    same = F.col("keep_id").eqNullSafe(F.col("doc_id"))
    verdict = lambda df, kept: df.select("doc_id", "text_key", "digest", "keep_id", F.col("size").alias("group_size"), kept.alias("kept"))
    out = verdict(found.where("member"), same if own else F.lit(False))
    if not own:
        new = found.where("NOT member").select("doc_id", "text_key", "digest", "n")
        out = out.unionByName(verdict(new.join(new.groupBy("digest").agg(*_winner()), "digest"), same))
    return out.select("doc_id", "text_key", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs(doc_id, text)``.

    Texts are equal when identical without white space; a null text counts as empty. Of equal texts the row with
    the most code points, then the smallest doc_id stays (a null doc_id only if there is no other). ``history`` is
    an earlier corpus of the same columns, over which the hash is built: a text in it is a repeat of the row that
    stayed there and ``kept`` is false. Texts that aren't members are grouped among themselves. Without a history
    the table is its own. Rows of a doc_id whose texts are equal share a verdict, as keep_id names the doc_id alone;
    other columns are ignored.
    """
    return _verdicts(docs, history).drop("text_key")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; rows without doc_id all stay."""
    return without(docs, _verdicts(docs.select("doc_id", "text"), None).where("NOT kept"))
