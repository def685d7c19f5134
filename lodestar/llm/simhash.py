"""SimHash near-duplicates by multi-index hashing over fingerprint segments."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, components, materialize, text_key, without

SEED = 42
#: Shingles hashed and counted at once, so that a very long text needs no more memory than this many.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - width].tolist(), ends[width - 1 :].tolist()
    n, digest, ones = len(starts), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches, width=3):
    for b in batches:
        fp = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fp)], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint of every row as a signed long."""
    own = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return arrow(own, lambda it: _fingerprints(it, width), "doc_id long, text_key long, fp long")


def _keys(parts: int) -> tuple[str, str]:
    """SQL for the table keys and the probe keys of ``fp`` when it is cut into ``parts`` segments.

    Table i leaves segment i out. Two fingerprints at most 2 bits apart agree in all the rest of some table, or
    differ there in one bit, and the latter in one of the first tables: so these are probed with the Hamming ball
    of radius 1 and the last one with radius 0. Of two that differ in a bit one has a zero there, so it is enough
    to set zero bits.
    """
    width = 64 // parts
    segment = [((1 << width) - 1) << (width * i) for i in range(parts)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables, probes = [], []
    for i, s in enumerate(segment):
        rest = ((1 << 64) - 1) ^ s
        tables.append(f"struct({i} AS t, fp & {signed(rest)}L AS k)")
        if i < parts - 1:
            bits = ",".join(f"{signed(1 << b)}L" if b < 63 else "shiftleft(1L, 63)" for b in range(64) if rest >> b & 1)
            probes.append(f"transform(filter(array({bits}), b -> fp & b = 0), b -> struct({i} AS t, fp & {signed(rest)}L | b AS k))")
    return f"array({','.join(tables)})", f"concat({','.join(probes)})"


def links(fps: DataFrame, bits: int = 2, bucket: int = 256) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints ``fps(fp)`` that differ in ``bits`` (2) bits or fewer.

    Buckets of more than ``bucket`` entries are not paired off: the fingerprints in them, and those whose probes
    meet one, go on to the next table set, whose keys leave out a smaller segment (32, 16, then 8 bits). In the last
    one, a bucket has no more than 2**8 members by construction, so the work stays in proportion to the input however
    skewed that is.
    """
    if bits != 2:
        raise ValueError("the key scheme is for 2 bits")
    found, todo = [], fps.select("fp")
    for parts in (2, 4, 8):
        tables, probes = _keys(parts)
        table = todo.select("fp", F.expr(f"inline({tables})"))
        probe = todo.select("fp", F.expr(f"inline({probes})"))
        hot = None
        if parts < 8:
            hot = materialize(table.groupBy("t", "k").count().where(F.col("count") > bucket).select("t", "k"), "simhash-hot")
            if hot.isEmpty():
                hot = None
        if hot is not None:
            heavy = table.unionByName(probe).join(hot, ["t", "k"], "left_semi").select("fp").distinct()
            table = table.join(hot, ["t", "k"], "left_anti")
        same = table.alias("x").join(table.alias("y"), ["t", "k"]).where("x.fp < y.fp").selectExpr("x.fp AS a", "y.fp AS b")
        near = probe.alias("x").join(table.alias("y"), ["t", "k"]).selectExpr("least(x.fp, y.fp) AS a", "greatest(x.fp, y.fp) AS b")
        found.append(same.unionByName(near).where("bit_count(a ^ b) <= 2 AND a <> b").distinct())
        if hot is None:
            break
        todo = materialize(heavy, "simhash-heavy")
    return reduce(DataFrame.unionByName, found).distinct()


def _labelled(docs: DataFrame, width: int) -> DataFrame:
    """``near_duplicates`` with the ``text_key`` of each row."""
    prints = materialize(fingerprints(docs, width), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = components(links(nodes), "simhash-graph")
    named = nodes.join(roots, nodes.fp == roots.node, "left").selectExpr("fp", "low", "coalesce(root, fp) AS root")
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    label = named.join(low, "root").select("fp", "component_id")
    return prints.join(label, "fp").select("doc_id", "text_key", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``.

    Fingerprints at most 2 bits apart are linked; component_id is the smallest doc_id that links reach, its own
    included. Equal fingerprints are one node, so copies are never paired off. Null and empty texts have
    fingerprint zero and are linked like any other; a null doc_id takes part but never names a component unless all
    in it are null; repeated rows come out as often as they came in; other columns are ignored.
    """
    return _labelled(docs, width).drop("text_key")


def representatives(docs: DataFrame, width: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their near-duplicate component; rows without doc_id all stay."""
    return without(docs, _labelled(docs.select("doc_id", "text"), width).where("doc_id <> component_id"))
