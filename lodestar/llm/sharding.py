"""Sharding by a k-d tree over document metadata, in DataFrame operations only."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

#: Bins of a histogram; each pass narrows a cut down by this factor.
BINS = 512
#: A cut is even enough if it misses its aim by this share of its node's weight; else the text at it is put to one side by
#: itself and the cut sought again, so many times in a node at most, and the best one counts.
EVEN, APART = 0.001, 8
#: Bytes of a name, after what all names begin with, that make its place on its dimension.
NAME_BYTES = 6
#: Rows that one task numbers.
BLOCK_ROWS = 20_000


def _spread(names: DataFrame, column: str) -> int:
    """How many bytes all names begin with: those that the first and the last one share."""
    low, high = names.agg(F.min(column), F.max(column)).first()
    return len(os.path.commonprefix([bytes(low or b""), bytes(high or b"")]))


def groups(docs: DataFrame) -> DataFrame:
    """One row for each distinct text: its digest, weight in bytes over all copies, and the dimensions of the tree.

    The dimensions are metadata: the size (as a logarithm), the source, the language and the doc_id, each the least of all
    copies, so that copies can't be told apart. Names stand in alphabetical order, so a cut parts what comes before a name
    from what comes after it: the first NAME_BYTES bytes beyond what all have in common are a number.
    """
    has = {c for c, _ in docs.dtypes}
    name = lambda c: F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "utf-8") if c in has else F.lit(b"")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), size.alias("size"), name("source").alias("source"), name("lang").alias("lang"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"))
    found = materialize(rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.min("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("doc_id").alias("low")), "kd-texts")
    number = lambda c: F.conv(F.rpad(F.hex(F.substring(c, _spread(found, c) + 1, NAME_BYTES)), 2 * NAME_BYTES, "0"), 16, 10).cast("double")
    x = F.array(F.log2("size"), number("source"), number("lang"), F.col("low").cast("double"))
    return found.select("digest", "weight", x.alias("x"), (F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("double") / float(1 << 48)).alias("tie"))


_STATE = "node: bigint, d: int, lo: double, wide: double, value: double, want: double, apart: array<struct<v: double, t: double>>"
_CUT = "node: bigint, d: int, cut_value: double, cut_tie: double, keep: boolean, apart: array<struct<v: double, t: double, left: boolean>>"


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows as a table, from a literal; to be broadcast."""
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))))


def _split(rows: DataFrame, parts: dict[int, tuple[int, int]], total: list[float]) -> list[dict]:
    """A cut for each of the nodes ``parts`` (node: (leaves left of the cut, leaves)), as rows of _CUT.

    Two histograms are narrowed down for all nodes at once: first over values of the widest dimension, until a bin
    holds one value, then over the tie breaker within the value at the cut. If a heavy text at the cut leaves
    the sides uneven, it is put to the better side and the cut is sought again among the others. Nodes meet the
    rows in a broadcast of one row for each, the sums of the bins are added up where they are, and the driver gets
    the bin at the cut: one row for each node and pass, whatever the size of the table.
    """
    spark, dims = rows.sparkSession, len(total)
    spans = rows.groupBy("node").agg(F.sum("weight").alias("w"), *[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    state = {}
    for r in spans:
        if r["node"] in parts:
            widths = [(r[f"hi{i}"] - r[f"lo{i}"]) / total[i] if total[i] else 0.0 for i in range(dims)]
            d = max(range(dims), key=lambda i: (widths[i], -i))
            left, leaves = parts[r["node"]]
            ends = (r[f"lo{d}"], r[f"hi{d}"])
            state[r["node"]] = {"d": d, "lo": ends[0], "hi": ends[1], "want": r["w"] * left / leaves, "all": r["w"], "value": None, "before": 0, "keep": True, "tie": 0.0, "apart": [], "ends": ends, "best": None}
    todo = set(state)
    v, inside = F.when(F.col("value").isNull(), F.col("x")[F.col("d")]).when(F.col("x")[F.col("d")] == F.col("value"), F.col("tie")), F.col("v") - F.col("lo")
    bin_ = F.when(F.col("wide") == 0, F.lit(0)).otherwise(F.least(F.lit(BINS - 1), F.floor(inside / F.col("wide") * BINS))).cast("int")
    while todo:
        now = [{"node": k, "d": s["d"], "lo": s["lo"], "wide": s["hi"] - s["lo"], "value": s["value"], "want": float(s["want"] - s["before"]), "apart": s["apart"]} for k, s in state.items() if k in todo]
        met = rows.join(_table(spark, now, _STATE), "node")
        met = met.where("NOT exists(apart, a -> a.v = x[d] AND a.t = tie)").withColumn("v", v).where("v >= lo AND v <= lo + wide")
        sums = met.groupBy("node", "want", bin_.alias("bin")).agg(F.sum("weight").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("w").over(W.partitionBy("node").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        marked = sums.withColumn("before", before).withColumn("over", F.col("before") + F.col("w") >= F.col("want"))
        # the first bin that goes over what is wanted, or the last one
        at = F.min(F.struct(~F.col("over"), F.when(F.col("over"), F.col("bin")).otherwise(-F.col("bin")), "before", "w", "lo", "hi")).alias("at")
        found = {r["node"]: r["at"] for r in marked.groupBy("node").agg(at).collect()}
        for k in list(todo):
            s, r = state[k], found.get(k)
            if r is None:  # all of it was put to one side or the other
                if abs(s["want"]) < s["best"][0]:
                    s["best"] = abs(s["want"]), s["ends"][0], 0.0, False, list(s["apart"])
                todo.discard(k)
                continue
            s["before"] += r["before"]
            s["lo"], s["hi"] = r["lo"], r["hi"]
            if r["lo"] < r["hi"]:
                continue
            if s["value"] is None:
                s |= {"value": r["lo"], "lo": 0.0, "hi": 1.0}
                continue
            # the text at the cut goes to the side that it makes the more even
            s["tie"], s["keep"] = r["lo"], 2 * (s["want"] - s["before"]) >= r["w"]
            miss = abs(s["want"] - s["before"] - r["w"] * s["keep"])
            if s["best"] is None or miss < s["best"][0]:
                s["best"] = miss, s["value"], s["tie"], s["keep"], list(s["apart"])
            if miss <= EVEN * s["all"] or len(s["apart"]) == APART:
                todo.discard(k)
                continue
            s["apart"].append({"v": s["value"], "t": s["tie"], "left": s["keep"]})
            s["want"] -= r["w"] * s["keep"]
            s |= {"value": None, "lo": s["ends"][0], "hi": s["ends"][1], "before": 0}
    return [{"node": k, "d": s["d"], "cut_value": v, "cut_tie": t, "keep": keep, "apart": apart} for k, s in state.items() for _, v, t, keep, apart in [s["best"]]]


def _descend(rows: DataFrame, cuts: list[dict]) -> DataFrame:
    """``rows`` with their nodes one level down; nodes without a cut stay."""
    met = rows.join(_table(rows.sparkSession, cuts, _CUT), "node", "left")
    x, at = F.col("x")[F.col("d")], F.when(F.col("keep"), F.col("tie") <= F.col("cut_tie")).otherwise(F.col("tie") < F.col("cut_tie"))
    put = F.get(F.filter("apart", lambda a: (a["v"] == x) & (a["t"] == F.col("tie"))), F.lit(0))["left"]
    left = F.coalesce(put, (x < F.col("cut_value")) | ((x == F.col("cut_value")) & at))
    node = F.when(F.col("d").isNull(), F.col("node")).when(left, F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
    return met.select(*[c for c in rows.columns if c != "node"], node.alias("node"))


def grow(rows: DataFrame, shards: int) -> DataFrame:
    """``groups`` rows with the node of their leaf in a k-d tree with ``shards`` leaves of equal weight."""
    dims = 4
    ends = rows.agg(*[F.max(F.col("x")[i]) - F.min(F.col("x")[i]) for i in range(dims)]).first()
    level = rows.withColumn("node", F.lit(1).cast("long"))
    if ends[0] is None:
        return level
    total, leaves = [float(e) for e in ends], {1: shards}
    while any(n > 1 for n in leaves.values()):
        cuts = _split(level, {k: (n // 2, n) for k, n in leaves.items() if n > 1}, total)
        leaves = {c: m for k, n in leaves.items() for c, m in (((2 * k, n // 2), (2 * k + 1, n - n // 2)) if n > 1 else ((k, 1),))}
        level = materialize(_descend(level, cuts), "kd-level")
    return level


def _leaf_numbers(shards: int) -> list[int]:
    """The leaves of the tree from left to right."""
    leaves = [(1, shards)]
    while any(n > 1 for _, n in leaves):
        leaves = [c for k, n in leaves for c in (((2 * k, n // 2), (2 * k + 1, n - n // 2)) if n > 1 else ((k, 1),))]
    return [k for k, _ in leaves]


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1)).first()[0] or 0


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """How many leaves bring each down to ``target_bytes``."""
    return max(1, math.ceil(total_bytes(docs) / target_bytes))


def _alone(rows: DataFrame, shards: int) -> list[bytes]:
    """Digests of texts that are heavier than an even share of what the others leave: each fills a shard alone. There
    are fewer than ``shards``, as that many would weigh more than all rows."""
    total = rows.agg(F.sum("weight")).first()[0] or 0
    heavy = rows.where(F.col("weight") > total // (2 * shards)).orderBy(F.desc("weight"), "digest").limit(shards).select("digest", "weight").collect()
    out = []
    for r in heavy:
        if len(out) == shards - 1 or r["weight"] * (shards - len(out)) <= total:
            break
        out.append(bytes(r["digest"]))
        total -= r["weight"]
    return out


def assign(docs: DataFrame, shards: int = 8, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs(doc_id, text, ...)``.

    The law is ``bytes``: leaves of a k-d tree hold as nearly equal UTF-8 bytes as whole texts allow. With
    ``target_bytes``, the tree has as many leaves as bring each down to it, else ``shards``. Equal texts
    stand in one shard; ``slot`` numbers a shard's rows from 0 without gaps. A null text is an empty one and weighs
    1 byte; null metadata count as empty names and doc_id 0; repeated rows each get a slot; an empty table gives no
    rows. A single text heavier than a shard's share fills its shard alone, as it must not be divided, and the others share
    the rest; these shards come last. Slots go by blocks of a hash of each row's place, in a block by doc_id (null first),
    checksum and size. Columns other than text, doc_id, source and lang are ignored.
    """
    if target_bytes is not None:
        shards = shards_for(docs, target_bytes)
    rows = groups(docs)
    alone = _alone(rows, shards)
    rest = shards - len(alone)
    leaf = _table(docs.sparkSession, [{"node": k, "shard": i} for i, k in enumerate(_leaf_numbers(rest))], "node: bigint, shard: int")
    placed = grow(rows.where(~F.col("digest").isin([F.lit(d) for d in alone])) if alone else rows, rest).join(leaf, "node").select("digest", "shard")
    for i, d in enumerate(alone):
        placed = placed.unionByName(docs.sparkSession.range(1).select(F.lit(d).alias("digest"), F.lit(rest + i).alias("shard")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    joined = materialize(own.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at")), "kd-rows")
    blocks = max(1, joined.count() // BLOCK_ROWS)
    joined = joined.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)))  # rows without doc_id spread like any others
    counts = joined.groupBy("shard", "block").count()
    first = counts.withColumn("first", F.sum("count").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1))).select("shard", "block", F.coalesce("first", F.lit(0)).alias("first"))
    order = W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size", "at")
    slots = joined.withColumn("row", F.row_number().over(order) - 1).join(first, ["shard", "block"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
