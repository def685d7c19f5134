"""Multi-party perspective rotation of dialogues, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, partitions

#: Letters of a message that the order of messages is cut by; the rest decides within a block.
PREFIX = 256
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _plain(c):
    """Text in which no marker of the format can be read."""
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def rotate(turns: DataFrame, speaker: str = "role", context: tuple[str, ...] = ("system",)) -> DataFrame:
    """Every message of ``turns(conv_id, turn, <speaker>, text)`` as each participant of its conversation sees it.

    Rows: conv_id, perspective, seq, turn, speaker, role, rendered, trained, start_at, end_at. A participant is a
    speaker who isn't ``context``. In a participant's own rendering that speaker is the assistant and is trained
    on, other participants are users with their names, and context keeps its role. ``start_at`` and ``end_at``
    are the code points, within the whole rendered dialogue, of what is masked in: the message and its end mark,
    without the header; where ``trained`` is false they bound what is masked out. ``seq`` counts from 0.

    Turns go by turn (null first), then speaker and text; repeated rows are repeated messages. A null text is
    empty, a null speaker is named ``unknown``; rows without conv_id are one conversation. Markers inside texts and
    names are broken up with a space, line ends in names become spaces. A conversation with context alone gives no
    rows. Other columns are ignored. No conversation is gathered into one group: all messages, in their order, are cut
    into blocks by the quantiles of a sample, whatever turns they have, and offsets are sums within a block and over
    the blocks before, of which a conversation has no more than there are shuffle partitions. Equal messages may be
    parted; only messages of one turn (or none) and speaker that begin with the same PREFIX letters stay together.
    """
    name = F.translate(_plain(F.coalesce(F.col(speaker).cast("string"), F.lit("unknown"))), "\r\n", "  ")
    base = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("speaker"), _plain(F.col("text")).alias("body"))
    people = base.where(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    each = base.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker").isin(*context), F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    head = F.concat(F.lit(BEGIN), F.when(role == "user", F.concat(F.lit("user name="), F.col("speaker"))).otherwise(role), F.lit("\n"))
    each = each.select("conv_id", "perspective", "turn", "speaker", "body", role.alias("role"), head.alias("head"))
    # equal short messages go in any order; a longer one comes after what it begins with
    any_order = F.when(F.length("body") <= PREFIX, F.monotonically_increasing_id() - (1 << 62)).otherwise(0)
    keyed = each.withColumns({"prefix": F.substring("body", 1, PREFIX), "salt": any_order})
    cut = keyed.repartitionByRange(partitions(turns.sparkSession), "conv_id", "perspective", "turn", "speaker", "prefix", "salt")
    each = materialize(cut.withColumn("block", F.spark_partition_id()).drop("prefix", "salt"), "chat-blocks")
    long = F.length("head") + F.length("body") + F.lit(len(END) + 1)
    sums = each.groupBy("conv_id", "perspective", "block").agg(F.sum(long).alias("chars"), F.count("*").alias("n"))
    past = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("chars").over(past), F.lit(0)).alias("chars"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n"))
    inside = W.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "body")
    placed = each.withColumns({"at": F.coalesce(F.sum(long).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "row": F.row_number().over(inside) - 1})
    joined = placed.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("chars") + F.col("at") + F.length("head")
    return joined.select(
        "conv_id", "perspective", (F.col("n") + F.col("row")).cast("long").alias("seq"), "turn", "speaker", "role",
        F.concat("head", "body", F.lit(END + "\n")).alias("rendered"), (F.col("role") == "assistant").alias("trained"),
        start.cast("long").alias("start_at"), (start + F.length("body") + len(END)).cast("long").alias("end_at"),
    )


def dialogues(messages: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, masks) from ``rotate``: each rendering as one text with the spans to train on.

    A text is one value, so this holds a whole conversation in a row; ``rotate`` doesn't.
    """
    parts = F.array_sort(F.collect_list(F.struct("seq", "rendered", "trained", "start_at", "end_at")))
    rows = messages.groupBy("conv_id", "perspective").agg(parts.alias("m"))
    return rows.select("conv_id", "perspective", F.array_join("m.rendered", "").alias("text"), F.expr("transform(filter(m, x -> x.trained), x -> struct(x.start_at, x.end_at))").alias("masks"))
