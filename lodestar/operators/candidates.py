"""Candidates: rows that the index names for a query, ranked by evidence, within an adaptive budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from ..functions import nig
from .planes import probe_masks


def effective_radius(config: Config, delta: float) -> int:
    """How far to probe: the less mass a query asks for, the less."""
    return config.lsh_probe_hamming_radius if delta < 0.2 else min(config.lsh_probe_hamming_radius, 1) if delta < 0.5 else 0


def probes(tables: DataFrame, bits: int, radius: int) -> DataFrame:
    """(query_id, table_id, sig, proj): all signatures to look up for ``tables(query_id, table_id, sig, proj)``."""
    masks = F.array(*[F.lit(m).cast("long") for m in probe_masks(bits, radius)])
    return tables.select("query_id", "table_id", F.explode(F.transform(masks, lambda m: F.col("sig").bitwiseXOR(m))).alias("sig"), "proj")


def bucket_scores(looked_up: DataFrame, experts: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, segment_id, table_id, sig, score) of every bucket found in a query's selected segments.

    The log density of the query's projections in the bucket, plus the logarithm of its rows, less a quarter of the
    entropy term of its share. ``selected`` is (query_id, segment_id, vector_count).
    """
    found = looked_up.join(experts, ["table_id", "sig"]).join(selected, ["query_id", "segment_id"])
    fit = F.aggregate(F.zip_with("proj", "post", nig.log_density), F.lit(0.0), lambda s, v: s + v)
    share = F.least(F.greatest(F.col("cnt") / F.col("vector_count"), F.lit(1e-12)), F.lit(1.0))
    return found.select("query_id", "segment_id", "table_id", "sig", (fit + F.log1p(F.col("cnt").cast("double")) + 0.25 * share * F.ln(share)).alias("score"))


def row_evidence(buckets: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, segment_id, row_id, score, votes): scores summed over the buckets that hold a row, and how many."""
    hit = buckets.join(postings, ["segment_id", "table_id", "sig"])
    return hit.groupBy("query_id", "segment_id", "row_id").agg(F.sum("score").alias("score"), F.count("*").alias("votes"))


def budget(config: Config, s1: Column, s2: Column, top: Column, v1: Column, v2: Column) -> Column:
    """Rows to rerank: few if the best row stands out by votes, by its share of the best 16 and by its lead.

    s1 and s2 are the best two scores (s2 null if there is one row), top the sum of exp(s - s1) of the best 16, v1
    and v2 the votes.
    """
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    t = float(config.lsh_num_tables)
    lead = unit(F.greatest(s1 - F.coalesce(s2, s1 - 1), F.lit(0.0)) / (F.abs(s1) + 1e-6))
    votes = unit(0.7 * unit(v1 / t) + 0.3 * unit((v1 - F.coalesce(v2, F.lit(0))) / t))
    sure = unit(0.55 * votes + 0.30 / top + 0.15 * lead)
    low, high = float(config.lsh_min_candidates), float(config.lsh_max_candidates)
    return F.least(F.greatest(F.round(low + (high - low) * F.pow(1 - sure, F.lit(config.lsh_adaptive_gamma))), F.lit(low)), F.lit(high)).cast("int")


def ranked(evidence: DataFrame) -> DataFrame:
    """Evidence with its rank in each query and segment: by score, votes, then row_id."""
    order = W.partitionBy("query_id", "segment_id").orderBy(F.desc("score"), F.desc("votes"), "row_id")
    return evidence.withColumn("rank", F.row_number().over(order))


def within_budget(evidence: DataFrame, config: Config) -> DataFrame:
    """The best rows of each query and segment, with the budget that cut them off."""
    whole = W.partitionBy("query_id", "segment_id")
    at = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c))).over(whole)
    # ranks beyond the largest budget can't be chosen, and none beyond the 16th is needed for it
    rows = ranked(evidence).where(F.col("rank") <= config.lsh_max_candidates).withColumn("s1", at("score", 1))
    top = F.sum(F.when(F.col("rank") <= 16, F.exp(F.col("score") - F.col("s1")))).over(whole)
    full = rows.withColumns({"s2": at("score", 2), "v1": at("votes", 1), "v2": at("votes", 2), "top": top})
    cut = full.withColumn("budget", budget(config, F.col("s1"), F.col("s2"), F.col("top"), F.col("v1"), F.col("v2")))
    return cut.where("rank <= budget").select("query_id", "segment_id", "row_id", "score", "votes", "rank", "budget")
