"""Benchmark decontamination with a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ascii_lower, materialize, text_key, without

#: What stands between words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of terms or phrases is broadcast up to this many rows; beyond it, it is joined by shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAPS), "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def phrases(items: DataFrame, n: int = 8) -> DataFrame:
    """(item_id, phrase): the windows of ``n`` words of each item, or all its words if it has fewer, but not none."""
    own = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    return own.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {n}, 0)), i -> slice(w, i + 1, {n}))")).alias("phrase")).distinct()


#: Words to either side of a phrase's rarest term within which a proximity match has all the others.
REACH = 7
#: Positions are joined by blocks of this many, so that no term's list in a document meets another whole one.
BLOCK = 16
_DOC = ["doc_id", "text_key"]


def vocabulary(found: DataFrame) -> DataFrame:
    """(term, term_id): the different terms of ``found(phrase)``, numbered."""
    return materialize(found.select(F.explode("phrase").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("term_id")), "terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: a posting (term_id, doc_id, text_key, pos) for each occurrence of ``terms(term, term_id)``, and the
    length of each document.

    Lists of words that no phrase has would never be looked up and are left out. A document's first row, which may be no
    posting, has n_words; doc_id is 0 where it is null, and ``none`` then says so. Only single words are ever shuffled, if
    the terms are too many to be broadcast.
    """
    base = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), words(F.col("text")).alias("w"))
    each = base.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), F.posexplode_outer("w").alias("pos", "term"))
    hits = each.join(_small(terms), "term", "left").where("term_id IS NOT NULL OR pos = 0 OR pos IS NULL")
    rows = hits.select("term_id", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text_key", "pos", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("n_words")).alias("n_words"))
    return materialize(rows, "postings")


def places(found: DataFrame, index: DataFrame, terms: DataFrame) -> DataFrame:
    """(phrase_id, n, rank, term_id, at) of ``found(phrase_id, phrase)``: the terms of each phrase, the rarest first.

    Rarity is the length of a term's list in the index; of equally rare terms the first in the phrase goes first. A phrase
    with a term that no document has can't occur and is left out.
    """
    counts = index.where("term_id IS NOT NULL").groupBy("term_id").count()
    parts = found.select("phrase_id", F.size("phrase").alias("n"), F.posexplode("phrase").alias("at", "term")).join(_small(terms), "term")
    known = parts.join(_small(materialize(counts, "counts")), "term_id", "left")
    whole = W.partitionBy("phrase_id")
    ranked = known.withColumn("rank", F.row_number().over(whole.orderBy("count", "at")) - 1).withColumn("least", F.min(F.coalesce("count", F.lit(0))).over(whole))
    return materialize(ranked.where("least > 0").select("phrase_id", "n", "rank", "term_id", "at"), "places")


def _near(need: DataFrame, lists: DataFrame) -> DataFrame:
    """``need(doc_id, text_key, pos, term_id, ...)`` with ``there``: each posting of the term within REACH of pos. Both meet
    on a block of BLOCK positions, so what one row can meet is bounded."""
    blocks = F.array_distinct(F.array(*[F.floor((F.col("pos") + d) / BLOCK) for d in (-REACH, REACH)]))
    wide = need.withColumn("block", F.explode(blocks))
    own = lists.select(*_DOC, "term_id", F.floor(F.col("pos") / BLOCK).alias("block"), F.col("pos").alias("there"))
    return wide.join(own, [*_DOC, "term_id", "block"]).where(f"abs(there - pos) <= {REACH}").drop("block")


def matches(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(phrase_id, doc_id, text_key, start, n, exact): where all terms of a phrase of ``places`` stand within REACH of its
    rarest one. ``exact``: each at its offset, so the phrase itself begins at ``start``; else in any order or distance.

    Lists are intersected from the rarest term on. The postings of the rarest terms meet those of the second rarest, for
    each pair of terms once, however many overlapping phrases have it; only what is left meets the lists of the others,
    each posting less its term's offset, and in documents that still have something only.
    """
    postings = index.where("term_id IS NOT NULL").select(*_DOC, "term_id", "pos")
    by_rank = lambda k: ranked.where(F.col("rank") == k)
    first = by_rank(0).select("phrase_id", "n", F.col("term_id").alias("t0"), F.col("at").alias("at0"))
    single = postings.join(_small(first.where("n = 1")), F.col("term_id") == F.col("t0")).select("phrase_id", *_DOC, F.col("pos").alias("start"), "n", F.lit(True).alias("exact"))
    heads = first.join(by_rank(1).select("phrase_id", F.col("term_id").alias("t1")), "phrase_id")
    pairs = heads.select("t0", "t1").distinct()
    anchors = postings.join(_small(pairs), F.col("term_id") == F.col("t0")).select(*_DOC, "pos", "t0", F.col("t1").alias("term_id"))
    second = postings.join(_small(pairs.select(F.col("t1").alias("term_id")).distinct()), "term_id", "left_semi")
    met = materialize(_near(anchors, second).select(*_DOC, "pos", "t0", F.col("term_id").alias("t1")).distinct(), "pairs")
    need = met.join(_small(heads), ["t0", "t1"]).select("phrase_id", "n", *_DOC, "pos", "at0")
    need = need.join(_small(ranked.where("rank > 0").select("phrase_id", "rank", "term_id", "at")), "phrase_id")
    rest = postings.join(_small(met.select(*_DOC).distinct()), _DOC, "left_semi")
    bit = F.expr("shiftleft(1L, rank)")
    here = F.col("there") - F.col("pos") == F.col("at") - F.col("at0")
    found = _near(need, rest).groupBy("phrase_id", "n", *_DOC, "pos", "at0").agg(F.bit_or(bit).alias("near"), F.bit_or(F.when(here, bit).otherwise(F.lit(0).cast("long"))).alias("there"))
    full = found.where("bit_count(near) = n - 1").select("phrase_id", *_DOC, (F.col("pos") - F.col("at0")).alias("start"), "n", F.expr("bit_count(there) = n - 1").alias("exact"))
    return single.unionByName(full)


def _per_document(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """``contamination`` without its last column, and with the ``text_key`` of each row."""
    by_item = phrases(items, n)
    own = materialize(by_item.select("phrase").distinct().select(F.monotonically_increasing_id().alias("phrase_id"), "phrase"), "phrases")
    names = materialize(by_item.join(own, "phrase").where("item_id IS NOT NULL").select("phrase_id", F.col("item_id").cast("string").alias("item")), "items")
    terms = vocabulary(own)
    index = build_index(docs, terms)
    found = materialize(matches(index, places(own, index, terms)).distinct(), "matches")
    order = W.partitionBy(*_DOC).orderBy("start", "n").rowsBetween(W.unboundedPreceding, -1)
    spans = found.where("exact").select(*_DOC, "start", "n").distinct().withColumn("seen", F.max(F.col("start") + F.col("n")).over(order))
    hit = spans.groupBy(*_DOC).agg(F.sum(F.expr("greatest(0, start + n - greatest(start, coalesce(seen, 0)))")).alias("n_hit"))
    named = found.groupBy(*_DOC, "phrase_id").agg(F.max("exact").alias("exact")).join(_small(names), "phrase_id").groupBy(*_DOC, "item").agg(F.max("exact").alias("exact"))
    listed = named.groupBy(*_DOC).agg(F.count_if("exact").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item"))))), 256).alias("items_sha256"), F.count("*").alias("n_near"))
    sums = listed.join(hit, _DOC, "left").withColumnsRenamed({c: f"_{c}" for c in _DOC})
    out = index.where("n_words IS NOT NULL").select(*_DOC, "none", "n_words")
    out = out.join(sums, (F.col("doc_id") == F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "text_key", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.expr("sha2('', 256)")).alias("items_sha256"), zero("n_near"))


def contamination(docs: DataFrame, items: DataFrame, n: int = 8, least: int = 2) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, n_near, contaminated) for every row of ``docs(doc_id, text)``.

    n_hit counts the words inside any occurrence of an item's window of ``n`` words (63 at most), n_items the items with
    such a window, n_near those with a window all of whose words stand, in any order, within REACH of its rarest one;
    contaminated means ``least`` items or more. Null and empty texts have no words and no hits; items without words, and
    repeated items, add nothing; a null item_id is not counted as an item. Rows that repeat a doc_id and its text each come
    out, with the same figures. Other columns are ignored.
    """
    found = _per_document(docs, items, n).withColumn("contaminated", F.col("n_items") >= least)
    return found.drop("text_key")


def clean(docs: DataFrame, items: DataFrame, n: int = 8, least: int = 2) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; rows without doc_id all stay."""
    return without(docs, _per_document(docs.select("doc_id", "text"), items, n).where(F.col("n_items") >= least))
