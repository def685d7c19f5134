"""The queries over the corpus tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, langid, pieces, quality, sharding, simhash, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.assign(docs, target_bytes=max(1, -(-sharding.total_bytes(docs) // 8)))


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(_table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "perspective", "seq", "turn", "role", "trained", "start_at", "end_at", F.sha2("rendered", 256).alias("rendered_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_decontamination, op3_sentencepiece, op4_exact_dedup, op5_quality, op6_kd_sharding, op7_chat_rotation, op8_toxicity, op9_substring_dedup, op10_language_id)}

ORACLE_SQL = {
    "op2_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), p AS (
            SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i + 1 : i + 8], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 8, 0) + 1)) AS i FROM b WHERE len(w) > 0)
        ), s AS (
            SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS phrase
            FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
        ), m AS (
            SELECT doc_id, item_id, s.n, i FROM s JOIN p ON s.phrase = p.phrase AND s.n = p.n
        ), h AS (
            SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id
        ), u AS (
            SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d
        ), f AS (
            SELECT phrase, item_id, term, min(spot) AS spot, any_value(freq) AS freq
            FROM (SELECT phrase, item_id, unnest(w) AS term, unnest(range(0, len(w))) AS spot FROM (SELECT phrase, item_id, string_split(phrase, ' ') AS w FROM p))
            LEFT JOIN (SELECT term, count(*) AS freq FROM u GROUP BY term) USING (term) GROUP BY phrase, item_id, term
        ), r AS (
            SELECT phrase, item_id, term, count(*) OVER (PARTITION BY phrase, item_id) AS terms, count(freq) OVER (PARTITION BY phrase, item_id) AS found,
                row_number() OVER (PARTITION BY phrase, item_id ORDER BY freq, spot) AS rank FROM f
        ), x AS (
            SELECT doc_id, pos, phrase, item_id, terms FROM r JOIN u USING (term) WHERE rank = 1 AND found = terms
        ), y AS (
            SELECT x.doc_id, x.item_id FROM x JOIN r ON r.phrase = x.phrase AND r.item_id = x.item_id JOIN u ON u.doc_id = x.doc_id AND u.term = r.term AND abs(u.pos - x.pos) <= 7
            GROUP BY x.doc_id, x.item_id, x.phrase, x.pos HAVING count(DISTINCT r.term) = any_value(x.terms)
        ), v AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_near FROM y GROUP BY doc_id
        ), t AS (
            SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_near, 0) AS n_near, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN v USING (doc_id)""",
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
            first_value(doc_id) OVER w = doc_id AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op7_chat_rotation": r"""
        WITH b AS (
            SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|im_', '<| im_'), chr(13) || chr(10), '  ') AS speaker,
                replace(coalesce(text, ''), '<|im_', '<| im_') AS body
            FROM conversations
        ), e AS (
            SELECT b.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
            FROM b JOIN (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM b WHERE speaker <> 'system') ON conv_id IS NOT DISTINCT FROM c
        ), h AS (
            SELECT *, '<|im_start|>' || CASE role WHEN 'user' THEN 'user name=' || speaker ELSE role END || chr(10) AS head FROM e
        ), w AS (
            SELECT *, coalesce(sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS here,
                row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body) - 1 AS seq
            FROM h
        )
        SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, role, role = 'assistant' AS trained, CAST(here AS BIGINT) AS start_at,
            CAST(here + length(body) + 10 AS BIGINT) AS end_at, sha256(head || body || '<|im_end|>' || chr(10)) AS rendered_sha256
        FROM w""",
    "op9_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS run
            FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)
        ), f AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS low FROM s) WHERE doc_id > low
        ), g AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM f
        ), k AS (
            SELECT doc_id, j, w[j + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS j FROM d)
            ANTI JOIN g USING (doc_id, j)
        ), t AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM k GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id)""",
}
