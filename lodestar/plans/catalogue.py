"""The queries of the vector engine over the ``embeddings`` table, and the SQL that gives the same rows.

Segments are 125 rows by vec_id; numbers are doubles rounded to 6 digits; ids are longs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from ..functions import metrics, nig
from ..operators import candidates, compaction, index, routing, search, segments, turbo
from ..operators.planes import make_planes
from ..sources.store import VectorStore
from ..streaming.ingest import ingest

SEGMENT_ROWS, QUERIES = 125, 5
#: Settings of the index queries: fewer bits than the default, as the table is small.
SMALL = Config(dimension=64, lsh_num_tables=4, lsh_bits_per_table=8, lsh_dims_per_bit=8, lsh_probe_hamming_radius=1, lsh_bucket_expert_dims=2, lsh_max_candidates=256, lsh_min_candidates=32, seed=42)


TURBO = turbo.TurboConfig(64, 4)


def _r(c):
    return F.round(c.cast("double"), 6)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def _queries(rows: DataFrame, n: int = QUERIES) -> DataFrame:
    return rows.where(F.col("id") < n).select(F.col("id").alias("query_id"), "vector")


def _segmented(rows: DataFrame) -> DataFrame:
    return segments.assign_segments(rows.withColumn("at", F.col("id")), SEGMENT_ROWS)


def _catalog(spark, sf_dir):
    rows = _segmented(_rows(spark, sf_dir))
    return rows, segments.with_posteriors(segments.segment_stats(rows))


def _result(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "id", _r(F.col("distance")).alias("distance"))


def exact_knn_l2(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _result(search.exact_knn(rows, _queries(rows), 10, "l2"))


def exact_knn_cosine(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _result(search.exact_knn(rows, _queries(rows), 10, "cosine"))


def exact_knn_dot(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _result(search.exact_knn(rows, _queries(rows), 10, "dot"))


def knn_custom_metric(spark, sf_dir):
    """Manhattan distance as a function of two matrices."""
    rows = _rows(spark, sf_dir)
    return _result(search.exact_knn(rows, _queries(rows), 10, lambda q, x: abs(q[:, None] - x[None]).sum(axis=2)))


def knn_threshold(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _result(search.exact_knn(rows, _queries(rows), 10, "l2", threshold=1.2))


def knn_dedup_min(spark, sf_dir):
    """Each vector twice under one id, once scaled: the nearer one counts."""
    rows = _rows(spark, sf_dir).select("id", "vector")
    both = rows.unionByName(rows.select("id", F.transform("vector", lambda x: x * 0.9).alias("vector")))
    return _result(search.exact_knn(both, _queries(rows), 10, "l2"))


def knn_filtered(spark, sf_dir):
    """An attribute filter before the search: it goes to the scan."""
    rows = _rows(spark, sf_dir)
    return _result(search.exact_knn(rows.where("label = 3"), _queries(rows), 5, "l2"))


def vector_norms(spark, sf_dir):
    return _rows(spark, sf_dir).select("id", _r(metrics.norm_sq("vector")).alias("norm_sq"), _r(metrics.norm("vector")).alias("norm"))


def _pairs(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    q = _queries(rows, 1).select(F.col("vector").alias("q"))
    return rows.join(F.broadcast(q))  # one query row


def dot_products(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", _r(metrics.dot("q", "vector")).alias("dot"), _r(metrics.cosine_similarity(F.col("q"), F.col("vector"))).alias("cosine"))


def l2_prefix(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", _r(metrics.l2_sq_prefix("q", "vector", 16)).alias("l2_sq_16"), _r(metrics.l2_sq("q", "vector")).alias("l2_sq"))


def sparse_dots(spark, sf_dir):
    at, w = F.array(*map(F.lit, (3, 17, 40))), F.array(*map(F.lit, (0.5, -1.25, 2.0)))
    return _rows(spark, sf_dir).select("id", _r(metrics.sparse_weighted_dot("vector", at, w, F.lit(0.1))).alias("dot"))


def sq8_minmax(spark, sf_dir):
    _, own = _catalog(spark, sf_dir)
    return own.select("segment_id", F.posexplode(F.arrays_zip("min_vals", "max_vals")).alias("pos", "v")).select("segment_id", F.col("pos").cast("long").alias("pos"), _r(F.col("v.min_vals")).alias("lo"), _r(F.col("v.max_vals")).alias("hi"))


def _coded(spark, sf_dir):
    rows, own = _catalog(spark, sf_dir)
    return rows, own, segments.encode_rows(rows, own)


def sq8_codes(spark, sf_dir):
    _, _, coded = _coded(spark, sf_dir)
    return coded.select("id", F.posexplode("codes").alias("pos", "code")).select("id", F.col("pos").cast("long").alias("pos"), F.col("code").cast("long").alias("code"))


def sq8_decode_error(spark, sf_dir):
    rows, own, coded = _coded(spark, sf_dir)
    back = segments.decode_rows(coded, own).select("id", F.col("vector").alias("y"))
    return rows.join(back, "id").select("id", _r(metrics.l2("vector", "y")).alias("error"))


def _over_codes(spark, sf_dir, metric):
    rows, own, coded = _coded(spark, sf_dir)
    queries = _queries(rows).select("query_id", "vector")
    every = coded.select(F.explode(F.array(*[F.lit(i).cast("long") for i in range(QUERIES)])).alias("query_id"), "segment_id", "row_id")
    return _result(search.finish(search.rerank(every, coded, own, queries, metric), 10))


def adc_knn(spark, sf_dir):
    return _over_codes(spark, sf_dir, "adc")


def decoded_knn(spark, sf_dir):
    return _over_codes(spark, sf_dir, "l2")


def segment_telemetry(spark, sf_dir):
    _, own, coded = _coded(spark, sf_dir)
    return own.join(segments.radius(coded), "segment_id").select("segment_id", "vector_count", _r(F.col("mean_norm")).alias("mean_norm"), _r(F.col("radius_sq")).alias("radius_sq"), _r(metrics.norm("centroid")).alias("centroid_norm"))


def segment_centroids(spark, sf_dir):
    _, own = _catalog(spark, sf_dir)
    return own.select("segment_id", F.posexplode("centroid").alias("pos", "v")).select("segment_id", F.col("pos").cast("long").alias("pos"), _r(F.col("v")).alias("mean"))


def root_stats(spark, sf_dir):
    _, own = _catalog(spark, sf_dir)
    return own.select("segment_id", F.posexplode("root_stats").alias("pos", "s")).select("segment_id", F.col("pos").cast("long").alias("pos"), F.col("s.n").alias("n"), _r(F.col("s.mean")).alias("mean"), _r(F.col("s.m2")).alias("m2"))


def centroid_distances(spark, sf_dir):
    _, own = _catalog(spark, sf_dir)
    pairs = compaction.pair_gains(own.withColumn("depth", F.lit(0)), 3)
    return pairs.select("left_id", "right_id", _r(F.col("centroid_distance")).alias("distance"))


def nig_root_scores(spark, sf_dir):
    rows, own = _catalog(spark, sf_dir)
    return routing.root_scores(_queries(rows, 20), own).select("query_id", "segment_id", _r(F.col("score")).alias("score"))


def routing_mass(spark, sf_dir):
    rows, own = _catalog(spark, sf_dir)
    found = routing.route(routing.root_scores(_queries(rows, 20), own), 0.05)
    return found.select("query_id", "segment_id", _r(F.col("mass")).alias("mass"), "selected")


def routing_explain(spark, sf_dir):
    rows, own = _catalog(spark, sf_dir)
    found = routing.explain_routing(routing.root_scores(_queries(rows, 20), own), 0.2)
    return found.select("query_id", F.col("place").cast("long").alias("place"), "segment_id", _r(F.col("target_mass")).alias("target_mass"), _r(F.col("mass")).alias("mass"), _r(F.col("cumulative_mass")).alias("cumulative_mass"), "selected")


def bic_pairs(spark, sf_dir):
    _, own = _catalog(spark, sf_dir)
    return compaction.pair_gains(own.withColumn("depth", F.lit(0)), 3).select("left_id", "right_id", _r(F.col("gain")).alias("gain"))


def compaction_choice(spark, sf_dir):
    """Depths 0, 1, 2, 3 in turn: segments at the cap don't take part."""
    _, own = _catalog(spark, sf_dir)
    best = compaction.best_pair(own.withColumn("depth", (F.col("segment_id") % 4).cast("int")), 3)
    return best.select("left_id", "right_id", _r(F.col("gain")).alias("gain"))


def _tables(rows: DataFrame, keys: list[str]) -> DataFrame:
    return index.by_table(index.hashed(rows, make_planes(SMALL), keys), keys, SMALL.lsh_bucket_expert_dims)


def lsh_signatures(spark, sf_dir):
    found = _tables(_rows(spark, sf_dir), ["id"])
    return found.select("id", F.col("table_id").cast("long").alias("table_id"), "sig")


def lsh_postings_count(spark, sf_dir):
    found = index.bucket_counts(_tables(_segmented(_rows(spark, sf_dir)), ["segment_id", "row_id"]))
    return found.select("segment_id", F.col("table_id").cast("long").alias("table_id"), "buckets")


def lsh_probe_counts(spark, sf_dir):
    """Rows that the probes of each query reach, by table."""
    rows = _rows(spark, sf_dir)
    looked_up = candidates.probes(_tables(_queries(rows), ["query_id"]), SMALL.lsh_bits_per_table, 1)
    hit = looked_up.join(_tables(rows, ["id"]).select("table_id", "sig", "id"), ["table_id", "sig"])
    return hit.groupBy("query_id", F.col("table_id").cast("long").alias("table_id")).agg(F.count("*").alias("rows"))


def bucket_experts(spark, sf_dir):
    tables = _tables(_segmented(_rows(spark, sf_dir)), ["segment_id", "row_id"])
    found = index.experts(tables, SMALL.lsh_bucket_expert_dims).select("segment_id", F.col("table_id").cast("long").alias("table_id"), "sig", "cnt", F.posexplode("stats").alias("pos", "s"))
    return found.select("segment_id", "table_id", "sig", "cnt", F.col("pos").cast("long").alias("pos"), _r(F.col("s.mean")).alias("mean"), _r(F.col("s.m2")).alias("m2"))


def _indexed(spark, sf_dir):
    rows, own = _catalog(spark, sf_dir)
    tables = _tables(rows, ["segment_id", "row_id"])
    return rows, own, index.experts(tables, SMALL.lsh_bucket_expert_dims), index.postings(tables)


def row_evidence(spark, sf_dir):
    """Scores and votes of the rows that each query's probes reach, in all segments."""
    rows, own, experts, postings = _indexed(spark, sf_dir)
    looked_up = candidates.probes(_tables(_queries(rows), ["query_id"]), SMALL.lsh_bits_per_table, 1)
    every = own.select(F.explode(F.array(*[F.lit(i).cast("long") for i in range(QUERIES)])).alias("query_id"), "segment_id", "vector_count")
    found = candidates.row_evidence(candidates.bucket_scores(looked_up, experts, every), postings)
    return found.select("query_id", "segment_id", F.col("row_id").cast("long").alias("row_id"), _r(F.col("score")).alias("score"), "votes")


def adaptive_budget(spark, sf_dir):
    rows, own, experts, postings = _indexed(spark, sf_dir)
    looked_up = candidates.probes(_tables(_queries(rows), ["query_id"]), SMALL.lsh_bits_per_table, 1)
    every = own.select(F.explode(F.array(*[F.lit(i).cast("long") for i in range(QUERIES)])).alias("query_id"), "segment_id", "vector_count")
    found = candidates.within_budget(candidates.row_evidence(candidates.bucket_scores(looked_up, experts, every), postings), SMALL)
    return found.groupBy("query_id", "segment_id").agg(F.max("budget").cast("long").alias("budget"), F.count("*").alias("rows"))


def ann_search(spark, sf_dir):
    """The whole pipeline: routing, probing, evidence, budget, reranking by decoded distance."""
    rows, own, coded = _coded(spark, sf_dir)
    tables = _tables(rows, ["segment_id", "row_id"])
    queries = _queries(rows)
    chosen, plan = search.ann_candidates(queries, own, index.experts(tables, SMALL.lsh_bucket_expert_dims), index.postings(tables), make_planes(SMALL), SMALL, 0.05)
    return _result(search.finish(search.rerank(chosen, coded, own, queries, "l2", plan, SMALL.lsh_max_candidates), 10))


def compact_roundtrip(spark, sf_dir):
    """Segments 0 and 1 merged: ids and new row numbers, and how far decoded values moved."""
    rows, own, coded = _coded(spark, sf_dir)
    merged = compaction.merged_rows(coded, own, 0, 1, 99)
    return merged.join(rows.select("id", F.col("vector").alias("x")), "id").select("segment_id", F.col("row_id").cast("long").alias("row_id"), "id", _r(metrics.l2("x", "vector")).alias("error"))


def _new_store(spark, rows: int) -> VectorStore:
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestar-store-")
    return VectorStore.create(spark, f"{base.rstrip('/')}/stores/{uuid.uuid4().hex}", SMALL.with_(max_segment_rows=rows, compaction_trigger=1 << 30))


def _filled_store(spark, sf_dir, size: int) -> VectorStore:
    """A store with all rows sealed, by vec_id, ``size`` to a segment."""
    store = _new_store(spark, size)
    store.insert(_rows(spark, sf_dir).coalesce(1).sortWithinPartitions("id").select("id", "vector"))
    store.save()
    return store


def _read_back(spark, sf_dir, store: VectorStore) -> DataFrame:
    back = segments.decode_rows(store.table("codes"), store.table("segments")).select("segment_id", "row_id", "id", F.col("vector").alias("y"))
    return _rows(spark, sf_dir).join(back, "id").select("id", "segment_id", F.col("row_id").cast("long").alias("row_id"), _r(metrics.l2("vector", "y")).alias("error"))


def store_roundtrip(spark, sf_dir):
    """Inserted, sealed, opened again: where each id stands, and how far its decoded vector is from its own."""
    return _read_back(spark, sf_dir, VectorStore.open(spark, _filled_store(spark, sf_dir, 200).path))


def store_compacted(spark, sf_dir):
    """The best pair of segments merged, sealed again and read back: what quantising twice has done."""
    store = VectorStore.open(spark, _filled_store(spark, sf_dir, SEGMENT_ROWS).path, SMALL.with_(max_segment_rows=SEGMENT_ROWS, compaction_trigger=2))
    store.compact_once()
    return _read_back(spark, sf_dir, store)


def store_next_compaction(spark, sf_dir):
    """The report on the merge that ``store_compacted`` makes, with the drift."""
    found = _filled_store(spark, sf_dir, SEGMENT_ROWS).explain_next_compaction()
    number = lambda c: F.col(c).cast("long").alias(c)
    return found.select(*map(number, ("left_id", "right_id", "left_depth", "right_depth", "left_count", "right_count", "left_visits", "right_visits", "vectors_rewritten", "bytes_rewritten")), *(_r(F.col(c)).alias(c) for c in ("centroid_distance", "gain", "drift")))


def stream_seal(spark, sf_dir):
    """A stream of files into a store: segments and their rows."""
    store = _new_store(spark, 200)
    stream = spark.readStream.schema("vec_id long, embedding array<float>").parquet(f"{sf_dir}/embeddings.parquet*").selectExpr("vec_id AS id", "embedding AS vector")
    ingest(stream, store, f"{store.path}-checkpoint", name=uuid.uuid4().hex, flush=True, availableNow=True).awaitTermination()
    return store.sealed_segment_summaries().select("segment_id", "vector_count")


def turbo_inner_products(spark, sf_dir):
    """4-bit estimates of the inner product with vector 0."""
    rows = _rows(spark, sf_dir)
    query = rows.where("id = 0").first().vector
    return turbo.turbo_scores(turbo.turbo_encode(rows, TURBO), query, TURBO).select("id", F.round("score", 5).alias("score"))


def segment_top_ids(spark, sf_dir):
    """The three largest norms in each segment: a group limit before the shuffle."""
    rows = _segmented(_rows(spark, sf_dir)).select("segment_id", "id", metrics.norm(F.slice("vector", 1, 8)).alias("size"))
    order = W.partitionBy("segment_id").orderBy(F.desc("size"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("segment_id", F.col("rank").cast("long").alias("rank"), "id", _r(F.col("size")).alias("size"))


def ln_gamma_values(spark, sf_dir):
    return _rows(spark, sf_dir).select("id", _r(nig.ln_gamma((F.col("id") + 1) / 2)).alias("value"))


QUERY_FUNCTIONS = (
    exact_knn_l2, exact_knn_cosine, exact_knn_dot, knn_custom_metric, knn_threshold, knn_dedup_min, knn_filtered, vector_norms, dot_products, l2_prefix, sparse_dots,
    sq8_minmax, sq8_codes, sq8_decode_error, adc_knn, decoded_knn, segment_telemetry, segment_centroids, root_stats, centroid_distances, nig_root_scores,
    routing_mass, routing_explain, bic_pairs, compaction_choice, lsh_signatures, lsh_postings_count, lsh_probe_counts, bucket_experts, row_evidence,
    adaptive_budget, ann_search, compact_roundtrip, store_roundtrip, store_compacted, store_next_compaction, stream_seal, turbo_inner_products, segment_top_ids, ln_gamma_values,
)
QUERIES_BY_NAME = {f.__name__: f for f in QUERY_FUNCTIONS}

# -- SQL

_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label, vec_id // 125 AS segment_id, vec_id % 125 AS row_id FROM embeddings)"
_Q = "q AS (SELECT id AS query_id, v AS qv FROM e WHERE id < 5)"
_X = "x AS (SELECT id, segment_id, row_id, unnest(range(0, len(v))) AS pos, unnest(v) AS val FROM e)"
_M = "m AS (SELECT segment_id, pos, count(*) AS n, avg(val) AS mean, var_pop(val) * count(*) AS m2, min(val) AS lo, max(val) AS hi FROM x GROUP BY ALL)"
_C = "c AS (SELECT id, segment_id, row_id, pos, val, lo, hi, CAST(least(greatest(round((val - lo) / greatest(hi - lo, 1e-12) * 255), 0), 255) AS BIGINT) AS code FROM x JOIN m USING (segment_id, pos))"


def _top(distances: str, k: int = 10) -> str:
    return f"SELECT query_id, rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT query_id, id, min(distance) AS distance FROM ({distances}) GROUP BY ALL)) WHERE rank <= {k}"


def _knn(expression: str, where: str = "TRUE", k: int = 10) -> str:
    return f"WITH {_E}, {_Q} " + _top(f"SELECT query_id, id, {expression} AS distance FROM q, e WHERE {where}", k)


# the posterior predictive of the statistics (n, mean, m2), at t
_POST = """SELECT *, 2 * a AS nu, b * (k + 1) / (a * k) AS s2 FROM (
        SELECT *, n * mean / k AS mu, 0.01 + m2 / 2 + 0.01 * n * mean * mean / (2 * k) AS b FROM (SELECT *, n + 0.01 AS k, n / 2 + 0.01 AS a FROM {source}))"""
_DENSITY = "lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * (ln(nu) + ln(pi()) + ln(s2)) - (nu + 1) / 2 * ln(1 + (t - mu) * (t - mu) / (nu * s2))"
_BIC = (
    f"WITH {_E}, {_X}, {_M}, pairs AS (SELECT a.segment_id AS left_id, b.segment_id AS right_id, a.n AS an, b.n AS bn, a.m2 AS am, b.m2 AS bm, a.n + b.n AS n, "
    "a.m2 + b.m2 + (b.mean - a.mean) * (b.mean - a.mean) * a.n * b.n / (a.n + b.n) AS m2 FROM m a JOIN m b ON a.pos = b.pos AND a.segment_id < b.segment_id), "
    "g AS (SELECT left_id, right_id, {ll} AS gain FROM pairs GROUP BY ALL) "
).replace("{ll}", " - ".join(f"(sum(-0.5 * {n} * ln(2 * pi() * greatest({m} / {n}, 1e-12))) - 2 * count(*) * ln(greatest(sum({n}), 2)))" for n, m in (("n", "m2"), ("an", "am"), ("bn", "bm"))))


def _planes_sql() -> str:
    """The hash and expert planes as a table h(kind, table_id, plane, bias, pos, w)."""
    p, rows = make_planes(SMALL), []
    for kind, weights, bias in (("hash", p.hash, p.hash_bias), ("expert", p.expert, p.expert_bias)):
        for t in range(weights.shape[0]):
            for b in range(weights.shape[1]):
                rows += [f"('{kind}', {t}, {b}, {float(bias[t, b])!r}::DOUBLE, {i}, {float(weights[t, b, i])!r}::DOUBLE)" for i in range(weights.shape[2]) if weights[t, b, i]]
    return f"h(kind, table_id, plane, bias, pos, w) AS (VALUES {', '.join(rows)})"


_HASHED = (
    f"WITH {_E}, {_X}, {_planes_sql()}, d AS (SELECT id, segment_id, row_id, kind, table_id, plane, any_value(bias) + sum(w * val) AS dot FROM x JOIN h USING (pos) GROUP BY ALL), "
    "sg AS (SELECT id, segment_id, row_id, CAST(table_id AS BIGINT) AS table_id, CAST(sum(CASE WHEN dot > 0 THEN 1 << plane ELSE 0 END) AS BIGINT) AS sig FROM d WHERE kind = 'hash' GROUP BY ALL), "
    "ex AS (SELECT sg.segment_id, sg.table_id, sig, plane, count(*) AS n, avg(dot) AS mean, var_pop(dot) * count(*) AS m2 FROM sg JOIN d ON d.id = sg.id AND d.table_id = sg.table_id AND d.kind = 'expert' GROUP BY ALL), "
    "pr AS (SELECT id AS query_id, table_id, xor(sig, mask) AS sig FROM sg, (SELECT unnest([0, 1, 2, 4, 8, 16, 32, 64, 128]) AS mask) WHERE id < 5) "
)
_EVIDENCE = (
    _HASHED + f", po AS ({_POST.format(source='ex')}), "
    f"bs AS (SELECT pr.query_id, po.segment_id, pr.table_id, pr.sig, any_value(n) AS cnt, sum({_DENSITY.replace('t -', 'd.dot -')}) AS fit FROM pr JOIN po USING (table_id, sig) JOIN d ON d.id = pr.query_id AND d.table_id = pr.table_id AND d.kind = 'expert' AND d.plane = po.plane GROUP BY ALL), "
    "sz AS (SELECT segment_id, count(*) AS size FROM e GROUP BY ALL), "
    "bk AS (SELECT query_id, bs.segment_id, table_id, sig, fit + ln(cnt + 1) + 0.25 * (cnt / size) * ln(cnt / size) AS score FROM bs JOIN sz USING (segment_id)), "
    "ev AS (SELECT query_id, bk.segment_id, row_id, sum(score) AS score, count(*) AS votes FROM bk JOIN sg USING (segment_id, table_id, sig) GROUP BY ALL) "
)

_ROUTED = (
    f"p AS ({_POST.format(source='m')}), s AS (SELECT x.id AS query_id, p.segment_id, sum({_DENSITY.replace('t -', 'x.val -')}) AS score FROM x JOIN p ON x.pos = p.pos WHERE x.id < {{n}} GROUP BY ALL), "
    "r AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS w FROM s), "
    "o AS (SELECT *, w / sum(w) OVER (PARTITION BY query_id) AS mass FROM r), "
    "u AS (SELECT *, sum(mass) OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS total, coalesce(sum(mass) OVER (PARTITION BY query_id ORDER BY score DESC, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)"
).replace("{n}", "20")
_ROUTE = f"WITH {_E}, {_X}, {_M}, {_ROUTED} "
# ranks, budgets and what they need, out of the evidence in the table {ev}
_BUDGET = (
    ", rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, segment_id ORDER BY score DESC, votes DESC, row_id) AS rank, max(score) OVER (PARTITION BY query_id, segment_id) AS s1 FROM {ev}), "
    "st AS (SELECT query_id, segment_id, count(*) AS found, any_value(s1) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2, sum(CASE WHEN rank <= 16 THEN exp(score - s1) END) AS top, max(CASE WHEN rank = 1 THEN votes END) AS v1, coalesce(max(CASE WHEN rank = 2 THEN votes END), 0) AS v2 FROM rk GROUP BY ALL), "
    "cf AS (SELECT *, least(greatest(greatest(s1 - coalesce(s2, s1 - 1), 0) / (abs(s1) + 1e-6), 0), 1) AS lead, least(greatest(0.7 * least(v1 / 4, 1) + 0.3 * least(greatest((v1 - v2) / 4, 0), 1), 0), 1) AS vc FROM st), "
    "bu AS (SELECT *, CAST(least(greatest(round(32 + 224 * pow(1 - least(greatest(0.55 * vc + 0.30 / top + 0.15 * lead, 0), 1), 2.2)), 32), 256) AS BIGINT) AS budget FROM cf)"
)
# rows of the best pair quantised again as one segment with the next free number (z.once: after the first time, z.y: in the end)
_TWICE = (
    _BIC.rstrip() + f", {_C}, best AS (SELECT left_id, right_id, gain FROM g WHERE gain > 0 ORDER BY gain DESC, left_id, right_id LIMIT 1), "
    "f AS (SELECT c.*, lo + (hi - lo) / 255 * code AS once, coalesce(segment_id IN (left_id, right_id), FALSE) AS merged, CASE WHEN segment_id = right_id THEN row_id + (SELECT max(n) FROM m WHERE segment_id = left_id) ELSE row_id END AS new_row FROM c LEFT JOIN best ON TRUE), "
    "f2 AS (SELECT *, min(once) OVER (PARTITION BY pos, merged) AS low, max(once) OVER (PARTITION BY pos, merged) AS high FROM f), "
    "z AS (SELECT id, CASE WHEN merged THEN (SELECT max(segment_id) + 1 FROM m) ELSE segment_id END AS segment_id, new_row AS row_id, pos, val, once, merged, "
    "CASE WHEN merged THEN low + (high - low) / 255 * least(greatest(round((once - low) / greatest(high - low, 1e-12) * 255), 0), 255) ELSE once END AS y FROM f2) "
)


def _turbo_sql() -> str:
    """The quantiser's matrices as a table tm(kind, i, j, w), and its codebook as cb(low, high, center)."""
    q = turbo.Turbo(TURBO)
    rows = [f"('{kind}', {i}, {j}, {float(w)!r}::DOUBLE)" for kind, m in (("rotation", q.rotation), ("projection", q.projection)) for i, line in enumerate(m) for j, w in enumerate(line)]
    ends = [-2.0, *map(float, q.bounds), 2.0]
    cells = [f"({a!r}::DOUBLE, {b!r}::DOUBLE, {float(c)!r}::DOUBLE)" for a, b, c in zip(ends, ends[1:], q.centers)]
    return f"tm(kind, i, j, w) AS (VALUES {', '.join(rows)}), cb(low, high, center) AS (VALUES {', '.join(cells)})"


ORACLE_SQL = {
    "exact_knn_l2": _knn("list_distance(qv, v)"),
    "exact_knn_cosine": _knn("list_cosine_distance(qv, v)"),
    "exact_knn_dot": _knn("-list_inner_product(qv, v)"),
    "knn_custom_metric": f"WITH {_E}, {_X}, q AS (SELECT id AS query_id, pos, val AS qval FROM x WHERE id < 5) " + _top("SELECT query_id, id, sum(abs(qval - val)) AS distance FROM q JOIN x USING (pos) GROUP BY ALL"),
    "knn_threshold": _knn("list_distance(qv, v)", "list_distance(qv, v) <= 1.2"),
    "knn_dedup_min": f"WITH {_E}, {_Q} " + _top("SELECT query_id, id, list_distance(qv, v) AS distance FROM q, e UNION ALL SELECT query_id, id, list_distance(qv, list_transform(v, lambda x: x * 0.9)) FROM q, e"),
    "knn_filtered": _knn("list_distance(qv, v)", "label = 3", 5),
    "vector_norms": f"WITH {_E} SELECT id, round(list_inner_product(v, v), 6) AS norm_sq, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM e",
    "dot_products": f"WITH {_E} SELECT e.id, round(list_inner_product(o.v, e.v), 6) AS dot, round(list_cosine_similarity(o.v, e.v), 6) AS cosine FROM e, (SELECT v FROM e WHERE id = 0) o",
    "l2_prefix": f"WITH {_E} SELECT e.id, round(list_distance(o.v[1:16], e.v[1:16]) ** 2, 6) AS l2_sq_16, round(list_distance(o.v, e.v) ** 2, 6) AS l2_sq FROM e, (SELECT v FROM e WHERE id = 0) o",
    "sparse_dots": f"WITH {_E} SELECT id, round(0.1 + 0.5 * v[4] - 1.25 * v[18] + 2.0 * v[41], 6) AS dot FROM e",
    "sq8_minmax": f"WITH {_E}, {_X}, {_M} SELECT segment_id, pos, round(lo, 6) AS lo, round(hi, 6) AS hi FROM m",
    "sq8_codes": f"WITH {_E}, {_X}, {_M}, {_C} SELECT id, pos, code FROM c",
    "sq8_decode_error": f"WITH {_E}, {_X}, {_M}, {_C} SELECT id, round(sqrt(sum((val - (lo + (hi - lo) / 255 * code)) ** 2)), 6) AS error FROM c GROUP BY id",
    "adc_knn": f"WITH {_E}, {_X}, {_M}, {_C}, q AS (SELECT id AS query_id, pos, val AS qval FROM x WHERE id < 5) "
    + _top("SELECT query_id, id, sqrt(sum(((hi - lo) / 255 * ((qval - lo) / greatest((hi - lo) / 255, 1e-12) - code)) ** 2)) AS distance FROM q JOIN c USING (pos) GROUP BY ALL"),
    "decoded_knn": f"WITH {_E}, {_X}, {_M}, {_C}, q AS (SELECT id AS query_id, pos, val AS qval FROM x WHERE id < 5) "
    + _top("SELECT query_id, id, sqrt(sum((qval - (lo + (hi - lo) / 255 * code)) ** 2)) AS distance FROM q JOIN c USING (pos) GROUP BY ALL"),
    "segment_telemetry": f"WITH {_E}, {_X}, {_M}, o AS (SELECT id, segment_id, sum((val - mean) ** 2) AS off, sqrt(sum(val * val)) AS size FROM x JOIN m USING (segment_id, pos) GROUP BY ALL) "
    "SELECT o.segment_id, count(*) AS vector_count, round(avg(size), 6) AS mean_norm, round(max(off), 6) AS radius_sq, round(any_value(c), 6) AS centroid_norm FROM o JOIN (SELECT segment_id, sqrt(sum(mean * mean)) AS c FROM m GROUP BY ALL) USING (segment_id) GROUP BY ALL",
    "segment_centroids": f"WITH {_E}, {_X}, {_M} SELECT segment_id, pos, round(mean, 6) AS mean FROM m",
    "root_stats": f"WITH {_E}, {_X}, {_M} SELECT segment_id, pos, CAST(n AS DOUBLE) AS n, round(mean, 6) AS mean, round(m2, 6) AS m2 FROM m",
    "centroid_distances": f"WITH {_E}, {_X}, {_M} SELECT a.segment_id AS left_id, b.segment_id AS right_id, round(sqrt(sum((a.mean - b.mean) ** 2)), 6) AS distance FROM m a JOIN m b ON a.pos = b.pos AND a.segment_id < b.segment_id GROUP BY ALL",
    "nig_root_scores": _ROUTE + "SELECT query_id, segment_id, round(score, 6) AS score FROM s",
    "routing_mass": _ROUTE + "SELECT query_id, segment_id, round(mass, 6) AS mass, before < 0.95 AS selected FROM u",
    "routing_explain": _ROUTE + ", f AS (SELECT *, before < 0.8 AS selected FROM u) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY selected DESC, CASE WHEN selected THEN -score END, segment_id) - 1 AS place, segment_id, "
    "CAST(0.8 AS DOUBLE) AS target_mass, round(mass, 6) AS mass, round(CASE WHEN selected THEN total ELSE max(CASE WHEN selected THEN total END) OVER (PARTITION BY query_id) END, 6) AS cumulative_mass, selected FROM f",
    "bic_pairs": _BIC + "SELECT left_id, right_id, round(gain, 6) AS gain FROM g",
    "compaction_choice": _BIC + "SELECT left_id, right_id, round(gain, 6) AS gain FROM g WHERE left_id % 4 < 3 AND right_id % 4 < 3 AND gain > 0 ORDER BY gain DESC, left_id, right_id LIMIT 1",
    "lsh_signatures": _HASHED + "SELECT id, table_id, sig FROM sg",
    "lsh_postings_count": _HASHED + "SELECT segment_id, table_id, count(DISTINCT sig) AS buckets FROM sg GROUP BY ALL",
    "lsh_probe_counts": _HASHED + "SELECT query_id, pr.table_id, count(*) AS rows FROM pr JOIN sg USING (table_id, sig) GROUP BY ALL",
    "bucket_experts": _HASHED + "SELECT segment_id, table_id, sig, n AS cnt, CAST(plane AS BIGINT) AS pos, round(mean, 6) AS mean, round(m2, 6) AS m2 FROM ex",
    "row_evidence": _EVIDENCE + "SELECT query_id, segment_id, row_id, round(score, 6) AS score, votes FROM ev",
    "adaptive_budget": _EVIDENCE + _BUDGET.replace("{ev}", "ev") + " SELECT query_id, segment_id, budget, least(budget, found) AS rows FROM bu",
    "ann_search": _EVIDENCE + f", {_M}, {_C}, {_ROUTED}, rv AS (SELECT ev.* FROM ev JOIN u USING (query_id, segment_id) WHERE u.before < 0.95)" + _BUDGET.replace("{ev}", "rv")
    + ", q AS (SELECT id AS query_id, pos, val AS qval FROM x WHERE id < 5), ch AS (SELECT query_id, segment_id, row_id FROM rk JOIN bu USING (query_id, segment_id) WHERE rank <= budget) "
    + _top("SELECT query_id, id, sqrt(sum((qval - (lo + (hi - lo) / 255 * code)) ** 2)) AS distance FROM ch JOIN c USING (segment_id, row_id) JOIN q USING (query_id, pos) GROUP BY ALL"),
    "compact_roundtrip": f"WITH {_E}, {_X}, {_M}, {_C} SELECT CAST(99 AS BIGINT) AS segment_id, id AS row_id, id, round(sqrt(sum((val - (lo + (hi - lo) / 255 * code)) ** 2)), 6) AS error FROM c WHERE id < 250 GROUP BY id",
    "store_roundtrip": f"WITH {_E.replace('125', '200')}, {_X}, {_M}, {_C} SELECT id, segment_id, row_id, round(sqrt(sum((val - (lo + (hi - lo) / 255 * code)) ** 2)), 6) AS error FROM c GROUP BY ALL",
    "store_compacted": _TWICE + "SELECT id, segment_id, row_id, round(sqrt(sum((val - y) ** 2)), 6) AS error FROM z GROUP BY ALL",
    "store_next_compaction": _TWICE + "SELECT left_id, right_id, CAST(0 AS BIGINT) AS left_depth, CAST(0 AS BIGINT) AS right_depth, l.n AS left_count, r.n AS right_count, CAST(0 AS BIGINT) AS left_visits, CAST(0 AS BIGINT) AS right_visits, "
    "l.n + r.n AS vectors_rewritten, (l.n + r.n) * 256 AS bytes_rewritten, round(distance, 6) AS centroid_distance, round(gain, 6) AS gain, round(drift, 6) AS drift FROM best "
    "JOIN (SELECT segment_id, max(n) AS n FROM m GROUP BY ALL) l ON l.segment_id = left_id JOIN (SELECT segment_id, max(n) AS n FROM m GROUP BY ALL) r ON r.segment_id = right_id, "
    "(SELECT sqrt(sum((a.val - b.val) ** 2)) AS distance FROM (SELECT pos, mean AS val, segment_id FROM m) a JOIN (SELECT pos, mean AS val, segment_id FROM m) b USING (pos), best WHERE a.segment_id = left_id AND b.segment_id = right_id), "
    "(SELECT sqrt(sum((once - y) ** 2)) AS drift FROM z WHERE merged)",
    "stream_seal": "SELECT i AS segment_id, least(200, n - 200 * i) AS vector_count FROM (SELECT n, unnest(range(0, (n + 199) // 200)) AS i FROM (SELECT count(*) AS n FROM embeddings))",
    "turbo_inner_products": f"WITH {_E}, {_X}, {_turbo_sql()}, sz AS (SELECT id, sqrt(sum(val * val)) AS size FROM x GROUP BY id), n AS (SELECT id, pos, val / size AS val FROM x JOIN sz USING (id)), "
    "ro AS (SELECT id, j, sum(val * w) AS val FROM n JOIN tm ON kind = 'rotation' AND i = pos GROUP BY ALL), ix AS (SELECT id, j, (SELECT center FROM cb WHERE val > low AND val <= high) AS center FROM ro), "
    "un AS (SELECT id, i AS pos, sum(center * w) AS val FROM ix JOIN tm ON kind = 'rotation' AND tm.j = ix.j GROUP BY ALL), re AS (SELECT id, pos, n.val - un.val AS val FROM n JOIN un USING (id, pos)), "
    "rn AS (SELECT id, CAST(CAST(sqrt(sum(val * val)) AS FLOAT) AS DOUBLE) AS rest FROM re GROUP BY id), sg AS (SELECT id, i AS k, CASE WHEN sum(val * w) >= 0 THEN 1.0 ELSE -1.0 END AS sign FROM re JOIN tm ON kind = 'projection' AND j = pos GROUP BY ALL), "
    "qv AS (SELECT pos, val FROM x WHERE id = 0), qp AS (SELECT i AS k, sum(val * w) AS val FROM qv JOIN tm ON kind = 'projection' AND j = pos GROUP BY ALL), "
    "a AS (SELECT id, sum(un.val * qv.val) AS dot FROM un JOIN qv USING (pos) GROUP BY id), b AS (SELECT id, sum(sign * qp.val) AS dot FROM sg JOIN qp USING (k) GROUP BY id) "
    "SELECT id, round((a.dot + sqrt(pi() / 2) / 64 * b.dot * rest) * CAST(CAST(size AS FLOAT) AS DOUBLE), 5) AS score FROM a JOIN b USING (id) JOIN rn USING (id) JOIN sz USING (id)",
    "segment_top_ids": f"WITH {_E} SELECT segment_id, rank, id, round(size, 6) AS size FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY size DESC, id) AS rank FROM (SELECT segment_id, id, sqrt(list_inner_product(v[1:8], v[1:8])) AS size FROM e)) WHERE rank <= 3",
    "ln_gamma_values": f"WITH {_E} SELECT id, round(lgamma((id + 1) / 2), 6) AS value FROM e",
}
