import numpy as np
import numpy_model as model
import pytest
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.errors import InvalidVectorDimension
from lodestar.operators import candidates, compaction, index, routing, search, segments
from lodestar.operators.planes import make_planes, planes_frame, planes_from_rows, probe_masks

CONFIG = Config(dimension=16, lsh_num_tables=3, lsh_bits_per_table=6, lsh_bucket_expert_dims=2, lsh_min_candidates=32, lsh_max_candidates=64, seed=5)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 16))
    x = 0.85 * centers[np.arange(600) // 100] + 0.15 * rng.normal(size=(600, 16))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, i, v.tolist()) for i, v in enumerate(x)], "id long, at long, vector array<double>").repartition(3)


def queries(spark, q):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.distance)
    return {q: [v[k] for k in sorted(v)] for q, v in out.items()}


def test_exact_knn_equals_sorting(spark, data):
    got = result(search.exact_knn(frame(spark, data), queries(spark, data[:7]), 9))
    for i, q in enumerate(data[:7]):
        d = np.linalg.norm(data - q, axis=1)
        want = sorted(range(len(d)), key=lambda j: (d[j], j))[:9]
        assert [x for x, _ in got[i]] == want and got[i][0] == (i, 0.0)


def test_ties_duplicates_nan_threshold(spark):
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 0.0]), (9, [1.0, 0.5]), (7, [float("nan"), 0.0]), (1, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    assert result(search.exact_knn(df, q, 10))[0][:3] == [(3, 0.0), (5, 0.0), (9, 0.5)]
    assert [i for i, _ in result(search.exact_knn(df, q, 10))[0][3:]] == [1, 7]
    assert [i for i, _ in result(search.exact_knn(df, q, 10, threshold=0.4))[0]] == [3, 5, 7]
    assert [i for i, _ in result(search.exact_knn(df, q, 1))[0]] == [3]
    assert search.exact_knn(df, q, 0).count() == 0
    short = spark.createDataFrame([(0, [1.0])], "query_id long, vector array<double>")
    assert search.exact_knn(df, short, 3).count() == 0
    with pytest.raises(InvalidVectorDimension):
        search.check_dimension(short, 2)
    assert search.exact_knn(df.limit(0), q, 3).count() == 0 and search.exact_knn(df, q.limit(0), 3).count() == 0


@pytest.mark.parametrize("name", ["cosine", "dot"])
def test_other_metrics(spark, data, name):
    got = result(search.exact_knn(frame(spark, data), queries(spark, data[:3]), 5, name))
    s = data @ data[:3].T
    assert all([i for i, _ in got[q]] == sorted(range(len(data)), key=lambda j: (-s[j, q], j))[:5] for q in range(3))


@pytest.fixture(scope="module")
def built(spark, data):
    rows = segments.assign_segments(frame(spark, data), 150)
    own = segments.with_posteriors(segments.segment_stats(rows))
    planes = make_planes(CONFIG)
    tables = index.by_table(index.hashed(rows, planes, ["segment_id", "row_id"]), ["segment_id", "row_id"], 2)
    return rows, own, planes, index.experts(tables, 2).cache(), index.postings(tables).cache(), segments.encode_rows(rows, own).cache()


def test_search_equals_the_model(spark, data, built):
    rows, own, planes, experts, postings, coded = built
    parts, ids = [data[a : a + 150] for a in range(0, 600, 150)], [list(range(a, a + 150)) for a in range(0, 600, 150)]
    q = data[::61] + 0.01
    for delta in (0.05, 0.3, 0.6):
        chosen, _ = search.ann_candidates(queries(spark, q), own, experts, postings, planes, CONFIG, delta)
        got = result(search.finish(search.rerank(chosen, coded, own, queries(spark, q), "l2"), 10))
        for i, v in enumerate(q):
            want = model.search(v, parts, ids, planes, CONFIG, 10, delta)
            assert [x for x, _ in got.get(i, [])] == [x for _, x in want]
            assert np.allclose([d for _, d in got.get(i, [])], [d for d, _ in want])


def test_evidence_and_budget_equal_the_model(spark, data, built):
    _, own, planes, experts, postings, _ = built
    q = data[3:4]
    selected = own.select(F.lit(0).cast("long").alias("query_id"), "segment_id", "vector_count").where("segment_id = 0")
    tables = index.by_table(index.hashed(queries(spark, q), planes, ["query_id"]), ["query_id"], 2)
    evidence = candidates.row_evidence(candidates.bucket_scores(candidates.probes(tables, 6, 2), experts, selected), postings)
    want = model.evidence(q[0], data[:150], planes, 2)
    got = {r.row_id: (r.score, r.votes) for r in evidence.collect()}
    assert got.keys() == want.keys() and all(got[r] == pytest.approx(tuple(want[r])) for r in got)
    cut = candidates.within_budget(evidence, CONFIG).orderBy("rank").collect()
    n, order = model.budget(want, CONFIG)
    assert cut[0].budget == n and [r.row_id for r in cut] == order


def test_recall_on_clusters_and_self_query(spark, data, built):
    planes = built[2]
    rows = segments.assign_segments(frame(spark, data), 600)
    own = segments.with_posteriors(segments.segment_stats(rows))
    tables = index.by_table(index.hashed(rows, planes, ["segment_id", "row_id"]), ["segment_id", "row_id"], 2)
    experts, postings, coded = index.experts(tables, 2), index.postings(tables), segments.encode_rows(rows, own)
    q = data[::20]
    chosen, _ = search.ann_candidates(queries(spark, q), own, experts, postings, planes, CONFIG.with_(lsh_max_candidates=128, lsh_min_candidates=128), 0.01)
    got = result(search.finish(search.rerank(chosen, coded, own, queries(spark, q), "l2"), 10))
    exact = result(search.exact_knn(frame(spark, data), queries(spark, q), 10))
    assert np.mean([got[i][0][0] == 20 * i for i in range(len(q))]) > 0.95
    assert np.mean([len({x for x, _ in got[i]} & {x for x, _ in exact[i]}) / 10 for i in range(len(q))]) > 0.6


def unit_segments(spark, dim, centers):
    rows = [(s, i, s * 1000 + i, [c + i * 0.0001] * dim) for s, c in enumerate(centers) for i in range(32)]
    return segments.with_posteriors(segments.segment_stats(spark.createDataFrame(rows, "segment_id long, row_id int, id long, vector array<double>")))


def test_less_delta_selects_no_fewer_segments(spark):
    own = unit_segments(spark, 16, [0.1, 1.0, 2.0, 3.0])
    scores = routing.root_scores(queries(spark, np.full((1, 16), 0.1)), own)
    few, many = (routing.route(scores, d).where("selected").count() for d in (0.5, 0.01))
    assert many >= few >= 1
    assert routing.route(scores, 0.0).where("selected").count() >= many


def test_segments_at_the_depth_cap_are_not_paired(spark):
    own = unit_segments(spark, 8, [0.0, 0.1, 0.2]).withColumn("depth", F.when(F.col("segment_id") == 2, 2).otherwise(3))
    assert compaction.best_pair(own, 3).first() is None
    assert compaction.pair_gains(own.withColumn("depth", F.lit(2)), 3).count() == 3


def test_routing_report(spark, built):
    _, own, *_ = built
    rows = routing.explain_routing(routing.root_scores(queries(spark, np.full((1, 16), 0.1)), own), 0.05).orderBy("place").collect()
    taken = [r for r in rows if r.selected]
    assert len(rows) == 4 and rows[: len(taken)] == taken and sum(r.mass for r in rows) == pytest.approx(1)
    assert all(r.cumulative_mass == taken[-1].cumulative_mass for r in rows[len(taken) :]) and taken[-1].cumulative_mass >= 0.95


def test_nan_query_takes_all_segments(spark, built):
    _, own, *_ = built
    q = np.zeros((1, 16))
    q[0, 3] = np.nan
    assert routing.route(routing.root_scores(queries(spark, q), own), 0.05).where("selected").count() == 4


def test_planes_round_trip_and_sparsity(spark):
    p = make_planes(CONFIG)
    back = planes_from_rows(planes_frame(spark, p).collect(), 3, 6, 2, 16)
    assert all((a == b).all() for a, b in zip((p.hash, p.hash_bias, p.expert, p.expert_bias), (back.hash, back.hash_bias, back.expert, back.expert_bias)))
    assert ((p.hash != 0).sum(axis=2) == 8).all() and np.allclose(np.linalg.norm(p.hash, axis=2), 1)


def test_probe_masks_and_64_bits():
    assert [len(probe_masks(16, r)) for r in (0, 1, 2)] == [1, 17, 137]
    masks = probe_masks(64, 2)
    assert len(set(masks)) == 1 + 64 + 64 * 63 // 2 and min(masks) == -(1 << 63)
    p = make_planes(CONFIG.with_(lsh_bits_per_table=64))
    assert p.signatures(np.full((1, 16), 3.0)).dtype == np.int64


def test_config_clamps():
    c = Config(lsh_bits_per_table=99, lsh_probe_hamming_radius=7, lsh_max_candidates=10, lsh_min_candidates=500, lsh_adaptive_gamma=9, delta=2, num_workers=0)
    assert (c.lsh_bits_per_table, c.lsh_probe_hamming_radius, c.lsh_max_candidates, c.lsh_min_candidates, c.lsh_adaptive_gamma, c.delta, c.num_workers) == (64, 2, 64, 64, 4.0, 1.0, 1)
    assert Config().max_active_vectors == 204_800 and Config(segment_capacity_mb=0).max_active_vectors == 1
    with pytest.raises(ValueError):
        Config(dimension=0)


def test_single_row_and_constant_segments(spark):
    rows = spark.createDataFrame([(0, 0, 1, [1.0, 2.0]), (1, 0, 2, [3.0, 3.0]), (1, 1, 3, [3.0, 4.0])], "segment_id long, row_id int, id long, vector array<double>")
    own = segments.with_posteriors(segments.segment_stats(rows))
    coded = segments.encode_rows(rows, own)
    assert {r.id: r.vector for r in segments.decode_rows(coded, own).collect()} == {1: [1.0, 2.0], 2: [3.0, 3.0], 3: [3.0, 4.0]}
    assert {r.segment_id: r.vector_count for r in own.collect()} == {0: 1, 1: 2}
    scores = routing.root_scores(queries(spark, np.ones((1, 2))), own).collect()
    assert len(scores) == 2 and all(np.isfinite(r.score) for r in scores)
    out = segments.external_ids(coded, spark.createDataFrame([(1, 1), (1, 9)], "segment_id long, row_id int")).collect()
    assert {(r.row_id, r.id) for r in out} == {(1, 3), (9, None)}


def test_repeated_ids_do_not_turn_the_cut_off():
    rng = np.random.default_rng(4)
    d, ids = rng.random((20, 1000)), np.arange(1000)
    ids[500] = 3
    d[:, 7], d[2] = np.nan, np.nan
    got, own = search.nearest(d, ids, 5)
    assert (np.isfinite(got).sum(axis=1) <= 6).all() and not np.isfinite(got[2]).any()
    for row in (0, 1, 19):
        best = {}
        for i, v in zip(ids, d[row]):
            if not np.isnan(v):
                best[i] = min(v, best.get(i, 9.0))
        want = sorted(best.items(), key=lambda x: (x[1], x[0]))[:5]
        have = sorted(((i, v) for i, v in zip(own, got[row]) if not np.isnan(v)), key=lambda x: (x[1], x[0]))[:5]
        assert have == want
