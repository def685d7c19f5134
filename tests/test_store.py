import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.errors import IndexOutOfBounds, InvalidHeader, InvalidVectorDimension, InvariantViolation, StorageError, TaskError, UnsupportedVersion
from lodestar.operators import compaction
from lodestar.sources.store import VectorStore
from lodestar.streaming.ingest import ingest

SMALL = Config(dimension=8, lsh_num_tables=3, lsh_bits_per_table=4, lsh_bucket_expert_dims=2, lsh_min_candidates=64, lsh_max_candidates=128, max_segment_rows=40, compaction_trigger=99)


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<float>").repartition(3)


def test_life_of_a_store(spark, tmp_path):
    at, x = str(tmp_path / "s"), vectors(110)
    store = VectorStore.create(spark, at, SMALL)
    assert store.num_sealed_segments() == 0 and store.search(frame(spark, x[:1]).withColumnRenamed("id", "query_id"), 3).count() == 0
    with pytest.raises(StorageError):
        VectorStore.create(spark, at, SMALL)
    store.insert(frame(spark, x[:30]))
    assert store.num_sealed_segments() == 0 and store.staged_rows().count() == 30
    store.insert(frame(spark, x[30:], 30))
    assert store.num_sealed_segments() == 2 and store.staged_rows().count() == 30
    assert sorted(r.id for r in store.table("codes").collect()) == sorted(set(range(110)) - {r.id for r in store.staged_rows().collect()})
    q = frame(spark, x[100:102]).withColumnRenamed("id", "query_id")
    active = store.search(q, 110, "l2", delta=0.0, include_active=True)
    assert active.where("rank = 1 AND distance < 0.05").count() == 2
    store.flush()
    assert store.num_sealed_segments() == 3 and store.staged_rows().count() == 0
    assert sorted(r.id for r in store.table("codes").collect()) == list(range(110))
    assert [r.vector_count for r in store.sealed_segment_summaries().orderBy("segment_id").collect()] == [40, 40, 30]
    again = VectorStore.open(spark, at)
    key = lambda s: sorted(map(tuple, s.search(q, 5, "l2").collect()))
    assert key(again) == key(store) and again.config == SMALL and "segments=3" in repr(again)
    store.flush()
    assert store.num_sealed_segments() == 3


def test_results_are_exact_results_by_decoded_distance(spark, tmp_path):
    x = vectors(100, 3)
    store = VectorStore.create(spark, str(tmp_path / "s"), SMALL)
    store.insert(frame(spark, x))
    store.flush()
    ids, distances, counts = store.query_batch(x[:4], 7, "l2", delta=0.0)
    decoded = {r.id: np.array(r.vector) for r in __import__("lodestar.operators.segments", fromlist=["x"]).decode_rows(store.table("codes"), store.table("segments")).collect()}
    for i in range(4):
        assert ids[i, 0] == i and counts[i] == 7
        assert np.allclose(distances[i], [np.linalg.norm(decoded[j] - x[i]) for j in ids[i]]) and (np.diff(distances[i]) >= 0).all()
    found = store.query(x[0], 3, "cosine")
    assert found[0][0] == 0 and len(found) == 3
    assert store.query(x[0], 3, threshold=-1.0) == [] and store.query(x[0], 0) == []
    assert sum(r.query_visits for r in store.sealed_segment_summaries().collect()) >= 1
    with pytest.raises(InvalidVectorDimension):
        store.query(x[0][:5], 3)
    wrong = spark.createDataFrame([(0, [1.0] * 7)], "query_id long, vector array<double>")
    assert store.search(wrong, 3).count() == 0
    report = store.explain_query_routing(frame(spark, x[:2]).withColumnRenamed("id", "query_id"))
    assert report.count() == 6


def test_bad_rows_are_refused_whole(spark, tmp_path):
    store = VectorStore.create(spark, str(tmp_path / "s"), SMALL)
    bad = spark.createDataFrame([(1, [0.0] * 8), (2, [0.0] * 7)], "id long, vector array<float>")
    with pytest.raises(InvalidVectorDimension):
        store.insert(bad)
    with pytest.raises(ValueError):
        store.insert_batch(np.zeros((2, 8)), np.zeros(3))
    assert store.staged_rows().count() == 0
    store.insert(bad.limit(0))
    store.insert_batch(np.ones((2, 8)), np.array([5, 5]))
    store.flush()
    assert store.query(np.ones(8), 5, "l2") == [(5, 0.0)]


def test_opening_errors(spark, tmp_path):
    with pytest.raises(StorageError):
        VectorStore.open(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(StorageError):
        VectorStore.open(spark, str(tmp_path / "empty"))
    for text, error in (("{", InvalidHeader), ("{}", InvalidHeader), (json.dumps({"format": "lodestar-vectors", "format_version": 9}), UnsupportedVersion)):
        at = tmp_path / error.__name__ / str(len(text)) / "manifest"
        at.mkdir(parents=True)
        (at / "0000000001.json").write_text(text)
        with pytest.raises(error):
            VectorStore.open(spark, str(at.parent))


def test_compaction_keeps_ids_and_visits(spark, tmp_path):
    config = SMALL.with_(max_segment_rows=20, compaction_trigger=4, compaction_depth_cap=2)
    store = VectorStore.create(spark, str(tmp_path / "s"), config)
    store.insert(frame(spark, vectors(70, 5)))
    store.query(vectors(1, 5)[0], 3, delta=0.0)
    before = store.sealed_segment_summaries().agg(F.sum("query_visits")).first()[0]
    plan = store.explain_next_compaction().first()
    assert plan.gain > 0 and plan.left_id < plan.right_id and plan.vectors_rewritten == 40 and plan.bytes_rewritten == 40 * 32 and 0 <= plan.drift < 0.2
    assert store.explain_next_compaction(with_drift=False).columns == [c for c in store.explain_next_compaction().columns if c != "drift"]
    store.flush()
    assert store.num_sealed_segments() == 3 and sorted(r.id for r in store.table("codes").collect()) == list(range(70))
    assert max(s["depth"] for s in store.manifest["live"]) == 1
    assert store.sealed_segment_summaries().agg(F.sum("query_visits")).first()[0] == before > 0
    rows = store.table("codes").groupBy("segment_id").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("d"), F.max("row_id").alias("top")).collect()
    assert all(r.n == r.d == r.top + 1 for r in rows)
    new = {s["segment_id"] for s in store.manifest["live"]}
    assert len(new) == 3 and max(new) < store.manifest["next_segment_id"]
    store.save()
    assert VectorStore.open(spark, str(tmp_path / "s")).table("codes").count() == 70


def test_other_settings_after_opening(spark, tmp_path):
    at, x = str(tmp_path / "s"), vectors(40, 6)
    store = VectorStore.create(spark, at, SMALL)
    store.insert(frame(spark, x))
    other = VectorStore.open(spark, at, SMALL.with_(lsh_bits_per_table=3, seed=9))
    other.insert(frame(spark, vectors(40, 7), 40))
    assert len(other.manifest["configs"]) == 2
    assert other.query(x[0], 1, "l2", delta=0.0)[0][0] == 0 and other.query(vectors(40, 7)[5], 1, "l2", delta=0.0)[0][0] == 45
    with pytest.raises(InvalidVectorDimension):
        VectorStore.open(spark, at, SMALL.with_(dimension=9))


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    x = vectors(100, 8)
    frame(spark, x).repartition(2).write.parquet(str(tmp_path / "in"))
    store = VectorStore.create(spark, str(tmp_path / "s"), SMALL)
    stream = spark.readStream.schema("id long, vector array<float>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, store, str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert store.manifest["streams"]["ingest"] == 1 and store.num_sealed_segments() == 2
    again = VectorStore.open(spark, str(tmp_path / "s"))
    ingest(stream, again, str(tmp_path / "c2"), availableNow=True).awaitTermination()  # the batches come again
    again.flush()
    assert sorted(r.id for r in again.table("codes").collect()) == list(range(100))


def test_a_batch_that_failed_after_its_commit_is_not_inserted_again(spark, tmp_path, monkeypatch):
    frame(spark, vectors(50, 9)).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = VectorStore.create(spark, str(tmp_path / "s"), SMALL)
    stream = lambda: spark.readStream.schema("id long, vector array<float>").parquet(str(tmp_path / "in"))
    seal = VectorStore._seal
    monkeypatch.setattr(VectorStore, "_seal", lambda self, whole_only: 1 / 0)
    with pytest.raises(Exception):
        ingest(stream(), store, str(tmp_path / "c"), availableNow=True).awaitTermination()
    monkeypatch.setattr(VectorStore, "_seal", seal)
    assert store.manifest["streams"]["ingest"] == 0 and store.staged_rows().count() == 50
    ingest(stream(), store, str(tmp_path / "c"), availableNow=True).awaitTermination()
    store.flush()
    assert sorted(r.id for r in store.table("codes").collect()) == list(range(50))


def test_a_batch_that_failed_before_its_commit_is_inserted(spark, tmp_path, monkeypatch):
    frame(spark, vectors(50, 9)).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = VectorStore.create(spark, str(tmp_path / "s"), SMALL)
    stream = lambda: spark.readStream.schema("id long, vector array<float>").parquet(str(tmp_path / "in"))
    insert = VectorStore.insert
    monkeypatch.setattr(VectorStore, "insert", lambda self, rows: 1 / 0)
    with pytest.raises(Exception):
        ingest(stream(), store, str(tmp_path / "c"), availableNow=True).awaitTermination()
    monkeypatch.setattr(VectorStore, "insert", insert)
    assert store.manifest["streams"] == {}
    ingest(stream(), store, str(tmp_path / "c"), availableNow=True).awaitTermination()
    store.flush()
    assert sorted(r.id for r in store.table("codes").collect()) == list(range(50))


def test_results_have_names_and_batches_count_visits(spark, tmp_path):
    x = vectors(80, 3)
    store = VectorStore.create(spark, str(tmp_path / "s"), SMALL)
    store.insert(frame(spark, x))
    found = store.query_batch(x[:3], 2, "l2", delta=0.0)
    assert found.counts.tolist() == [2, 2, 2] and found.ids[1, 0] == 1 and found.distances.shape == (3, 2)
    assert store.sealed_segment_summaries().agg(F.sum("query_visits")).first()[0] == 6
    one = store.query(x[5], 1, "l2", delta=0.0)[0]
    assert one.id == 5 and one.distance < 0.05
    assert store.sealed_segment_summaries().agg(F.sum("query_visits")).first()[0] == 8
    codes = store.table("codes").where("id = 41").first()
    assert store.external_id(codes.segment_id, codes.row_id) == 41
    with pytest.raises(IndexOutOfBounds):
        store.external_id(0, 4000)


def test_a_failing_job_and_a_manifest_that_contradicts_itself(spark, tmp_path, monkeypatch):
    store = VectorStore.create(spark, str(tmp_path / "s"), SMALL)
    monkeypatch.setattr("lodestar.sources.store.segments.segment_stats", lambda rows: 1 / 0)
    with pytest.raises(TaskError):
        store.insert(frame(spark, vectors(40, 2)))
    monkeypatch.undo()
    store.reload()
    store.flush()
    assert store.table("codes").count() == 40
    store.manifest["live"].append(dict(store.manifest["live"][0]))
    store._commit()
    with pytest.raises(InvariantViolation):
        VectorStore.open(spark, store.path)


def test_gains_kept_between_merges_are_those_counted_anew(spark, tmp_path):
    config = SMALL.with_(max_segment_rows=10, compaction_trigger=99)
    store = VectorStore.create(spark, str(tmp_path / "s"), config)
    store.insert(frame(spark, vectors(60, 4)))
    gains = store._gains(None)
    assert store._merge(gains)
    key = lambda df: sorted((r.left_id, r.right_id, round(r.gain, 9)) for r in df.collect())
    assert key(store._gains(gains)) == key(compaction.pair_gains(store.table("segments"), config.compaction_depth_cap))


def test_tables_of_many_segments_are_joined_not_listed(spark, tmp_path, monkeypatch):
    store = VectorStore.create(spark, str(tmp_path / "s"), SMALL)
    store.insert(frame(spark, vectors(120, 4)))
    want = sorted(map(tuple, store.table("codes").select("segment_id", "row_id", "id").collect()))
    monkeypatch.setattr("lodestar.sources.store.search.PRUNED", 2)
    assert sorted(map(tuple, store.table("codes").select("segment_id", "row_id", "id").collect())) == want and len(want) == 120
