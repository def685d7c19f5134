import random
import re
import zlib

from pyspark.sql import functions as F

from lodestar.llm import common, exact_dedup, simhash


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(-50, 400), rng.randint(-50, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in touched}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_without_gives_the_same_either_way(spark, monkeypatch):
    rows = [(i % 7 if i % 5 else None, f"t{i % 2}" if i % 3 else None, i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    bad = [(1, "t0"), (1, "t0"), (4, None), (4, "t1"), (99, "t0"), (None, "t0")]
    gone = spark.createDataFrame(bad, "doc_id long, text string").select("doc_id", common.text_key().alias("text_key"))
    want = [i for d, t, i in rows if d is None or (d, t) not in bad]
    assert sorted(r.x for r in common.without(docs, gone).collect()) == want and len(want) < 40
    monkeypatch.setattr(common, "BROADCAST_IDS", 1)
    assert sorted(r.x for r in common.without(docs, gone).collect()) == want


def test_filters_tell_texts_of_one_doc_id_apart(spark):
    rows = [(1, "some words"), (2, "some  words"), (2, "quite another text"), (3, "some words"), (None, "some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (exact_dedup.distinct_texts, simhash.representatives):
        left = sorted((str(r.doc_id), r.text) for r in keep(docs).collect())
        first = (2, "some  words") if keep is exact_dedup.distinct_texts else (1, "some words")
        assert left == sorted((str(i), t) for i, t in [first, (2, "quite another text"), (None, "some words")])


def test_folds_and_lower_case(spark):
    ids = [0, 7, -3, 123456789, None]
    got = [r.v for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(common.fold(F.col("doc_id"), 4).alias("v")).collect()]
    assert got == [zlib.crc32(b"" if i is None else str(i).encode()) % 4 for i in ids]
    texts = ["ABC xyz", "ÄÖ É A", "İ Σ", "", None]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(common.ascii_lower(F.col("t")).alias("v")).collect()]
    assert got == [t and re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]


def test_tables_outlive_their_plan_and_can_be_cleared(spark):
    kept = common.materialize(spark.range(5).toDF("doc_id"), "kept")
    assert kept.count() == 5 and "/lodestar/" in kept.inputFiles()[0]
    common.discard(spark, kept)
    other = common.materialize(spark.range(2).toDF("doc_id"), "other")
    assert other.count() == 2
