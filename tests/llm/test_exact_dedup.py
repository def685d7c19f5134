import numpy as np

from lodestar.llm import exact_dedup


def test_hash_is_perfect_and_minimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 700):
        f1, f2, b = (rng.integers(0, 1 << 48, n) for _ in range(3))
        b %= -(-n // exact_dedup.BUCKET)
        d0, d1, slot = exact_dedup.place(f1, f2, b)
        assert sorted(slot) == list(range(n))
        assert (slot == (f1 % n + d0[b] * (f2 % n) + d1[b]) % n).all()


def test_winner_is_longest_then_smallest(spark):
    rows = [(5, "a b"), (2, "ab"), (9, "a  b"), (3, "a\t\nb"), (1, None), (4, ""), (6, " "), (None, "ab"), (2, "ab"), (8, "x y"), (7, "xy")]
    docs = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "doc_id long, text string, keep_id int, digest string")
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect())
    want = [(5, 3, 6, False), (2, 3, 6, False), (2, 3, 6, False), (9, 3, 6, False), (3, 3, 6, True), (None, 3, 6, False), (1, 6, 3, False), (4, 6, 3, False), (6, 6, 3, True), (8, 8, 1, True), (7, 7, 1, True)]
    assert got == sorted((str(a), *b) for a, *b in want)
    assert sorted(str(r.doc_id) for r in exact_dedup.distinct_texts(docs).collect()) == ["3", "6", "7", "8", "None"]
    assert exact_dedup.exact_duplicates(docs.limit(0)).collect() == []


def test_history_members_and_others(spark):
    past = spark.createDataFrame([(i, f"text {i % 1500}") for i in range(2000)], "doc_id long, text string")
    new = spark.createDataFrame([(9000 + i, f"te xt {i}") for i in range(1400, 1700)] + [(1, "text 1699"), (2, "text1"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(new, past).collect()}
    assert all(got[9000 + i] == (i, 1, False) for i in range(1400, 1500))
    assert all(got[9000 + i] == (9000 + i, 1, True) for i in range(1500, 1699))
    assert got[9000 + 1699] == (10699, 2, True) and got[1] == (10699, 2, False)
    assert got[2] == (1, 2, False) and got[3] == (3, 1, True)
