import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import quality
from lodestar.llm.common import fold


def good(rng):
    return "\n".join(" ".join(rng.choice(["stone", "river", "green", "walks", "the", "of"]) + rng.choice(["", "", "s"]) for _ in range(rng.randint(4, 30))) + "." for _ in range(rng.randint(1, 6)))


def bad(rng):
    return rng.choice([lambda: good(rng).upper().replace(" ", "!! "), lambda: " | ".join(good(rng).split()), lambda: (good(rng).split()[0] + " ") * 40])()


def test_features_of_edges():
    assert len(quality.NAMES) == len(quality.features(None)) == len(quality.features("a, b\n é" * 50_000))
    assert np.isfinite([quality.features(t) for t in (None, "", " ", "\n", "x" * 100_000)]).all()


def test_pairs_recover_a_known_direction():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5))
    utility = x @ [2, -1, 0, 0, 1]
    likely = 1 / (1 + np.exp(-4 * utility)) > rng.random(600)
    rank = quality.fit(x[likely], x[~likely], (~likely).mean(), pairs=20_000)
    w = rank.weights[:5]
    assert w[0] > 2 * abs(w[2]) and w[1] < 0 and w[4] > 0
    d = rank.raw(x[likely])[:, None] > rank.raw(x[~likely])[None]
    assert d.mean() > 0.9
    assert abs((rank.score(x) >= quality.GOOD).mean() - likely.mean()) < 0.02


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(7)
    rows = [(i, bad(rng) if i % 6 == 0 else good(rng)) for i in range(600)]
    marks = [(i, int(i % 6 != 0)) for i in range(600)] + [(3, 1), (None, 1), (9999, 0), (12, None)]
    extra = [(700, None), (701, ""), (None, "the river"), (5, rows[5][1]), (702, "THE!! RIVER!! " * 40_000)]
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows + extra], "doc_id long, text string, quality int, score double")
    found = quality.classify(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    assert len(found) == len(rows + extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id % 6 != 0) for r in held]) > 0.97


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in quality.classify(docs, labels).collect()] == [(0.5, 0)] * 2
    assert quality.classify(docs.limit(0), labels.limit(0)).collect() == []


def test_all_pairs_count():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4))
    likely = x @ [3, -1, 0, 2] + rng.normal(size=500) > -1
    rank = quality.fit(x[likely], x[~likely], (~likely).mean(), pairs=64)
    z = np.clip((x - rank.mean) / rank.scale, -6, 6)
    z = np.concatenate([z, z * z / 6], axis=1)
    d = (z[likely][:, None] - z[~likely][None]).reshape(-1, 8)
    p = 1 / (1 + np.exp(d @ rank.weights))
    grad = 2e-3 * rank.weights - (d * p[:, None]).mean(axis=0)
    assert np.abs(np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 2e-3 * np.eye(8), grad)).max() < 2e-6
    s, n = np.sort(rank.raw(x)), (~likely).sum()
    assert rank.cut == (s[n - 1] + s[n]) / 2


def test_scores_by_place():
    x = np.array([[0.0], [-0.5], [3e-310], [7.0], [7.0], [-1e9], [7.0 + 1e-15], [-0.5]])
    rank = quality.Ranking(np.zeros(1), np.ones(1), np.array([1.0, 0.0]))
    sums = lambda kernel: quality._add(*kernel(x, np.ones(8, bool)))
    want = np.sort(rank.raw(x))
    assert [quality.ordered(sums, rank, [k, min(k + 1, 7)]) for k in range(8)] == [[want[k], want[min(k + 1, 7)]] for k in range(8)]


def test_every_label_is_learned_from(spark):
    rng = random.Random(8)
    ids = [(r.id, r.out) for r in spark.range(8000).withColumn("out", fold(F.col("id"), 4) == 2).orderBy(F.xxhash64("id"), "id").collect()]
    kinds = {"good": lambda: good(rng), "again": lambda: (good(rng).split()[0] + " ") * rng.randint(20, 60), "loud": lambda: good(rng).upper().replace(" ", "!! ")}
    # the loud ones to learn from are the last tenth in the order of the hash
    learned = [i for i, out in ids if not out]
    late = set(learned[-len(learned) // 10 :])
    kind = {i: rng.choice(["good", "loud"]) if out else "loud" if i in late else rng.choice(["good", "again", "again", "again", "again", "again"]) for i, out in ids}
    assert sum(k == "again" and i not in late for i, k in kind.items()) > 4000
    texts = {i: kinds[k]() for i, k in kind.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k == "good")) for i, k in kind.items()], "doc_id long, quality int")
    held = [r for r in quality.classify(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == (kind[r.doc_id] == "good") for r in held]) > 0.97
    rank = quality.learn(quality.describe(docs), labels)
    x = {want: np.stack([quality.features(texts[i]) for i in learned if (kind[i] == "good") == want]) for want in (True, False)}
    whole = quality.fit(x[True], x[False], len(x[False]) / len(learned))
    assert np.allclose(rank.weights, whole.weights, atol=2e-6) and abs(rank.cut - whole.cut) < 1e-4
