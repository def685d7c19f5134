import hashlib
import random
import re

import numpy as np

from lodestar.llm import substring


def brute(docs, n=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    low = {}
    for d, w in words:
        for i in range(len(w) - n + 1) if d is not None else ():
            k = tuple(w[i : i + n])
            low[k] = min(low.get(k, d), d)
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - n + 1) if d is not None and low[tuple(w[i : i + n])] < d for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_cover_shifts_any_two_positions_together():
    for a in range(substring.PERIOD):
        for b in range(substring.PERIOD):
            assert any((a + s) % substring.PERIOD in substring.COVER and (b + s) % substring.PERIOD in substring.COVER for s in range(substring.PERIOD))


def test_window_hash_depends_on_order_and_content_only():
    h = substring.word_hashes([b"a", b"bb", b"a", b"bb", b"", b"\xc3\xa9"][:4], 0)
    w = substring.window_hashes(h, 2, 0)
    assert w[0] == w[2] != w[1]
    assert len(np.unique(substring.word_hashes([str(i).encode() for i in range(50_000)], 1))) == 50_000


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "BATCH_WORDS", 700)
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "c", "é", "dd", " x"]) + str(rng.randint(0, 30))
    shared = [[word() for _ in range(rng.randint(10, 60))] for _ in range(8)]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randint(0, 50))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            w[rng.randint(0, len(w)) : 0] = p[a : a + rng.randint(8, 60)]
        docs.append((1000 - i, rng.choice([" ", "\t ", "\n"]).join(w)))
    docs += [(2000, None), (2001, " "), (5, docs[3][1]), (5, docs[3][1]), (None, docs[3][1]), (None, None), (7, "x y " * 40_000), (8, "y x " * 30)]
    frame = spark.createDataFrame([(*r, 1, b"z") for r in docs], "doc_id long, text string, row_key int, pos binary").repartition(3)
    found = substring.remove_repeats(frame).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=key) == sorted(brute(docs), key=key)
    for r in found:
        assert sum(b - a for a, b in r.spans) == r.n_removed == r.n_words - len(r.kept_text.split())


def test_empty(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
