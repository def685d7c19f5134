import random
import re

import xxhash
from pyspark.sql import functions as F

from lodestar.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = {i: brute_print(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= 2:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (prints[i], find(i)) for i in ids}


def test_fingerprint_of_edges():
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \t\n") == 0
    for t in ("a", "A b", "a b c", "x É y z w", "a b c d " * 90_000):
        assert simhash.fingerprint(t) == brute_print(t)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = rng.choice(base).split()
        if words and rng.random() < 0.6:
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words) if rng.random() < 0.97 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    kept = sorted(r.doc_id for r in simhash.representatives(docs).collect())
    assert kept == sorted({c for _, c in got.values()})


def test_hot_buckets_go_to_finer_tables(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(40)}
    prints |= {sum(1 << b for b in range(14) if i >> b & 1 and b not in (3, 9)) for i in range(4000)}
    prints |= {p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for p in list(prints)[:200]}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket=8).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want


def test_probes_into_hot_buckets_are_not_lost(spark):
    rng = random.Random(4)
    high = (1 << 32) - 1
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    for kept in (high, high << 32):  # the kept segment is all ones, so only a neighbour's probe can lead into the bucket
        other = 32 if kept == high else 0
        inside = rng.sample([kept | rng.getrandbits(32) << other for _ in range(60)], 40)
        prints = {*inside, *(p ^ 1 << rng.randrange(32) + 32 - other ^ 1 << rng.randrange(32) + other for p in inside)}
        want = {(min(a, b), max(a, b)) for x in prints for y in prints if x < y and (x ^ y).bit_count() <= 2 for a, b in [(signed(x), signed(y))]}
        got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), bucket=8).collect()}
        assert got == want and len(want) >= 40


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, None), (4, ""), (4, ""), (7, "a b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 7), (3, 3), (4, 3), (4, 3), (7, 7)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
