import random
import zlib
from collections import Counter

from lodestar.llm import sharding


def check(rows, found, shards, slack):
    assert Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows) == Counter((r.doc_id, r.size, r.text_crc32) for r in found)
    load, slots, home = Counter(), {}, {}
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert home.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(load.values()) / shards
    assert all(abs(load[s] - share) <= slack for s in range(shards)), load


def test_near_equal_bytes_and_whole_groups(spark):
    rng = random.Random(8)
    rows = [(i, "w é" * rng.randint(1, 60) + str(i), rng.choice("ab"), rng.choice(["en", None])) for i in range(3000)]
    rows += [(4000 + i, "copy " * 30, "hot", "en") for i in range(200)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, lang string, shard int, digest string")
    check(rows, sharding.assign(docs, 8).collect(), 8, 250)
    check(rows, sharding.assign(docs, 3).collect(), 3, 250)
    assert sharding.shards_for(docs, 10**9) == 1 and sharding.shards_for(docs, 50_000) > 5


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None), (None, "a"), (2, ""), (3, "a"), (3, "a"), (4, "b" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sharding.assign(docs, 4).collect(), 4, 60_000)
    check(rows[:1], sharding.assign(docs.where("doc_id = 1"), 4).collect(), 4, 2)
    assert sharding.assign(docs.limit(0)).collect() == []


def test_one_text_in_all_rows(spark):
    rows = [(i, "same") for i in range(50)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert len({r.shard for r in found}) == 1 and sorted(r.slot for r in found) == list(range(50))


def loads(found):
    out = Counter()
    for r in found:
        out[r.shard] += r.size
    return sorted(out.values())


def test_heavy_texts_leave_the_others_even(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = loads(sharding.assign(frame([(i, f"{i:06d}" + "y" * (i % 60)) for i in range(3000)] + [(5000, "x" * 50_000)]), 4).collect())
    assert one[-1] == 50_001 and max(one[:3]) - min(one[:3]) <= 200, one
    even = loads(sharding.assign(frame([(i, f"{i:06d}" + "z" * (20_000 + i)) for i in range(40)]), 8).collect())
    assert max(even) - min(even) < 400, even
    copies = [(i, "copy " * 10) for i in range(900)] + [(1000 + i, f"{i:05d} " * 9) for i in range(2000)]
    hot = loads(sharding.assign(frame(copies), 8).collect())
    assert hot[-1] == 900 * 51 and max(hot[:7]) - min(hot[:7]) <= 200, hot


def test_leaves_reach_the_target_and_cuts_follow_names(spark):
    rows = [(i, f"text {i:04d}", f"https://site/{'abcd'[i % 4]}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sharding.assign(docs, target_bytes=1100).collect()
    assert len({r.shard for r in found}) == 4 and max(loads(found)) <= 1100
    groups = {r.x[1] for r in sharding.groups(docs).collect()}
    assert sorted(groups) == [ord(c) * 2.0**40 for c in "abcd"]


def test_rows_without_doc_id_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    rows = [(None, "same")] * 60 + [(None, f"t{i}") for i in range(40)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    check(rows, found.collect(), 2, 300)
