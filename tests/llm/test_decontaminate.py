import hashlib
import random
import re
from collections import Counter

from lodestar.llm import decontaminate


def brute(docs, items, n=8):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {(i, tuple(w[k : k + n])) for i, t in items if (w := words(t)) for k in range(max(len(w) - n, 0) + 1)}
    often = Counter(x for _, t in docs for x in words(t))
    out = []
    for d, t in docs:
        w, hit, got, near = words(t), set(), set(), set()
        for i, p in windows:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    got.add(i)
            if all(often[x] for x in p):
                rare = min(range(len(p)), key=lambda k: (often[p[k]], k))
                if any(x == p[rare] and set(p) <= set(w[max(0, k - 7) : k + 8]) for k, x in enumerate(w)):
                    near.add(i)
        listed = sorted(str(i) for i in got if i is not None)
        out.append((d, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), len(near - {None}), len(listed) >= 2))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "É", "élan", "x1", "naïve", "Straße", "q", "rare", "and"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 8, 12, 20])))) for i in range(12)] + [(50, None), (51, "..."), (3, "the of"), (None, "q q q")]
    docs = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            w[rng.randint(0, len(w)) : 0] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(200, None), (201, ""), (5, docs[5][1]), (None, items[0][1]), (202, "the of " * 60_000)]
    frame = spark.createDataFrame([(*r, "z", 1) for r in docs], "doc_id long, text string, phrase string, n_words int")
    got = decontaminate.contamination(frame, spark.createDataFrame(items, "item_id long, text string"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)
    left = [r.doc_id for r in decontaminate.clean(frame, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(map(str, left)) == sorted(str(r[0]) for r in brute(docs, items) if not r[-1] or r[0] is None)


def test_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.contamination(docs, none).collect()] == [(1, 3, 0, 0)]
    assert decontaminate.contamination(docs.limit(0), none).collect() == []


def test_proximity_takes_any_order_within_reach(spark):
    docs = spark.createDataFrame([(1, "c x a b"), (2, "a b x x x x x x x x c"), (3, "a b"), (4, "z a b c z"), (None, "b c a")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    found = {r.doc_id: (r.n_items, r.n_near) for r in decontaminate.contamination(docs, items).collect()}
    assert found == {1: (0, 1), 2: (0, 0), 3: (0, 0), 4: (1, 1), None: (0, 1)}


def test_terms_beyond_the_broadcast_bound_are_joined_by_shuffle(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefghij") for _ in range(10))) for i in range(6)]
    docs = [(i, " ".join([rng.choice("abcdefghij") for _ in range(30)] + items[i % 6][1].split()[: i % 11])) for i in range(40)] + [(None, ""), (9, None)]
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 2)
    frame, own = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, decontaminate.contamination(frame, own).collect()), key=key) == sorted(brute(docs, items), key=key)


def test_no_text_is_shuffled_to_the_terms(spark, monkeypatch):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    terms, seen = decontaminate.vocabulary(decontaminate.phrases(items).select("phrase")), []
    monkeypatch.setattr(decontaminate, "materialize", lambda df, name: seen.append(df) or df)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        decontaminate.build_index(docs, terms)
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanged = re.search(r"Exchange hashpartitioning\(term[^\n]*\n[^\n]*Project \[([^\n]*)\]", plan)[1]
    assert "n_words#" in exchanged and not any(re.fullmatch(r"(w|text)#\d+", x.strip()) for x in exchanged.split(","))


def test_only_the_text_that_is_contaminated_goes_of_a_shared_doc_id(spark):
    text = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, text, "a"), (1, "clean words", "b"), (2, "clean words", "c"), (None, text, "d")], "doc_id long, text string, kind string")
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert sorted(r.kind for r in decontaminate.clean(docs, items, least=1).collect()) == ["b", "c", "d"]
