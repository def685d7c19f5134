import random
from pathlib import Path

import pytest
import sentencepiece
from test_decontaminate import brute as contaminated
from test_simhash import brute_components

from lodestar.llm import langid, pieces


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Documents with copies, near copies, benchmark passages and rows without letters."""
    rng = random.Random(12)
    sounds = {"aa": ["the", "ing", "and", "er", "th", "ou", "re"], "bb": ["sch", "ein", "ung", "ä", "pf", "keit", "zu"]}
    prose = lambda lang, n: " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 4))) for _ in range(n))
    items = [(i, prose("aa", rng.randint(5, 40))) for i in range(10)]
    rows = [(i, prose(lang, rng.randint(20, 120)), lang) for i in range(260) for lang in [rng.choice(list(sounds))]]
    for i in range(260, 300):
        _, text, lang = rows[rng.randrange(200)]
        rows.append((i, text.replace(" ", rng.choice(["  ", "\n", " "])), lang))
    for i in range(300, 330):
        _, text, lang = rows[rng.randrange(200)]
        words = text.split()
        words[0] = "edit"
        rows.append((i, " ".join(words), lang))
    rows += [(330 + i, rows[i][1] + " " + " ".join(t for _, t in items[i : i + 2]), rows[i][2]) for i in range(8)]
    rows += [(400, None, None), (401, "", "aa"), (402, "12 -- 34", None), (None, prose("bb", 30), "bb")]
    return [(*r, "src", len(r[1] or "")) for r in rows], items, str(tmp_path_factory.mktemp("sf"))


def test_stages_match_brute_force(spark, corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, items, at = corpus
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    # the network's decisions come from the operator; everything after them from plain Python
    said = {r.doc_id: r for r in langid.identify(docs).collect()}
    left = [r for r in rows if said[r[0]].lang_pred != "und" and said[r[0]].score >= 0.4]
    assert {400, 401, 402}.isdisjoint({r[0] for r in left}) and len(left) > 330
    best = {}
    for r in left:
        key = "".join((r[1] or "").split())
        if r[0] is not None and (key not in best or (-len(r[1]), r[0]) < best[key]):
            best[key] = (-len(r[1]), r[0])
    keep = {i for _, i in best.values()}
    left = [r for r in left if r[0] is None or r[0] in keep]
    named = brute_components([(r[0], r[1]) for r in left if r[0] is not None])
    left = [r for r in left if r[0] is None or named[r[0]][1] == r[0]]
    bad = {r[0] for r in contaminated([(r[0], r[1]) for r in left], items) if r[-1]}
    left = [r for r in left if r[0] not in bad or r[0] is None]
    library = sentencepiece.SentencePieceProcessor(model_proto=Path(pieces.MODEL).read_bytes())
    want = sorted((str(r[0]), library.encode(r[1])) for r in left)
    found = pipeline.run(spark, at).collect()
    assert sorted((str(r.doc_id), r.ids) for r in found) == want and all(r.n_tokens == len(r.ids) for r in found)
    assert 200 < len(found) < 320 and {330, 331} & bad


def test_stages_keep_the_columns(spark, corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, _, at = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns


def test_a_document_with_one_benchmark_item_goes(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    prose = lambda at, n: " ".join(f"w{at + i}" for i in range(n))
    spark.createDataFrame([(0, prose(0, 20)), (1, prose(100, 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"{prose(500, 9)} {prose(0, 20)} {prose(600, 9)}"), (2, prose(700, 30)), (3, f"{prose(900, 5)} {prose(0, 7)}"), (4, prose(100, 12)), (5, None)]
    left = dict(pipeline.STAGES)["decontamination"](spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 5]
