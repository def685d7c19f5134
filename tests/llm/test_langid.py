import random

import numpy as np
import pytest

from lodestar.llm import langid

SOUNDS = {"aa": ["the", "ing", "and", "er", "th", "ou"], "bb": ["sch", "ein", "ung", "ä", "pf", "keit"], "cc": ["ción", "ñ", "ll", "rr", "os", "ez"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    return [(i, text(rng, lang, rng.choice([2, 30, 300])), lang) for i in range(240) for lang in [rng.choice(list(SOUNDS))]]


def test_held_out_accuracy_and_edges(spark, docs):
    rows = docs + [(900, None, "aa"), (901, "", "bb"), (902, "123 -- !", None), (None, "the and the", None), (5, docs[5][1], "aa"), (903, "schein ungkeit " * 30_000, None)]
    found = langid.identify(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")).collect()
    assert len(found) == len(rows)
    truth = {i: lang for i, _, lang in docs}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.93
    by = {r.doc_id: r for r in found}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[903].lang_pred == "bb" and all(0 <= r.score <= 1 for r in found)
    kept = {r.doc_id for r in langid.accepted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not {900, 901, 902} & kept and None in kept and len(kept) > 230


def test_pair_tables_give_the_plain_responses():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, langid.WINDOW), dtype=np.uint8)
    net = langid.train(x, rng.integers(0, 2, 40), ["a", "b"], steps=3)
    top, places = net.pooled(x)
    k = langid.WIDTHS.index(3)
    brute = [[max(sum(float(net.table[r[i + t]] @ net.filters[k][t][:, f]) for t in range(3)) for i in range(len(r) - 2)) for f in range(3)] for r in x[:4]]
    assert np.allclose(top[:4, k * langid.FILTERS : k * langid.FILTERS + 3], brute + net.bias[k][:3], atol=1e-4)
    assert np.allclose(net.compile()(x), langid._softmax(np.maximum(top, 0) @ net.out + net.out_bias), atol=1e-4)


def test_gradient_lowers_the_loss():
    rng = random.Random(1)
    langs = list(SOUNDS)
    y = np.array([i % 3 for i in range(90)])
    x = np.concatenate([langid.tiles(text(rng, langs[k], 60).encode())[:1] for k in y])
    p = langid.train(x, y, langs, steps=150).compile()(x)
    assert (p.argmax(axis=1) == y).mean() > 0.97


def test_nothing_to_learn_from_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).collect() == []
