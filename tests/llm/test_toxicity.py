import random

import numpy as np
import pytest

from lodestar.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = {"abcab": 1, "abcd": 1, "bbcaabdca": 1, "cab": 1, "dcbaa": 1, "abcaabbcd": 1}
    lexicon = toxicity.Automaton(terms)
    for _ in range(4000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 11)))
        want = min(((d, t) for t in terms if (d := distance(w, t)) <= toxicity.edits(t)), default=None)
        assert lexicon.match(w) == (want and want[::-1]), w


def test_stems_are_spelled_exactly_and_open_ended():
    lexicon = toxicity.Automaton({"lowei*": 1, "stupid": 1})
    assert lexicon.match("loweichen") == ("lowei*", 0) == lexicon.match("lowei")
    assert lexicon.match("lowexchen") is None and lexicon.match("stuupid") == ("stupid", 1)


def test_quotation_lowers_the_score():
    model = toxicity.Model({"stupid": 0.95}, base=0.02)
    lexicon = toxicity.Automaton(model.terms)
    score = lambda t: toxicity.score(t, model, lexicon)
    plain, loose, quote, none = score("you are a stupid one"), score("you are a st1pid one"), score('they wrote "you stupid thing" there'), score("all fine here")
    assert plain > loose > 0.7 > quote > none == score(None) == score("") == pytest.approx(0.02)
    assert all(score(t) < 0.7 for t in ("„so stupid“ hieß es", "un « stupid » écrit", "'stupid' it read", "«stupid»"))
    assert all(score(t) > 0.7 for t in ("it's a stupid one, isn't it", '"a" stupid "b"', "stupid", '" stupid'))
    assert score("the word stupid is rude") < 0.7 and score("stupid " * 50_000) == 1.0


def make(rng, n):
    syllables = ["ka", "lo", "mi", "tu", "re", "san", "vor", "pel", "dux", "nim"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows, marks = [], []
    for i in range(n):
        w, toxic = [word() for _ in range(rng.randint(5, 60))], i % 5 == 0
        for _ in range(rng.randint(1, 3) * toxic):
            w.insert(rng.randint(0, len(w)), rng.choice(["blasted", "rotten", "grumb" + word()]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    return rows, marks


def test_held_out_accuracy_and_edges(spark):
    rows, marks = make(random.Random(3), 1200)
    extra = [(2000, None), (2001, ""), (None, "rotten"), (5, rows[5][1]), (2002, "kalo blastted miru"), (2003, "kalo mi " * 40_000)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows + extra], "doc_id long, text string, toxic int, terms string")
    labels = spark.createDataFrame(marks + [(3, 0), (None, 1), (9999, 1), (4, None)], "doc_id long, toxic int")
    found = toxicity.classify(docs, labels).collect()
    assert len(found) == len(rows + extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert len(held) > 300 and np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.99
    by = {r.doc_id: r.predicted for r in found}
    assert by[2000] == by[2001] == by[2003] == 0 and by[2002] == by[None] == 1


def test_copies_of_one_document_make_no_terms():
    toxic = [{"odd": "a b", "rude": f"x{i} y"} for i in range(200)]
    assert set(toxicity.choose({}, toxic, 800, 0.1)) == {"rude"}


def test_words_of_a_stem_may_be_misspelled():
    rng = random.Random(6)
    toxic = [toxicity._candidates(f"x{i} {rng.choice(['grumbling', 'grumbling', 'grumblers'])} y{i}") for i in range(200)]
    terms = toxicity.choose({}, toxic, 800, 0.1)
    assert any(t.endswith("*") for t in terms) and {"grumbling", "grumblers"} <= set(terms)
    lexicon = toxicity.Automaton(terms)
    assert lexicon.match("grunbling") == ("grumbling", 1) and lexicon.match("grumbling")[1] == lexicon.match("grumblish")[1] == 0
    assert lexicon.match("kalomiru") is None


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.classify(docs, labels).collect()] == [0]
    assert toxicity.classify(docs.limit(0), labels).collect() == []


def test_what_long_harmless_texts_have_by_chance_says_little():
    model = toxicity.Model({"grumb*": 0.9, "stupid": 0.99}, share=0.1, base=0.01)
    lexicon = toxicity.Automaton(model.terms)
    words = lambda n: [f"w{i}" for i in range(n)]
    score = lambda w: toxicity.score(" ".join(w), model, lexicon)
    assert score(words(400) + ["grumbling"]) < 0.5 < 0.7 < score(words(100) + ["grumbling", "a", "grumblish"])
    assert score(words(400) + ["stupid"]) > score(words(400) + ["grumbling"])
    line = ["so", "grumbling", "it", "is", *words(60)]
    assert score(line * 50) == pytest.approx(score(line), abs=0.1)  # a line that repeats is no more telling


def test_terms_are_not_cut_off(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("bcdfgklmnprst", k=9))
    insults, common = [word() for _ in range(800)], [word() for _ in range(200)]
    rows, marks = [], []
    for i in range(1000):
        w = rng.choices(common, k=20)
        if i % 2:
            w += [insults[j] for j in range(800) if j % 10 == i // 2 % 10] + [f"x{i}"]
            rng.shuffle(w)
        rows.append((i, " ".join(w)))
        marks.append((i, i % 2))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert set(insults) <= set(model.terms)
    lexicon = toxicity.Automaton(model.terms)
    assert all(toxicity.score(t, model, lexicon) >= 0.7 for (i, t) in rows if i % 2) and not any(toxicity.score(t, model, lexicon) >= 0.7 for (i, t) in rows if not i % 2)
