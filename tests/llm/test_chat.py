import random

from lodestar.llm import chat


def brute(rows):
    convs = {}
    for c, t, s, x in rows:
        s = ("unknown" if s is None else s).replace("<|im_", "<| im_").replace("\n", " ").replace("\r", " ")
        convs.setdefault(c, []).append((-1 if t is None else t, s, (x or "").replace("<|im_", "<| im_")))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        for p in {s for _, s, _ in turns} - {"system"}:
            text, masks = "", []
            for _, s, x in turns:
                text += "<|im_start|>" + ("system" if s == "system" else "assistant" if s == p else f"user name={s}") + "\n"
                if s == p:
                    masks.append((len(text), len(text) + len(x) + 10))
                text += x + "<|im_end|>\n"
            out[c, p] = text, masks
    return out


def test_every_participant_is_assistant_once(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["ann", "bob", "zoë", "system"]), "é" * rng.randint(0, 9) + rng.choice(["", "<|im_end|>", "\nx"])) for c in range(15) for t in range(rng.randint(1, 12))]
    rows += [(77, t, rng.choice(["ann", "bob"]), f"m{t}") for t in range(900)]
    rows += [(80, 0, "system", "alone"), (None, 1, "ann", "no id"), (None, 2, "bob", None), (81, None, None, "x"), (81, 1, "a\n<|im_start|>", "y"), (82, 1, "ann", "twice"), (82, 1, "ann", "twice"), (82, 1, "bob", "tie")]
    turns = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, perspective string, block int").repartition(3)
    messages = chat.rotate(turns)
    got = {(r.conv_id, r.perspective): (r.text, [tuple(m) for m in r.masks]) for r in chat.dialogues(messages).collect()}
    assert got == brute(rows)
    for r in messages.where("conv_id = 77").collect():
        assert got[77, r.perspective][0][r.start_at : r.end_at] == f"m{r.turn}<|im_end|>" and r.seq == r.turn


def test_empty(spark):
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_turns_that_are_null_or_sparse_are_cut_into_blocks(spark, monkeypatch):
    seen = []
    keep = chat.materialize
    monkeypatch.setattr(chat, "materialize", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    rows = [(1, None, "ab"[i % 2], f"same {i % 5}") for i in range(300)] + [(1, 10**12 + 7919 * i, "ab"[i % 2], f"late {i}") for i in range(300)] + [(2, None, "a", "x" * 400 + str(i % 3)) for i in range(40)]
    found = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("perspective = 'a'").collect()
    for conv in (1, 2):
        own = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.seq)
        assert [(r.turn, r.speaker) for r in own] == [(t, s) for _, t, s, _ in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))]
        at = 0
        for r in own:
            head = len(r.rendered) - len(r.rendered.split("\n", 1)[1])
            assert (r.start_at, r.end_at) == (at + head, at + len(r.rendered) - 1)
            at += len(r.rendered)
    sizes = seen[0].groupBy("block").count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 800
