import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from lodestar.llm import pieces


@pytest.fixture(scope="module")
def model():
    return Path(pieces.MODEL).read_bytes()


def samples():
    rng = random.Random(1)
    alphabet = "abcdeehinorst  ▁\n\té中日😀ﬁ<s>01．Ａ́\x00"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))) for _ in range(1500)]
    return out + [" " * k for k in range(40)] + ["a" * k for k in range(0, 120, 7)] + [" " * k + "x" + " " * (30 - k) for k in range(30)] + ["the" * 100, "中" * 300, "----" * 50, "Hello  world"]


def test_bpe_model_gives_the_library_ids(model):
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    texts = samples()
    ids = own.encode(texts)
    assert ids == library.encode(texts)
    assert [own.decode(x) for x in ids] == [library.decode(x) for x in ids]
    assert all(own.decode(x) == t for x, t in zip(ids, texts) if "▁" not in t)
    assert own.encode([None, ""]) == [[], []] and own.decode([]) == ""


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_model_gives_the_library_ids(fallback):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.pieces.add(piece="<unk>", score=0, type=2)
    if fallback:
        for b in range(256):
            m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    rng = random.Random(3)
    own = sorted({"▁"} | {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"▁" + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(30)})
    for x in own:
        m.pieces.add(piece=x, score=-rng.uniform(1, 12))
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, fallback
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    library, mine = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()), pieces.Pieces(m.SerializeToString())
    texts = ["".join(rng.choice("abcde abcdexé") for _ in range(rng.randint(0, 90))) for _ in range(800)] + ["abcde" * 60]
    score = lambda ids: sum(mine.unknown_score if i == 0 or i in mine.bytes.values() else mine.score[i] for i in ids)
    for a, b in zip(mine.encode(texts), library.encode(texts)):
        assert a == b or sorted(a) == sorted(b) and abs(score(a) - score(b)) < 1e-3  # the same sum in another order


def test_parts_with_one_hash_are_told_apart_by_their_letters(model, monkeypatch):
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    monkeypatch.setattr(pieces.Pieces, "_hashes", staticmethod(lambda codes, start, span: span % 3))
    assert own.encode(samples()) == library.encode(samples())


def test_blocks_of_any_size_and_forgotten_words_change_nothing(model, monkeypatch):
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    monkeypatch.setattr(pieces, "CACHE_WORDS", 50)
    for block in (1, 7, 64):
        monkeypatch.setattr(pieces, "BLOCK", block)
        assert own.encode(samples()) == library.encode(samples())


def test_pools_join_small_batches_and_cut_large_ones(monkeypatch):
    monkeypatch.setattr(pieces, "POOL_BYTES", 1000)
    texts = ["x" * n for n in [1] * 30 + [0] * 5 + [200] * 40 + [9000, 3]]
    batches = pa.record_batch([texts], ["text"])
    got = [b.column("text").to_pylist() for b in pieces._pooled([batches.slice(0, 20), batches.slice(20), batches.slice(0, 0)])]
    assert sum(got, []) == texts and len(got) > 5 and max(len("".join(t)) for t in got if "x" * 9000 not in t) < 4000


def test_the_test_tables_get_the_library_ids(model):
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    texts = pq.read_table(path, columns=["text"])["text"].to_pylist()
    assert pieces.Pieces(model).encode(texts) == sentencepiece.SentencePieceProcessor(model_proto=model).encode([t or "" for t in texts])


def test_queries_keep_every_row(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (None, "é x"), (1, "Hello  world\n"), (4, "long words " * 20_000), (5, "x" * 30_000), (6, "a▁b")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, ids int, round_trip string")
    ids = pieces.encode(docs)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.ids) for r in ids.collect()), key=key) == sorted(((i, library.encode(t or "")) for i, t in rows), key=key)
    assert sorted((str(r.doc_id), r.text) for r in pieces.decode(ids).collect()) == sorted((str(i), (t or "").replace("▁", " ")) for i, t in rows)
    trips = pieces.round_trips(docs).collect()
    assert len(trips) == len(rows) and all(r.round_trip == (r.doc_id != 6) for r in trips)
    assert pieces.round_trips(docs.limit(0)).collect() == []


def test_other_models_are_refused(model):
    with pytest.raises(ValueError):
        pieces.Pieces(model + b"\x1a\x04\x12\x02ab")
