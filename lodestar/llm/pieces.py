"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy."""

from __future__ import annotations

import hashlib
import struct
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, release

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words are remembered up to this many, then all are forgotten; longer words than this take the pass for one word.
CACHE_WORDS, LONG = 100_000, 48
#: Texts are taken up together until they have this many bytes: more words of one length advance together. Letters are
#: hashed this many at once, so that a very long text needs little more than its letters.
POOL_BYTES, BLOCK = 2 << 20, 1 << 18
#: Bits of the table that remembers pairs of pieces, and of the filter before the search among the keys.
PAIR_BITS, FILTER_BITS = 20, 20
#: Types of pieces and models in a model file: fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; numbers are ints, the rest bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Pieces:
    """The pieces of a SentencePiece model of type unigram or BPE, with an encoder and a decoder.

    Both types run the same pass over all words of one length at once: for each end position, substrings ending
    there are looked up by hash among the sorted keys of their length, and the best total over the starts and a
    back pointer are kept. In a unigram model, a total is the sum of the pieces' scores. A BPE model has no such
    sum; there a step from one piece to the next scores 0 if merging their joined text gives back just these two,
    and nothing otherwise. A segmentation is what the merges make of a word exactly if all its neighbours are such
    pairs, so the one path left is the BPE result. In a unigram model, of segmentations with one and the same sum the
    last bit of its rounding decides, as in other encoders, though not always alike.
    """

    def __init__(self, model: bytes):
        self.names, self.scores, self.types = [], [], []
        kind, self.fallback, self.prefix = UNIGRAM, False, True
        squeeze, charsmap, suffix = True, b"", False
        for number, value in _fields(model):
            if number == 1:
                got = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(value))
                self.names.append(got[1].decode())
                self.scores.append(struct.unpack("<f", got[2])[0])
                self.types.append(got[3])
            elif number == 2:
                spec = dict(_fields(value))
                kind, self.fallback, suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if kind not in (UNIGRAM, BPE) or charsmap or squeeze or suffix or USER in self.types:
            raise ValueError("only unigram and BPE models with identity normalisation and no pieces of the user's own are supported")
        self.bpe = kind == BPE
        self.ids = {n: i for i, (n, t) in enumerate(zip(self.names, self.types)) if t == NORMAL}
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(n[3:5], 16): i for i, (n, t) in enumerate(zip(self.names, self.types)) if t == BYTE}
        self.byte_id = np.full(256, self.unknown)
        self.byte_id[list(self.bytes)] = list(self.bytes.values())
        # what each piece decodes to: its bytes stand in ``surface`` from ``edge[id]`` on to ``edge[id + 1]``
        plain = [bytes([int(n[3:5], 16)]) if t == BYTE else (" ⁇ " if t == UNKNOWN else "" if t == CONTROL else n.replace(SPACE, " ")).encode() for n, t in zip(self.names, self.types)]
        self.surface, self.edge = np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in plain])])
        self.spaced = np.array([n[:1] == SPACE for n in self.names])
        self.score = np.array(self.scores, np.float32)  # totals are summed in single precision, as ties depend on it
        #: An unknown character scores this much less than the worst piece: a fixed value of the unigram model.
        self.unknown_score = np.float32(min((self.scores[i] for i in self.ids.values()), default=0.0)) - np.float32(10)
        self.longest = max(map(len, self.ids), default=1)
        self.keys = {}
        for n in range(1, self.longest + 1):
            own = [i for p, i in self.ids.items() if len(p) == n]
            if own:
                codes = np.array([[ord(c) for c in self.names[i]] for i in own], np.uint64)
                h = np.zeros(len(own), np.uint64)
                for k in range(n):
                    h = h * _BASE + self._code(codes[:, k])
                order = np.argsort(h)
                may = np.zeros(1 << FILTER_BITS, bool)
                may[h >> np.uint64(64 - FILTER_BITS)] = True
                self.keys[n] = h[order], np.array(own)[order], codes[order], may
        # characters of the pieces by number, and which may stand side by side in a piece
        letters = sorted({c for n in self.ids for c in n})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1,) * 2, bool)
        beside = np.array(sorted({(ord(a), ord(b)) for n in self.ids for a, b in zip(n, n[1:])}), np.int64).reshape(-1, 2)
        self.joined[self.letter[beside[:, 0]], self.letter[beside[:, 1]]] = True
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, tuple] = {}
        self.pair_keys, self.pair_ok = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)
        self._forget()

    def _forget(self) -> None:
        """No words are remembered: ``words`` has their numbers, the ids of word k stand in ``values`` from
        ``starts[k]`` on to ``starts[k + 1]``."""
        self.words: dict[str, int] = {}
        self.values, self.starts = array("i"), array("q", [0])

    def _remember(self, words: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.starts.frombytes((len(self.values) + np.cumsum(counts)).astype(np.int64).tobytes())
        self.values.frombytes(np.asarray(ids, np.int32).tobytes())

    @staticmethod
    def _code(c: np.ndarray) -> np.ndarray:
        x = (c + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def _history(self, piece: int) -> tuple[list[float], list[str], list[str], bool]:
        """How merging makes a piece: the score of each merge, the first and the last symbol before each and at the end,
        and whether it comes out whole."""
        if piece not in self.histories:
            parts, scores = list(self.names[piece]), []
            firsts, lasts = [parts[0]], [parts[-1]]
            while True:
                best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
                if best is None:
                    break
                k = -best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                scores.append(best[0])
                firsts.append(parts[0])
                lasts.append(parts[-1])
            self.histories[piece] = scores, firsts, lasts, len(parts) == 1
        return self.histories[piece]

    def _follows(self, pair: int) -> bool:
        """Whether merging the text of two pieces gives back these two; of the start of a word and a piece, the piece.

        The merges inside both run as they do alone, the better one first, unless one across the border, of the
        symbols that then stand at it, comes before: of equal scores the one further left does.
        """
        ok = self.pairs.get(pair)
        if ok is None:
            a, b = divmod(pair, len(self.names))
            right, firsts, _, ok = self._history(b)
            if a < len(self.names) and ok:
                left, _, lasts, ok = self._history(a)
                i = j = 0
                while ok:
                    across = self.ids.get(lasts[i] + firsts[j])
                    x = left[i] if i < len(left) else -np.inf
                    y = right[j] if j < len(right) else -np.inf
                    if across is not None and self.scores[across] > x and self.scores[across] >= y:
                        ok = False
                    elif i < len(left) and x >= y:
                        i += 1
                    elif j < len(right):
                        j += 1
                    else:
                        break
            self.pairs[pair] = ok
        return ok

    def _steps(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow: -1 stands for an unknown character, which merges with nothing, and the
        number of pieces for the start of the word."""
        ok = piece < 0
        at = np.flatnonzero(~ok)
        before = last[at]
        pair = np.where(before < 0, len(self.names), before) * len(self.names) + piece[at]
        slot = (pair.astype(np.uint64) * _BASE >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        new = np.flatnonzero(self.pair_keys[slot] != pair)
        found = self.pair_ok[slot]
        if len(new):
            different, back = np.unique(pair[new], return_inverse=True)
            found[new] = np.fromiter(map(self._follows, different.tolist()), bool, len(different))[back]
            # a slot keeps one pair: for those that share it both the pair and its answer come from the last
            self.pair_keys[slot[new]], self.pair_ok[slot[new]] = pair[new], found[new]
        ok[at] = found
        return ok

    def _arcs(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(end, row, width, piece) of every place in words of one length, ``codes`` (letters, words), where a piece
        stands, by end: substrings of a width are hashed at once and looked up among the sorted keys of that width."""
        size, n = codes.shape
        mapped, sums = self._code(codes), np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            sums[j + 1] = sums[j] * _BASE + mapped[j]
        power, found = np.multiply.accumulate(np.full(min(size, self.longest), _BASE)), []
        for m in range(1, len(power) + 1):
            if m not in self.keys:
                continue
            h, own, spelled, may = self.keys[m]
            want = (sums[m:] - sums[:-m] * power[m - 1]).ravel()
            hit = np.flatnonzero(may[want >> np.uint64(64 - FILTER_BITS)])
            at = np.minimum(np.searchsorted(h, want[hit]), len(h) - 1)
            same = h[at] == want[hit]
            hit, at = hit[same], at[same]
            start, row = np.divmod(hit, n)
            same = (spelled[at] == codes[start[:, None] + np.arange(m), row[:, None]]).all(axis=1)
            found.append((start[same] + m, row[same], np.full(int(same.sum()), m), own[at[same]]))
        end, row, width, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        order = np.argsort(end, kind="stable")
        return end[order], row[order], width[order], piece[order]

    def _advance(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, all ids) of words of one length."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).T.astype(np.uint64)
        end, row, wide, piece = self._arcs(codes)
        known = np.zeros((size + 1, n), bool)
        known[end[wide == 1], row[wide == 1]] = True
        edge = np.searchsorted(end, np.arange(size + 2))
        total = np.full((size + 1, n), -np.inf, np.float32)
        total[0] = 0
        last = np.full((size + 1, n), len(self.names))
        width = np.zeros((size + 1, n), np.int64)
        rows = np.arange(n)
        for j in range(1, size + 1):
            own, most = slice(edge[j], edge[j + 1]), min(j, self.longest)
            r, m, p = row[own], wide[own], piece[own]
            open_ = total[j - m, r] > -np.inf
            r, m, p = r[open_], m[open_], p[open_]
            if self.bpe:
                fits = self._steps(last[j - m, r], p)
                r, m, p = r[fits], m[fits], p[fits]
            # a row for each width, the widest first: of equal sums it counts
            scores, found = np.full((most, n), -np.inf, np.float32), np.full((most, n), -1)
            found[most - m, r] = p
            scores[most - m, r] = total[j - m, r] + (0 if self.bpe else self.score[p])
            lost = np.flatnonzero(~known[j] & (total[j - 1] > -np.inf))
            scores[most - 1, lost] = total[j - 1, lost] + (0 if self.bpe else self.unknown_score)
            best = scores.argmax(axis=0)
            total[j], last[j], width[j] = scores[best, rows], found[best, rows], most - best
        return self._collect(codes, last, width)

    def _collect(self, codes: np.ndarray, last: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the back pointers, of all words at once: an unknown character as its bytes, or as the unknown id."""
        size, n = codes.shape
        end, row, piece, back, at = np.full(n, size), [], [], [], []
        while (going := np.flatnonzero(end > 0)).size:
            here = end[going]
            row.append(going)
            piece.append(last[here, going])
            at.append(here - 1)
            back.append(np.full(len(going), -len(back)))
            end[going] -= width[here, going]
        row, piece, back, at = (np.concatenate(x) for x in (row, piece, back, at))
        order = np.lexsort((back, row))
        row, piece, at = row[order], piece[order], at[order]
        lost = np.flatnonzero(piece < 0)
        if not self.fallback or not len(lost):
            piece[lost] = self.unknown
            return np.bincount(row, minlength=n), piece
        raw = codes[at[lost], row[lost]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        spelled = codes[at[lost], row[lost]]
        long = np.ones(len(piece), np.int64)
        long[lost] = 1 + (spelled >= 0x80) + (spelled >= 0x800).astype(np.int64) + (spelled >= 0x10000)
        out = np.repeat(piece, long)
        out[out < 0] = self.byte_id[np.frombuffer(raw, np.uint8)]
        return np.bincount(row, weights=long, minlength=n).astype(np.int64), out

    def _one(self, word: str) -> list[int]:
        """The same pass for a single long word."""
        size, start = len(word), len(self.names)
        total, last, width = [np.float32(0)] + [-np.inf] * size, [start] + [-1] * size, [0] * (size + 1)
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                p = self.ids.get(word[i:j], -1)
                if total[i] == -np.inf or p < 0 and i < j - 1:
                    continue
                if self.bpe and p >= 0 and not self._follows((start if last[i] < 0 else last[i]) * len(self.names) + p):
                    continue
                s = total[i] + (0 if self.bpe else self.unknown_score if p < 0 else self.score[p])
                if s > total[j]:
                    total[j], last[j], width[j] = s, p, j - i
        out = []
        while size:
            out.append(last[size])
            size -= width[size]
        return out[::-1]

    def _numbers(self, word: str, pieces: list[int]) -> list[int]:
        """Pieces as ids: an unknown character as its bytes, or as the unknown id."""
        out, at = [], 0
        for p in pieces:
            if p >= 0:
                out.append(p)
                at += len(self.names[p])
            else:
                out += [self.bytes[b] for b in word[at].encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]
                at += 1
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text. A null or empty text has none."""
        edge, values = self.encode_flat(texts)
        return [values[a:b].tolist() for a, b in zip(edge, edge[1:])]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(edges, values): the ids of text k are values[edges[k]:edges[k + 1]].

        Texts are cut wherever two characters meet that no piece has side by side, so also before each word: no piece
        goes across. Each different part is encoded once and remembered.
        """
        marked = [(SPACE if self.prefix else "") + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(marked)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        cut = np.ones(len(whole) + 1, bool)
        for a in range(0, len(whole), BLOCK):
            letters = self.letter[codes[a : a + BLOCK + 1]]
            cut[a + 1 : a + len(letters)] = ~self.joined[letters[:-1], letters[1:]]
        ends = np.cumsum([len(t) for t in marked])
        cut[ends] = True
        at = np.flatnonzero(cut)
        start, span = at[:-1], np.diff(at)
        blocks = [*np.unique(np.searchsorted(start, np.arange(0, len(whole), BLOCK))).tolist(), len(start)]
        parts, kinds = [], []
        for a, z in zip(blocks, blocks[1:]):
            own = slice(a, z)
            first, kind = self._different(codes[at[a] : at[z]], start[own] - at[a], span[own])
            kinds.append(kind + len(parts))
            parts += [whole[x:y] for x, y in zip(start[own][first].tolist(), (start + span)[own][first].tolist())]
        if len(self.words) > CACHE_WORDS:
            self._forget()
        if len(self.pairs) > CACHE_WORDS:
            self.pairs.clear()
        new: dict[int, list[str]] = {}
        for w in dict.fromkeys(parts):
            if w not in self.words:
                new.setdefault(len(w), []).append(w)
        for n, same in new.items():
            if n > LONG:
                for w in same:
                    ids = self._numbers(w, self._one(w))
                    self._remember([w], np.array([len(ids)]), ids)
                continue
            for a in range(0, len(same), 4096):
                self._remember(same[a : a + 4096], *self._advance(same[a : a + 4096]))
        word = np.fromiter(map(self.words.__getitem__, parts), np.int64, len(parts))[np.concatenate([np.zeros(0, np.int64), *kinds])]
        starts, known = np.array(self.starts), np.array(self.values, np.int32)
        size = starts[word + 1] - starts[word]
        total = np.concatenate([[0], np.cumsum(size)])
        values = known[np.repeat(starts[word] - total[:-1], size) + np.arange(total[-1])]
        edge = np.concatenate([[0], total[np.searchsorted(at, ends)]]) if len(ends) else np.zeros(1, np.int64)
        if not self.fallback and len(values):  # a run of unknown characters is one unknown piece
            again = np.zeros(len(values), bool)
            again[1:] = (values[1:] == self.unknown) & (values[:-1] == self.unknown)
            again[edge[:-1][edge[:-1] < len(values)]] = False
            edge = edge - np.concatenate([[0], np.cumsum(again)])[edge]
            values = values[~again]
        return edge, values

    @staticmethod
    def _hashes(codes: np.ndarray, start: np.ndarray, span: np.ndarray) -> np.ndarray:
        """A hash of each part: sums of powers up to its end less those up to its start, taken back to power 0."""
        power = np.full(len(codes) + 1, _BASE)
        power[0] = 1
        power = np.multiply.accumulate(power)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(Pieces._code(codes.astype(np.uint64)) * power[:-1], out=sums[1:])
        power[1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
        back = np.multiply.accumulate(power)
        return (sums[start + span] - sums[start]) * back[start]

    def _different(self, codes: np.ndarray, start: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the first place of each different part, which of these each part is): by hash, then held against the letters."""
        _, first, kind = np.unique(self._hashes(codes, start, span), return_index=True, return_inverse=True)
        like = first[kind]
        if (span[like] == span).all() and (codes[np.arange(len(codes)) + np.repeat(start[like] - start, span)] == codes).all():
            return first, kind
        parts = [codes[a : a + n].tobytes() for a, n in zip(start.tolist(), span.tolist())]  # two have one hash
        known = {p: k for k, p in enumerate(dict.fromkeys(parts))}
        kind = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        return np.unique(kind, return_index=True)[1], kind

    def decode_flat(self, edge: np.ndarray, values: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text whose ids are values[edge[k]:edge[k + 1]], without the space that was put before
        it; bytes pieces as they are, so these may not be valid."""
        start, long = self.edge[values], self.edge[values + 1] - self.edge[values]
        total = np.concatenate([[0], np.cumsum(long)])
        data = self.surface[np.repeat(start - total[:-1], long) + np.arange(total[-1])]
        low = total[edge]
        full = np.flatnonzero(edge[1:] > edge[:-1])
        if self.prefix:
            spaced = full[self.spaced[values[edge[full]]]]
            low = low.copy()
            low[spaced] += 1  # the mark of a space is the first byte of what its piece decodes to
        raw = data.tobytes()
        return [raw[a:b] for a, b in zip(low[:-1].tolist(), total[edge[1:]].tolist())]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of byte pieces as UTF-8, without the space that was put before a text."""
        return self.decode_flat(np.array([0, len(ids)]), np.array(ids, np.int64))[0].decode("utf-8", "replace")


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """A model file, from the driver's disk or from a store that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    return Path(path).read_bytes()


_loaded: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


def _pooled(batches):
    """Arrow batches joined to larger ones, and large ones cut."""
    held, size = [], 0
    for b in batches:
        rows = max(1, b.num_rows * POOL_BYTES // max(1, b.nbytes))
        for a in range(0, b.num_rows, rows):
            held.append(b.slice(a, rows))
            size += held[-1].nbytes
            if size >= POOL_BYTES:
                yield pa.concat_batches(held)
                release()
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, ids) for every row of ``docs(doc_id, text)``.

    A null or empty text has no ids; a null doc_id is kept; repeated rows come out as often as they came in; other
    columns are ignored. The model file is a vocabulary of fixed size and is what goes to each executor.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, path))

    def run(batches):
        p = _pieces(model.value)
        for b in _pooled(batches):
            edge, values = p.encode_flat(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values))], ["doc_id", "ids"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) for every row of ``rows(doc_id, ids)``; null ids give an empty text."""
    spark = rows.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, path))

    def run(batches):
        p = _pieces(model.value)
        for b in batches:
            ids = b.column("ids")
            edge = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            texts = p.decode_flat(edge, ids.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())], ["doc_id", "text"])

    return arrow(rows.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip): encoded, decoded again and compared, in one pass.

    ids_sha256 is of the ids as 4-byte little-endian numbers. Only a text that holds the mark for a space, U+2581,
    as its own character can't come back as it was; a null text comes back empty and counts as such.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, path))

    def run(batches):
        p = _pieces(model.value)
        for b in _pooled(batches):
            texts = b.column("text").to_pylist()
            edge, values = p.encode_flat(texts)
            raw = values.astype("<i4").tobytes()
            digest = [hashlib.sha256(raw[4 * a : 4 * z]).hexdigest() for a, z in zip(edge.tolist(), edge[1:].tolist())]
            back = [x == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(p.decode_flat(edge, values), texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(edge)), pa.array(digest, pa.string()), pa.array(back, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")
