"""Removal of passages that repeat across documents, found through difference-cover anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, partitions

#: A perfect difference set: for any two positions there is a shift below PERIOD that takes both into COVER.
PERIOD, COVER = 7, (0, 1, 3)
#: Words taken up at once; about how many anchors meet in one part of an exchange; frequent hashes that a task remembers.
BATCH_WORDS, PART_ROWS, SEEN = 1 << 17, 1 << 19, 1 << 16
#: Keys from here on name parts of documents, those below parts of hashes.
OF_DOCUMENTS = 1 << 30

_rng = np.random.default_rng(20240229)
_BYTE = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = [int(x) * 2 + 1 for x in _rng.integers(1 << 60, 1 << 62, 4, dtype=np.uint64)]


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes], which: int) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over mapped bytes, with mixed digits."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if not len(lengths):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(lengths) - lengths
    powers = _powers(_BASE[which], int(lengths.max()))
    terms = _BYTE[which][data] * powers[np.arange(len(data)) - np.repeat(starts, lengths)]
    return _mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))


def window_hashes(h: np.ndarray, width: int, which: int) -> np.ndarray:
    """A hash of each run of ``width`` words; the last width - 1 entries are of runs that go beyond the end."""
    out, p = np.zeros(len(h), np.uint64), _powers(_BASE[2 + which], width)
    for k in range(min(width, len(h))):
        out[: len(h) - k] += h[k:] * p[k]
    return _mix(out)


def _batches(batches, columns):
    """Groups of whole rows with at least BATCH_WORDS words or all that is left: (row values, words of each row)."""
    rows, words, n = [], [], 0
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in columns)):
            w = split_words(r[-1])
            rows.append(r[:-1])
            words.append(w)
            n += len(w)
            if n >= BATCH_WORDS:
                yield rows, words
                rows, words, n = [], [], 0
    if rows:
        yield rows, words


def _flat(words: list[list[bytes]], width: int):
    """(all words, row of each word, position in its row, whether ``width`` words of the row start there)."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), counts)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return [x for w in words for x in w], row, pos, pos + width <= np.repeat(counts, counts)


_PART = "part int, hash binary, more binary, pos binary, doc binary, row_key binary, runs binary"


def _short(x: np.ndarray) -> bytes:
    """Positions in as few bytes as the largest needs."""
    return b"\x02" + x.astype("<u2").tobytes() if not len(x) or x.max() < 1 << 16 else b"\x04" + x.astype("<u4").tobytes()


def _long(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u2" if x[0] == 2 else "<u4", offset=1).astype(np.int64)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(33)).astype(np.int64) * parts) >> 31


def _packed(h, lo, doc, key, pos, parts):
    """One row for each part: hashes, positions and the documents they are in. Places come ordered by document, which
    is written once for each run. The bits that name the part are apart from the 32 of an anchor's hash, so the odds
    of a chance match within a part don't grow with the input; ``lo`` has 32 bits more for windows, which have 64 + 32."""
    part = _part(h, parts)
    order = np.argsort(part, kind="stable")
    part, h, lo, doc, key, pos = (x if x is None else x[order] for x in (part, h, lo, doc, key, pos))
    cut = np.searchsorted(part, np.arange(parts + 1))
    full, rows = np.flatnonzero(cut[1:] > cut[:-1]), []
    same = np.zeros(len(h), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (part[1:] == part[:-1])
    first = np.flatnonzero(~same)
    edge = np.searchsorted(first, cut)
    size = np.diff(np.append(first, len(h)))
    short = h.astype(np.uint32) if lo is None else h
    for p in full:
        x, r = slice(cut[p], cut[p + 1]), slice(edge[p], edge[p + 1])
        rows.append((int(p), short[x].tobytes(), b"" if lo is None else lo[x].astype(np.uint32).tobytes(), _short(pos[x]), doc[first[r]].tobytes(), key[first[r]].tobytes() if lo is not None else b"", _short(size[r])))
    return _rows(rows)


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(7)], ["part", "hash", "more", "pos", "doc", "row_key", "runs"])


def _groups(*keys):
    """An order that puts equal keys together, and the number of each one's group in that order."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _mixed(doc, *keys):
    """For each place: the smallest and the largest document that has its hash."""
    order, first, group = _groups(*keys)
    d = doc[order]
    low, high = np.empty_like(doc), np.empty_like(doc)
    low[order], high[order] = np.minimum.reduceat(d, first)[group], np.maximum.reduceat(d, first)[group]
    return low, high


class _Frequent:
    """Hashes that several documents of a task had, with the smallest of those that went on: SEEN of them at most. With
    them a task passes on a frequent hash once or a few times, however many of its batches have it."""

    def __init__(self):
        self.h, self.lo, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, h: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """For each hash its place here, or -1."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where((self.h[at] == h) & (self.lo[at] == lo), at, -1)

    def add(self, h: np.ndarray, lo: np.ndarray, low: np.ndarray) -> None:
        room = SEEN - len(self.h)
        if room <= 0 or not len(h):
            return
        h, first = np.unique(h, return_index=True)
        new = np.flatnonzero(~np.isin(h, self.h))[:room]
        first = first[new]
        h, lo, low = np.concatenate([self.h, h[new]]), np.concatenate([self.lo, lo[first]]), np.concatenate([self.low, low[first]])
        order = np.argsort(h)
        self.h, self.lo, self.low = h[order], lo[order], low[order]


def _verdicts(h, lo, doc, key, pos, parts, seen):
    """What a batch passes on: what it can settle itself goes to its document's part, the rest to the part of its hash.

    Anchors (no ``lo``) of several documents of the task are settled, all places of them; one place goes on for
    others to meet. Windows beyond the smallest document are settled, and those in it go on.
    """
    if not len(h):
        return
    low, high = _mixed(doc, h) if lo is None else _mixed(doc, h, lo)
    second = np.zeros(len(h), np.uint64) if lo is None else lo
    known = seen.find(h, second)
    several = np.flatnonzero((low < high) & (known < 0))
    if lo is None:
        settled = (low < high) | (known >= 0)
        go = ~settled
        go[several[np.unique(h[several], return_index=True)[1]]] = True
    else:
        settled = (doc > low) | (known >= 0) & (doc > np.append(seen.low, 0)[known])
        go = ~settled
        at = np.flatnonzero(go & (known >= 0))
        np.minimum.at(seen.low, known[at], doc[at])
    seen.add(h[several], second[several], low[several])
    yield _packed(h[go], None if lo is None else lo[go], doc[go], key[go], pos[go], parts)
    if settled.any():
        yield _settled(doc[settled], key[settled], pos[settled], parts)


def _settled(doc, key, pos, parts):
    """Settled places, which come ordered by document, packed by the part that all places of a document go to."""
    to = _part(_mix(doc.astype(np.uint64)), parts)
    order = np.argsort(to, kind="stable")
    to, doc, key, pos = to[order], doc[order], key[order], pos[order]
    cut = np.searchsorted(to, np.arange(parts + 1))
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
    edge, size = np.searchsorted(first, cut), np.diff(np.append(first, len(doc)))
    rows = []
    for p in np.flatnonzero(cut[1:] > cut[:-1]):
        r = slice(edge[p], edge[p + 1])
        rows.append((int(p) + OF_DOCUMENTS, b"", b"", _short(pos[cut[p] : cut[p + 1]]), doc[first[r]].tobytes(), key[first[r]].tobytes(), _short(size[r])))
    return _rows(rows)


def _anchors(batches, window, parts):
    """Hashes of the runs at the cover positions of texts that hold a window at all."""
    width, seen = window - PERIOD + 1, _Frequent()
    for rows, words in _batches(batches, ["doc_id", "text"]):
        flat, row, pos, whole = _flat(words, width)
        long = np.fromiter(map(len, words), np.int64, len(words)) >= window
        at = np.flatnonzero(whole & np.isin(pos % PERIOD, COVER) & long[row])
        h = window_hashes(word_hashes(flat, 0), width, 0)[at]
        doc = np.array([r[0] for r in rows], np.int64)[row[at]]
        yield from _verdicts(h, None, doc, np.zeros_like(doc), pos[at], parts, seen)


def _runs(batches):
    """(part, its rows) for each part; the rows of a part arrive one after the other."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and r["part"] != held[0]["part"]:
                yield held[0]["part"], held
                held = []
            held.append(r)
    if held:
        yield held[0]["part"], held


def _places(held):
    """All documents, keys and positions of the rows of a part, and the rows' other arrays on demand."""
    join = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in held])
    runs = np.concatenate([_long(r["runs"]) for r in held])
    doc = np.repeat(join("doc", np.int64), runs)
    key = np.repeat(join("row_key", np.int64), runs) if held[0]["row_key"] else np.zeros_like(doc)
    return doc, key, np.concatenate([_long(r["pos"]) for r in held]), join


def _reduce(batches, windows, parts):
    """For each part: the places whose hash another document has too (anchors), or a smaller document has (windows).
    What is settled passes through."""
    for part, held in _runs(batches):
        if part >= OF_DOCUMENTS:
            yield _rows([tuple(r.values()) for r in held])
            continue
        doc, key, pos, join = _places(held)
        low, high = _mixed(doc, join("hash", np.uint64), join("more", np.uint32)) if windows else _mixed(doc, join("hash", np.uint32))
        out = np.flatnonzero(doc > low if windows else low < high)
        if len(out):
            out = out[np.argsort(doc[out], kind="stable")]
            yield _settled(doc[out], key[out], pos[out], parts)


def _gather(batches):
    """One row for each document, with the keys and the settled places of its texts."""
    for _, held in _runs(batches):
        doc, key, pos, _ = _places(held)
        order = np.lexsort((key, doc))
        doc, key, pos = doc[order], key[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
        ends = np.append(first[1:], len(doc))
        heads = np.flatnonzero(np.concatenate([[True], doc[first][1:] != doc[first][:-1]]))
        cuts = pa.array(np.append(heads, len(first)).astype(np.int32))
        blobs = pa.array([_short(pos[a:b]) for a, b in zip(first, ends)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(doc[first][heads]), pa.ListArray.from_arrays(cuts, pa.array(key[first])), pa.ListArray.from_arrays(cuts, blobs)], ["doc_key", "keys", "pieces"])


def _exchange(rows: DataFrame, windows: bool, parts: int) -> DataFrame:
    """(doc_key, keys, pieces): for each document the places that its batch or the parts have settled. Part p goes to
    partition p modulo their number, so all have as many parts."""
    n = partitions(rows.sparkSession)
    meet = lambda df: df.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("part")
    found = arrow(meet(rows), lambda it: _reduce(it, windows, parts), _PART)
    return arrow(meet(found), _gather, "doc_key long, keys array<long>, pieces array<binary>")


def _windows(batches, window, parts):
    """Two hashes of the windows that hold an anchor which other documents share: each anchor extends to the
    windows that start up to PERIOD - 1 words before it."""
    width, seen = window - PERIOD + 1, _Frequent()
    for rows, words in _batches(batches, ["doc_id", "row_key", "pieces", "text"]):
        flat, row, pos, whole = _flat(words, window)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        base = np.cumsum(counts) - counts
        near = np.zeros(len(flat) + 1, np.int32)
        for r, b, c in zip(rows, base, counts):
            p = np.concatenate([_long(x) for x in r[2]])
            p = p[p + width <= c]
            np.add.at(near, b + np.maximum(p - (window - width), 0), 1)
            np.add.at(near, b + p + 1, -1)
        at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & whole)
        hi, lo = (window_hashes(word_hashes(flat, k), window, k)[at] for k in (0, 1))
        doc = np.array([r[0] for r in rows], np.int64)
        key = np.array([r[1] for r in rows], np.int64)
        yield from _verdicts(hi, lo & np.uint64(0xFFFFFFFF), doc[row[at]], key[row[at]], pos[at], parts, seen)


def _cut(batches, window):
    for b in batches:
        out = []
        for doc, own, keys, pieces, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row_key", "keys", "pieces", "text"))):
            words = split_words(text)
            gone = np.zeros(len(words) + 1, np.int64)
            for k, x in zip(keys or (), pieces or ()):
                if k != own:  # of another text with this doc_id
                    continue
                p = _long(x)
                np.add.at(gone, p, 1)
                np.add.at(gone, p + window, -1)
            drop = np.cumsum(gone)[:-1] > 0
            kept = b" ".join(w for w, d in zip(words, drop.tolist()) if not d) if drop.any() else b" ".join(words)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
            out.append((doc, len(words), int(drop.sum()), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest(), edge.reshape(-1, 2).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))))], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256, spans) for every row of ``docs(doc_id, text)``.

    A word goes if it is in a window of ``window`` consecutive words that also starts in a document with a smaller
    doc_id; windows are judged on the texts as they came in. ``spans`` are the removed word ranges. Null and empty
    texts have no words; a row without doc_id keeps all its words and takes none from others; rows that repeat a
    doc_id are one document in that they never take words from each other. Other columns are ignored.

    Anchors are the runs of window - PERIOD + 1 words at positions in COVER modulo PERIOD. Wherever one window
    stands in two documents, some shift brings both starts into the cover, so both have an anchor in common there;
    only the windows around such anchors are hashed in full and compared. Of a hash that documents of a task
    share one place is passed on, or a few, so no passage, however frequent, fills a part of the exchange. A window's hash has
    96 bits besides those that name its part.
    """
    if window < PERIOD + 3:
        raise ValueError(f"window must be {PERIOD + 3} words or more")
    base = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), F.col("text").cast("string"))
    known = base.where("doc_id IS NOT NULL").withColumn("doc_key", F.col("doc_id"))
    n_bytes = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), int(n_bytes / 6 * len(COVER) / PERIOD / PART_ROWS))
    anchors = _exchange(arrow(known.select("doc_id", "text"), lambda it: _anchors(it, window, parts), _PART), False, parts)
    near = known.join(anchors, "doc_key").select("doc_id", "row_key", "pieces", "text")
    places = _exchange(arrow(near, lambda it: _windows(it, window, parts), _PART), True, parts)
    full = known.join(places, "doc_key", "left").select("doc_id", "row_key", "keys", "pieces", "text")
    # rows without doc_id have nothing to meet, so they meet nothing
    lone = base.where("doc_id IS NULL").select("doc_id", "row_key", F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast("array<binary>").alias("pieces"), "text")
    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<array<long>>"
    cut = lambda df: arrow(df, lambda it: _cut(it, window), schema)
    return cut(full).unionByName(cut(lone))  # apart until here: so both joins take the documents from one and the same exchange
