"""A quality classifier: Bradley-Terry scores learned from all pairs of a good and a bad document, cut at a quantile."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, discard, fold, materialize

#: Rows at a time that ``fit`` pairs with the other class.
PAIRS = 60_000
#: Widths of the bins of scores that stand for the pairs: fine ones for the gradient, so many together for the curvature.
STEP, COARSE = 1 / 32, 8
#: The weight of the penalty on squared weights; Newton steps at most, and the change of weights at which they end.
PENALTY, STEPS, NEAR = 2e-3, 100, 1e-8
#: A document counts as good from this score on.
GOOD = 0.7
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_{|}~"
_ENDS = frozenset(bytes([c]) for c in _MARKS)
#: What ``features`` gives, in order.
NAMES = ["length", "word_length", "line_length", "upper", "digit", "space", "other", "repeated_lines", "short_lines", "vocabulary", "same_word_again", "marked_words", "top_word", "long_words", *(f"mark_{chr(c)}" for c in _MARKS)]


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text: lengths, shares of kinds of bytes, repeats of lines and words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    w, ln = max(1, len(words)), max(1, len(lines))
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    part = lambda a, b: 10 * math.sqrt(a / b)  # noqa: E731  shares near zero are told apart better
    base = [
        math.log1p(len(data)), sum(map(len, words)) / w, math.log1p(n / ln),
        part(int(count[65:91].sum()), n), part(int(count[48:58].sum()), n), part(int(count[32]), n), part(int(count[128:].sum() + count[:32].sum() - count[9:14].sum()), n),
        part(ln - len(set(lines)), ln), part(sum(len(x) < 25 for x in lines), ln), 10 * len(seen) / w / (1 + 1 / math.sqrt(w)),
        part(sum(a == b for a, b in zip(words, words[1:])), w), part(sum(x[-1] not in b".," and x[-1:] in _ENDS for x in words), w),
        part(max(seen.values(), default=0), w), part(sum(len(x) > 24 for x in words), w),
    ]
    return np.array(base + [part(int(count[c]), n) for c in _MARKS])


@dataclass
class Ranking:
    """A linear score of standardised features, squared ones beside them, less the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0

    def spread(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 6], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, and GOOD at the cut."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + math.log(GOOD / (1 - GOOD)), -60, 60)))


#: What is summed over rows: of features and whether they are good, keys and a vector for each.
Kernel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: The sums of a kernel over all rows that are learned from: keys in order, and the sum for each.
Sums = Callable[[Kernel], tuple[np.ndarray, np.ndarray]]


def _add(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and the sums of the rows of each."""
    found, at = np.unique(keys, return_inverse=True)
    out = np.zeros((len(found), rows.shape[1]))
    np.add.at(out, at, rows)
    return found, out


def _moments(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each class: how many, and the sums of features and of their squares."""
    return _add(good.astype(np.int64), np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1))


def _curvature(n: int) -> np.ndarray:
    """The second derivative of the loss of a pair, for pairs of ``n`` coarse bins."""
    d = np.arange(n) * STEP * COARSE
    p = 1 / (1 + np.exp(np.clip(d[:, None] - d, -700, 700)))
    return p * (1 - p)


class Pairs:
    """The mean logistic loss of the score differences of all pairs of a good and a bad document, at a ranking's weights.

    A row's part in the gradient depends on its score alone, by way of the mean of the logistic function of the differences
    to all scores of the other class. That is a smooth function of the score; it is made of the other class's numbers
    in bins and the moments there up to the third, and read between nodes by cubics. So no pair is drawn and none is left
    out, and a pass over the rows does. Errors of the function are below 1e-8.
    """

    def __init__(self, sums: Sums, rank: Ranking):
        self.rank = rank  # not the sums: workers get this object

        def bins(x, good):
            s = rank.raw(x)
            b = np.floor(s / STEP)
            t = s - (b + 0.5) * STEP
            return _add(2 * b.astype(np.int64) + good, np.stack([np.ones(len(s)), t, t**2 / 2, t**3 / 6], axis=1))

        keys, found = sums(bins)
        bin_, class_ = keys >> 1, keys & 1
        # a whole coarse bin beside either end, so that all scores lie between nodes
        self.low = (int(bin_.min()) // COARSE - 1) * COARSE
        n = (int(bin_.max()) // COARSE + 2) * COARSE - self.low
        m = np.zeros((2, 4, n))
        m[class_, :, bin_ - self.low] = found
        self.n = m[:, 0].sum(axis=1)
        m /= self.n[:, None, None]
        d = np.arange(1 - n, n) * STEP
        p = 1 / (1 + np.exp(-np.clip(d, -700, 700)))
        q = p * (1 - p)
        steps = [p, q, q * (1 - 2 * p), q * (1 - 6 * q), q * (1 - 2 * p) * (1 - 12 * q)]  # the logistic function and its derivatives
        size = 1 << (3 * n).bit_length()
        over = lambda a, b: np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[n - 1 : 2 * n - 1]
        mean = lambda k, own: sum((-1) ** j * over(own[j], steps[k + j]) for j in range(4))
        # at the nodes, which are the middles of the bins: value and slope for either class
        self.value, self.slope = (np.stack([mean(k, own) for own in m]) for k in (0, 1))
        loss = over(m[0, 0], np.logaddexp(0, -d)) + over(m[0, 1], 1 - p) + over(m[0, 2], q) - over(m[0, 3], steps[2])
        self.loss = float(m[1, 0] @ loss + m[1, 1] @ (self.value[0] - 1) + m[1, 2] @ self.slope[0]) + PENALTY / 2 * float(rank.weights @ rank.weights)
        self.curved = _curvature(n // COARSE) @ m[:, 0].reshape(2, -1, COARSE).sum(axis=2).T

    def below(self, s: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The mean over the class ``other`` of the logistic function of what a score lies above one of that class."""
        at = s / STEP - 0.5 - self.low
        i = np.clip(np.floor(at).astype(np.int64), 0, self.value.shape[1] - 2)
        f, v, w = at - i, self.value, self.slope * STEP
        return (1 + 2 * f) * (1 - f) ** 2 * v[other, i] + f * (1 - f) ** 2 * w[other, i] + f * f * (3 - 2 * f) * v[other, i + 1] - f * f * (1 - f) * w[other, i + 1]

    def step(self, sums: Sums) -> np.ndarray:
        """The Newton step. Its gradient is that of all pairs; the curvature is that of pairs of coarse bins."""
        rank, width = self.rank, len(self.rank.weights)

        def part(x, good):
            z, k = rank.spread(x), good.astype(np.int64)
            s = z @ rank.weights
            b = np.clip((np.floor(s / STEP).astype(np.int64) - self.low) // COARSE, 0, len(self.curved) - 1)
            p = self.below(s, 1 - k)
            z_n = z / self.n[k][:, None]
            rows = [(z_n * self.curved[b, 1 - k][:, None]).T @ z, (np.where(good, p - 1, p) @ z_n)[None]]
            keys, own = _add(width + 1 + 2 * b + k, z_n)
            return np.concatenate([np.arange(width + 1), keys]), np.concatenate([*rows, own])

        keys, rows = sums(part)
        by = np.zeros((2 * len(self.curved), width))
        by[keys[width + 1 :] - width - 1] = rows[width + 1 :]
        cross = by[1::2].T @ _curvature(len(self.curved)) @ by[::2]
        return np.linalg.solve(rows[:width] - cross - cross.T + PENALTY * np.eye(width), rows[width] + PENALTY * rank.weights)


def ordered(sums: Sums, rank: Ranking, places: list[int]) -> list[float]:
    """The raw scores at these places, from 0, in the order of all: 12 bits at a time, the highest first, are counted."""
    flip = np.int64(2**63 - 1)
    at, done = [(0, k) for k in places], 64
    for shift in (52, 40, 28, 16, 4, 0):
        heads = np.array([h for h, _ in at], np.int64)

        def count(x, good, shift=shift, done=done, heads=heads):
            bits = np.ascontiguousarray(rank.raw(x)).view(np.int64)
            bits = bits ^ ((bits >> 63) & flip)  # in the order of the numbers
            if done < 64:
                bits = bits[np.isin(bits >> done, heads)]
            return _add(bits >> shift, np.ones((len(bits), 1)))

        keys, n = sums(count)
        for i, (head, k) in enumerate(at):
            own = slice(None) if done == 64 else keys >> (done - shift) == head
            upto = np.cumsum(n[own, 0]).astype(np.int64)
            j = int(np.searchsorted(upto, k, side="right"))
            at[i] = int(keys[own][j]), k - int(upto[j - 1] if j else 0)
        done = shift
    bits = np.array([h for h, _ in at], np.int64)
    return (bits ^ ((bits >> 63) & flip)).view(np.float64).tolist()


def minimise(sums: Sums, share_bad: float | None = None) -> Ranking | None:
    """The weights with the least penalised loss over all pairs, and the cut; None unless there are rows of both classes.

    Mean and scale of the features give both classes the same weight, as pairs do. Weights are rounded, so that the order
    in which rows are summed doesn't show. The cut is the middle between the two scores that part ``share_bad`` of
    all rows (None: as many as are bad) from those above.
    """
    keys, total = sums(_moments)
    if len(keys) < 2:
        return None
    n = total[:, 0]
    first, second = np.split((total[:, 1:] / n[:, None]).mean(axis=0), 2)
    rank = Ranking(np.round(first, 9), np.round(np.sqrt(np.maximum(second - first**2, 0)), 9) + 1e-6, np.zeros(2 * len(first)))
    now = Pairs(sums, rank)
    for _ in range(STEPS):  # Newton steps on a convex loss
        step = now.step(sums)
        step *= min(1.0, 4 / (np.linalg.norm(step) + 1e-9))
        while True:
            new = Pairs(sums, replace(rank, weights=rank.weights - step))
            if new.loss <= now.loss + 1e-7 or np.abs(step).max() < NEAR:
                break
            step /= 2
        rank, now = new.rank, new
        if np.abs(step).max() < NEAR:
            break
    rank = replace(rank, weights=np.round(rank.weights, 6))
    rows = int(n.sum())
    k = int(n[0]) if share_bad is None else round(share_bad * rows)
    rank.cut = sum(ordered(sums, rank, [min(max(k - 1, 0), rows - 1), min(k, rows - 1)])) / 2
    return rank


def fit(good: np.ndarray, bad: np.ndarray, share_bad: float, pairs: int = PAIRS) -> Ranking:
    """``minimise`` over features in memory: all pairs of a good and a bad document count.

    ``pairs`` rows at a time are paired with the whole other class, which bounds memory, not what is learned from.
    """
    x, y = np.concatenate([good, bad]), np.arange(len(good) + len(bad)) < len(good)

    def sums(kernel):
        found = [kernel(x[i : i + pairs], y[i : i + pairs]) for i in range(0, len(x), pairs)]
        return _add(np.concatenate([k for k, _ in found]), np.concatenate([v for _, v in found]))

    return minimise(sums, share_bad)


def own_labels(labels: DataFrame, column: str, modulus: int, out: int) -> DataFrame:
    """(doc_id, label) of rows with a doc_id that aren't held out. If a doc_id is labelled twice, the larger label counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold(F.col("doc_id"), modulus) != out)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def sample_labels(labels: DataFrame, column: str, modulus: int, out: int, each: int) -> tuple[DataFrame, dict[int, int]]:
    """Some of ``own_labels``, and how many there are of each class: ``each`` of either at most, in the order of a hash of the doc_id."""
    own = own_labels(labels, column, modulus, out)
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    first = lambda k: own.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    return first(0).unionByName(first(1)), counts


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The equally long lists of a column as the rows of a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), pa.float64()))


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row of ``docs(doc_id, text)``: the features of its whole text."""

    def run(batches):
        for b in batches:
            if len(b):
                x = np.stack([features(t) for t in b.column("text").to_pylist()]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(x)], ["doc_id", "x"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, x array<double>")


def table_sums(table: DataFrame) -> Sums:
    """Sums over ``table(label, x)``. Each task sums its rows, and the driver the tasks'.

    So that the latter doesn't grow with the input, there are as many tasks as cores, or 64.
    """
    few = table.coalesce(max(64, table.sparkSession.sparkContext.defaultParallelism))

    def sums(kernel):
        def run(batches):
            keys = rows = None
            for b in batches:
                if len(b):
                    k, v = kernel(_matrix(b.column("x")), b.column("label").to_numpy() == 1)
                    keys, rows = (k, v) if rows is None else _add(np.concatenate([keys, k]), np.concatenate([rows, v]))
            if rows is not None:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(rows)], ["k", "v"])

        got = arrow(few, run, "k long, v array<double>").toArrow()
        if not got.num_rows:
            return np.zeros(0, np.int64), np.zeros((0, 1))
        return _add(got["k"].to_numpy(), _matrix(got["v"].combine_chunks()))

    return sums


def learn(described: DataFrame, labels: DataFrame) -> Ranking | None:
    """A ranking from ``labels(doc_id, quality)`` and ``describe``'s table; None unless both classes occur in it.

    It is learned from every row that has a label and isn't held out, of equal doc_ids from all. Their features are stored
    and gone through again and again; neither is gathered anywhere.
    """
    own = materialize(described.join(own_labels(labels, "quality", 4, 2), "doc_id").select("label", "x"), "quality-learn")
    rank = minimise(table_sums(own))
    discard(described.sparkSession, own)
    return rank


def score(described: DataFrame, rank: Ranking | None) -> DataFrame:
    """(doc_id, score) for every row of ``describe``'s table; without a ranking, 0.5 for all."""
    shared = described.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        r = shared.value
        for b in batches:
            s = r.score(_matrix(b.column("x"))) if r and len(b) else np.full(len(b), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return arrow(described, run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``, learned from ``labels``.

    A null text is an empty one, which gets a score like any other; a null doc_id is kept; repeated rows come out as
    often as they came in; without labels of both classes all score 0.5. Other columns are ignored. Texts are read once:
    their features are stored, and serve both learning and scoring.
    """
    described = materialize(describe(docs), "quality")
    found = score(described, learn(described, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))
