"""Language identification by a byte-level convolutional network, trained and applied in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow, fold

#: Bytes in a window; widths of the filters; filters of each width; dimensions of a byte.
WINDOW, WIDTHS, FILTERS, DIMS = 256, (2, 3, 4), 16, 8
#: The bounded sample that is learned from: documents of each language, and windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 600, 6
UNKNOWN = "und"


@dataclass
class Network:
    """Byte vectors, for each width the filters, and the output layer over the pooled maxima."""

    names: list[str]
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.bias, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest response of each filter in each window, and where it is. A filter's response is a sum of
        one table entry for each of its bytes, so no byte vectors are laid out."""
        tops, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            n, x = WINDOW - w + 1, None
            for t in range(w):
                y = np.take(self.table @ f[t], windows[:, t : t + n], axis=0)
                x = y if x is None else np.add(x, y, out=x)
            places.append(x.argmax(axis=1))
            tops.append(np.take_along_axis(x, places[-1][:, None], 1)[:, 0] + b)
        return np.concatenate(tops, axis=1), places

    def compile(self):
        """A function from windows to the probabilities of the languages, with filters applied to pairs of bytes."""
        tables = []
        for w, f in zip(WIDTHS, self.filters):
            one = [self.table @ f[t] for t in range(w)]
            pairs = [(t, (one[t][:, None] + one[t + 1][None]).reshape(65536, FILTERS)) for t in range(0, w - 1, 2)]
            tables.append((w, pairs, one[-1] if w % 2 else None))

        def apply(windows: np.ndarray) -> np.ndarray:
            pair = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
            tops = []
            for (w, pairs, last), b in zip(tables, self.bias):
                n, x = WINDOW - w + 1, None
                for t, table in pairs:
                    y = np.take(table, pair[:, t : t + n], axis=0)
                    x = y if x is None else np.add(x, y, out=x)
                if last is not None:
                    x += np.take(last, windows[:, w - 1 : w - 1 + n], axis=0)
                tops.append(x.max(axis=1) + b)
            return _softmax(np.maximum(np.concatenate(tops, axis=1), 0) @ self.out + self.out_bias)

        return apply


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], steps: int = 1200, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """A network for ``windows`` (n x WINDOW bytes, 0 beyond a text's end) with ``labels`` (numbers of ``names``).

    Adam on the cross-entropy, languages drawn equally often; a part of the windows is cut short each time, so that
    short texts are learned too. Only the place of each maximum passes a gradient back.
    """
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    net = Network(names, draw(256, DIMS), [draw(w, DIMS, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(FILTERS * len(WIDTHS), len(names)), np.zeros(len(names), np.float32))
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_label = [np.flatnonzero(labels == k) for k in range(len(names))]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), batch)
        x = windows[[rng.choice(by_label[k]) for k in y]].copy()
        for i in np.flatnonzero(rng.random(batch) < 0.3):
            x[i, rng.integers(6, WINDOW) :] = 0
        top, places = net.pooled(x)
        hidden = np.maximum(top, 0)
        g = (_softmax(hidden @ net.out + net.out_bias) - np.eye(len(names), dtype=np.float32)[y]) / batch
        back = (g @ net.out.T) * (top > 0)
        d_table, d_filters, d_bias = np.zeros_like(net.table), [], []
        for k, (w, f, at) in enumerate(zip(WIDTHS, net.filters, places)):
            gk = back[:, k * FILTERS : (k + 1) * FILTERS]
            df = np.empty_like(f)
            for t in range(w):
                bytes_ = np.take_along_axis(x, at + t, 1)
                df[t] = np.einsum("bf,bfd->df", gk, net.table[bytes_])
                np.add.at(d_table, bytes_, gk[:, :, None] * f[t].T[None])
            d_filters.append(df)
            d_bias.append(gk.sum(axis=0))
        slope = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, d, m, v in zip(params, [d_table, *d_filters, *d_bias, hidden.T @ g, g.sum(axis=0)], first, second):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= (slope * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def tiles(data: bytes) -> np.ndarray:
    """The whole text in windows end to end; the last one is filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(texts: list[str | None], names: list[str], apply, batch: int = 128) -> list[tuple[str, float]]:
    """(language, score) of each text: the mean probabilities of its windows, weighted by their bytes."""
    if not names:
        return [(UNKNOWN, 0.0)] * len(texts)
    data = [t.encode("utf-8", "surrogatepass") if has_letter(t) else b"" for t in texts]
    sums, sizes = np.zeros((len(texts), len(names))), np.array([max(1, len(d)) for d in data])
    held, owner, weight, n = [], [], [], 0

    def flush():
        x, who, w = np.concatenate(held), np.concatenate(owner), np.concatenate(weight)
        for a in range(0, len(x), batch):
            np.add.at(sums, who[a : a + batch], apply(x[a : a + batch]) * w[a : a + batch, None])

    for i, d in enumerate(data):
        if not d:
            continue
        for a in range(0, len(d), 1024 * WINDOW):
            x = tiles(d[a : a + 1024 * WINDOW])
            w = np.full(len(x), WINDOW)
            w[-1] = len(d[a : a + 1024 * WINDOW]) - WINDOW * (len(x) - 1)
            held.append(x)
            owner.append(np.full(len(x), i))
            weight.append(w)
            n += len(x)
            if n >= 1024:
                flush()
                held, owner, weight, n = [], [], [], 0
    if held:
        flush()
    best = sums.argmax(axis=1)
    return [(names[k], float(min(1.0, s[k] / z))) if d else (UNKNOWN, 0.0) for d, k, s, z in zip(data, best, sums, sizes)]


def _windows(batches, per_doc):
    for b in batches:
        who, out = [], []
        for lang, seed, text in zip(*(b.column(c).to_pylist() for c in ("lang", "seed", "text"))):
            x = tiles((text or "").encode("utf-8", "surrogatepass"))
            pick = np.random.default_rng(seed & (1 << 63) - 1).permutation(len(x))[:per_doc]
            who += [lang] * len(pick)
            out += [x[p].tobytes() for p in pick]
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])


def learn(labelled: DataFrame, docs_each: int = SAMPLE_DOCS, windows_each: int = SAMPLE_WINDOWS) -> Network | None:
    """A network learned from ``labelled(doc_id, text, lang)``; None if no row has both a language and a letter.

    The sample is bounded by ``docs_each`` documents of each language, taken in the order of a hash of the doc_id,
    and ``windows_each`` windows of each; both bounds hold whatever the size of the table.
    """
    rows = labelled.where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string"), F.xxhash64("doc_id").alias("seed"), F.col("text").cast("string"))
    # about three times as many as are wanted come through by their hash, so what is then ranked doesn't grow with the table
    share = rows.groupBy("lang").agg((F.lit(3 * docs_each * 1_000_000) / F.count("*")).alias("per_million"))
    near = rows.join(F.broadcast(share), "lang").where(F.pmod("seed", F.lit(1_000_000)) < F.col("per_million"))
    order = W.partitionBy("lang").orderBy("seed", "text")
    sample = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_each).select("lang", "seed", "text")
    got = sorted((r.lang, bytes(r.window)) for r in arrow(sample, lambda it: _windows(it, windows_each), "lang string, window binary").collect())
    if not got:
        return None
    names = sorted({g[0] for g in got})
    x = np.frombuffer(b"".join(g[1] for g in got), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([names.index(g[0]) for g in got]), names)


def classify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs(doc_id, text)``, from the whole text.

    ``und`` with score 0 for a null text, one without a letter, and if nothing could be learned. A null doc_id is
    kept, repeated rows come out as often as they came in, other columns are ignored.
    """
    names = net.names if net else []
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        apply = shared.value.compile() if shared.value else None
        for b in batches:
            got = predict(b.column("text").to_pylist(), names, apply)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows of ``docs`` that aren't held out, said of all."""
    held = fold(F.col("doc_id"), 4) == 2
    net = learn(docs.where(~held).select("doc_id", "text", "lang"))
    return classify(docs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` in a language that is recognised with ``least`` certainty, each judged by its own text.

    All columns go through as they are, in one pass, without a join.
    """
    net = learn(docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    names = net.names if net else []
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        apply = shared.value.compile() if shared.value else None
        for b in batches:
            got = predict(b.column("text").to_pylist(), names, apply)
            yield b.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in got], pa.bool_()))

    return arrow(docs, run, docs.schema)
