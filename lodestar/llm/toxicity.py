"""Toxicity: a learned lexicon matched by Levenshtein automata over its trie, with scores from the words around a match."""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass, field
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, fold, materialize, partitions
from .quality import sample_labels

#: The bounded sample that is learned from: labelled documents of each class.
SAMPLE_EACH = 5000
#: A document counts as toxic from this score on.
TOXIC = 0.7
#: A term is learned if this many toxic documents that no stronger term explains have it, and it makes up that many times as
#: much of their words as of others', and if such a run of toxic documents alone would be as unlikely as e**-CHANCE
#: for a word of no meaning.
SUPPORT, ODDS, CHANCE = 5, 15.0, 16.0
#: Lengths of word beginnings that may be learned as stems; words looked at around a match; states and words kept.
STEMS, AROUND, KEPT = range(4, 9), 6, 300_000
#: Words: letters, digits and whatever else isn't ASCII, but for the usual marks between words.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\xA0\xA1\xAB\xBB\xBF\u2000-\u206F]+")
#: Digits that stand for letters inside a word, and words that report what others said (English, German, French,
#: Spanish): fixed values.
LEET = str.maketrans("013457", "oieast")
REPORT = frozenset("quote quoted quotes quoting said says called word words meaning zitat zitiert sagte wort begriff citation palabra término".split())
#: Marks that open and close quotations, those that do both, and the latter inside a word, where they do neither.
OPEN, CLOSE, BOTH, INSIDE = "“„«‹", "”“»›", "\"'’‘`", re.compile(r"(?<=\w)['’‘`](?=\w)")


def edits(term: str) -> int:
    """Misspellings allowed in a term: none in a short one, two in a long one."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The intersection of the Levenshtein automata of all terms with their trie, made deterministic as it is used.

    A state is the set of trie nodes that what was read so far can stand for, each with the fewest edits, closed
    under letters left out. Reading a letter takes each node on by a match, a changed or an added letter; sets
    are kept, so a word costs one look-up for each letter, and most words end in the empty set after a few. A stem
    (a term with ``*`` at its end) is spelled exactly and may be followed by anything.
    """

    def __init__(self, terms: dict[str, float]):
        self.terms = dict(terms)
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.stems: dict[int, str] = {}
        self.limit: list[int] = [0]
        for term in sorted(terms):
            stem, plain = term.endswith("*"), term.rstrip("*")
            node, most = 0, 0 if stem else edits(plain)
            self.limit[0] = max(self.limit[0], most)
            for c in plain:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], most)
            (self.stems if stem else self.ends)[node] = term
        self.reset()

    def reset(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.states: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.words: dict[str, tuple[str, int] | None] = {}
        self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.limit[child] and e + 1 < nodes.get(child, 9):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(nodes.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(nodes)
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        out: dict[int, int] = {}

        def reach(node, e):
            if e <= self.limit[node] and e < out.get(node, 9):
                out[node] = e

        for node, e in self.states[state].items():
            reach(node, e + 1)
            for c, child in self.children[node].items():
                reach(child, e + (c != letter))
        return self._state(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) that a word stands for, fewest edits first; None if none."""
        if word in self.words:
            return self.words[word]
        if len(self.words) > KEPT or len(self.steps) > KEPT:
            self.reset()
        state, found = 0, None
        for c in word:
            key = (state, c)
            if key not in self.steps:
                self.steps[key] = self._step(state, c)
            state = self.steps[key]
            at = self.states[state]
            if not at:
                break
            if self.stems and found is None:
                found = next((self.stems[n] for n, e in sorted(at.items()) if e == 0 and n in self.stems), None)
        if found is not None:
            got = (found, 0)
        else:
            ends = [(e, self.ends[n]) for n, e in self.states[state].items() if n in self.ends and e <= edits(self.ends[n])]
            got = min(ends)[::-1] if ends else None
        self.words[word] = got
        return got


def logit(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass
class Model:
    """Terms with the chance that a document with one is toxic, and what is known of matches in general.

    ``innocent``: spellings that are known to be none; ``base``: the score without a match; ``quoted`` and ``misspelled``:
    how much of a term's evidence is left in a quotation, and after each edit; ``loose``: the most that a misspelling of
    a term says; ``share``: of toxic documents; ``density``: of matches among the words of a typical toxic document;
    ``slope`` and ``offset`` (None: that of ``share``) make a chance of the evidence.
    """

    terms: dict[str, float] = field(default_factory=dict)
    innocent: frozenset = frozenset()
    base: float = 0.05
    quoted: float = 0.3
    misspelled: float = 0.9
    loose: dict[str, float] = field(default_factory=dict)
    share: float = 0.05
    density: float = 0.02
    slope: float = 1.0
    offset: float | None = None

    def evidence(self, n: int, found: list[tuple[str, int, bool]]) -> float:
        """The log likelihood ratio of matches (term, edits, quoted) among ``n`` words.

        Each match counts by its term. Against them stands how many there should be: a toxic text has them at ``density``,
        or at the rate at hand if that is less, which makes each of them less telling. So a word that long harmless texts
        have now and then says little there, and a term that harmless texts never have says much anywhere. Of all quoted
        matches the strongest counts.
        """
        total = count = most = 0.0
        for term, e, q in found:
            own = logit(min(0.9999, self.terms[term])) - logit(self.share)
            if e:
                own = min(own * self.misspelled**e, self.loose.get(term, math.inf))
            if q:
                most = max(most, own)
            elif own > 0:
                total, count = total + own, count + (self.misspelled**e if e else 1)
        total, count = total + self.quoted * most, count + self.quoted * (most > 0)
        if not count:
            return 0.0
        rate = min(self.density, count / n)
        return total + count * math.log(rate / self.density) - n * rate

    def chance(self, evidence: float) -> float:
        x = (logit(self.share) if self.offset is None else self.offset) + self.slope * evidence
        return round(1 / (1 + math.exp(-max(-60.0, min(60.0, x)))), 6)


def plain(word: str) -> str:
    """Digits inside a word of letters as the letters they look like."""
    return word if word.isalpha() or not any(map(str.isalpha, word)) else word.translate(LEET)


def quoted(text: str, found: list[re.Match], k: int) -> bool:
    """Whether the words around word k report it: it stands in a quotation, or a word of reporting is near."""
    low, high = max(0, k - AROUND), min(len(found), k + AROUND + 1)
    # the character before the first word and after the last one may be a mark
    before = INSIDE.sub("", text[max(0, found[low].start() - 1) : found[k].start()])
    after = INSIDE.sub("", text[found[k].end() : found[high - 1].end() + 1])
    opened = max(map(before.rfind, OPEN)) > max(before.rfind(c) for c in CLOSE if c not in OPEN)
    if opened and any(c in after for c in CLOSE) or any(before.count(c) % 2 and c in after for c in BOTH):
        return True
    return any(m[0] in REPORT for m in found[low:high])


def matches(text: str | None, lexicon: Automaton, innocent: frozenset = frozenset()) -> dict[str, tuple[str, int]]:
    """(term, edits) of each different word of the text that stands for a term."""
    different = set(WORD.findall((text or "").lower()))
    return {w: m for w in different if (p := plain(w)) not in innocent and (m := lexicon.match(p))}


def hits(text: str | None, lexicon: Automaton, innocent: frozenset = frozenset()) -> tuple[int, list[tuple[str, int, bool]]]:
    """(words, [(term, edits, quoted)]) of a text: a word between the same two words again counts once, in both."""
    known = matches(text, lexicon, innocent)
    if not known:
        return 0, []
    low = text.lower()
    found = list(WORD.finditer(low))
    spelled = ["", *(m[0] for m in found), ""]
    seen, out = set(), []
    for k, three in enumerate(zip(spelled, spelled[1:], spelled[2:])):
        if three not in seen:
            seen.add(three)
            if three[1] in known:
                out.append((*known[three[1]], quoted(low, found, k)))
    return len(seen), out


def score(text: str | None, model: Model, lexicon: Automaton) -> float:
    """The chance that a text is toxic."""
    n, found = hits(text, lexicon, model.innocent)
    return model.chance(model.evidence(n, found)) if found else model.base


def _places(text: str | None) -> tuple[int, dict[str, tuple[int, str]]]:
    """(words, {word or stem: (how often, the words around its first place)}): as in ``hits``, repeats count once."""
    out: dict[str, tuple[int, str]] = {}
    found = WORD.findall((text or "").lower())
    spelled, seen = ["", *found, ""], set()
    for k, three in enumerate(zip(spelled, spelled[1:], spelled[2:])):
        if three in seen:
            continue
        seen.add(three)
        w = three[1]
        if len(w) < 3 or not w.isalpha():
            continue
        for t in (w, *(w[:n] + "*" for n in STEMS if n < len(w))):
            n, beside = out.get(t) or (0, " ".join(found[max(0, k - 1) : k + 2 : 2]))
            out[t] = n + 1, beside
    return len(seen), out


def _candidates(text: str | None) -> dict[str, str]:
    """Words and stems of a text, each with the words around its first place: copies of a text have the same ones."""
    return {t: beside for t, (_, beside) in _places(text)[1].items()}


def _shares(text: str | None) -> dict[str, int]:
    """The share of each word and stem among the words of a text, in millionths."""
    n, found = _places(text)
    return {t: 1_000_000 * c // n for t, (c, _) in found.items()}


_TALLY = "term string, clean long, toxic long, clean_share long, toxic_share long"


def _tally(batches, what):
    """For each of what ``what`` finds in texts: documents of both classes, and the sums of the values there."""
    for b in batches:
        counts: dict[str, list[int]] = {}
        for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
            for t, v in what(text).items():
                c = counts.setdefault(t, [0, 0, 0, 0])
                c[label] += 1
                c[2 + label] += v
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4))], ["term", "clean", "toxic", "clean_share", "toxic_share"])


def choose(clean: dict[str, int], toxic: list[dict[str, str]], n_clean: int, share: float, ratios: dict[str, float] | None = None) -> dict[str, float]:
    """Terms out of candidates, with the chance that a document with one is toxic.

    ``clean`` counts the clean documents with a candidate, ``toxic`` has the candidates in each toxic document and
    the words beside them; a candidate's support is the number of different such surroundings, so that copies count
    once. ``ratios`` has how many times as much of toxic documents' words as of others' a candidate makes up; without
    it, documents with the candidate are compared. The term that explains most is taken, then the one that explains most
    of the documents that are left, and so on: so words that only stand in the same documents are not taken. Of candidates
    that explain the same, a word goes before a stem and a longer stem before a shorter one. Those with a fifth of the
    largest support at least are taken in any case, unless a stem or most of a stem is. As a stem is spelled exactly, the
    candidate words that begin with one stand beside it, if they are as telling by themselves: so these may be misspelled
    like any other word.
    """
    n_toxic = len(toxic)
    need = max(SUPPORT, math.ceil(CHANCE / math.log1p(n_clean / n_toxic)))
    at: dict[str, dict[int, str]] = {}
    for i, own in enumerate(toxic):
        for t, beside in own.items():
            at.setdefault(t, {})[i] = beside
    size = lambda s: len(set(s.values()))
    whole = {t: size(s) for t, s in at.items()}
    ratio = ratios or {t: n / n_toxic / ((clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, n in whole.items()}
    chance = {t: share * ratio[t] / (share * ratio[t] + 1 - share) for t in at}
    good = [t for t in at if chance[t] >= TOXIC and ratio[t] >= ODDS and whole[t] >= need]
    worth = lambda t, n: n * math.log(max(1.0, ratio[t] * n / whole[t]))
    # what a candidate explains only shrinks as documents go: one that is still first after a new count is the best
    order = lambda t, n: (-worth(t, n), t.endswith("*"), -len(t), t, n)
    heap, gone, out = [order(t, whole[t]) for t in good], set(), {}
    heapq.heapify(heap)
    while heap:
        *_, t, n = heapq.heappop(heap)
        now = size({i: b for i, b in at[t].items() if i not in gone})
        if now < need or ratio[t] * now / whole[t] < ODDS:
            continue
        if now < n:
            heapq.heappush(heap, order(t, now))
            continue
        out[t] = chance[t]
        gone.update(at[t])
    most = max((whole[t] for t in out), default=0)
    begun = {t[:n] for t in out for n in STEMS}
    for t in sorted(good, key=lambda t: (-whole[t], t.endswith("*"), -len(t), t)):
        if t in out or whole[t] < most / 5:
            continue
        bare = t.rstrip("*")
        if any(bare[:n] + "*" in out for n in STEMS if n <= len(bare)) or t.endswith("*") and bare in begun:
            continue
        out[t] = chance[t]
        begun.update(t[:n] for n in STEMS)
    stems = tuple(t[:-1] for t in out if t.endswith("*"))
    beside = (t for t in at if not t.endswith("*") and t.startswith(stems) and chance[t] >= TOXIC and ratio[t] >= ODDS)
    return out | {t: chance[t] for t in beside}


def calibrate(x: np.ndarray, toxic: np.ndarray, share: float, rows: tuple[int, int]) -> tuple[float, float]:
    """(slope, offset) that make chances of evidence: logistic regression near the slope 1 and the offset of ``share``."""
    w = np.where(toxic, share / rows[1], (1 - share) / rows[0]) * sum(rows)
    z, b, first = np.stack([x, np.ones(len(x))], axis=1), np.array([1.0, logit(share)]), np.array([1.0, logit(share)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        grad = z.T @ (w * (p - toxic)) + 5.0 * (b - first)
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 5.0 * np.eye(2), grad)
        b = b - step * min(1.0, 2 / (np.linalg.norm(step) + 1e-9))
    return max(0.05, float(b[0])), float(b[1])


def learn(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> Model:
    """A model from ``labels(doc_id, toxic)``; without labels of both classes one that has no terms.

    At most ``each`` documents of either class are read for it, and only once: the sample is stored. That bounds what
    is broadcast and all that comes to the driver: candidates, those in each toxic document of the sample, and the
    matches in each document of it. None of them is cut off.
    """
    chosen, counts = sample_labels(labels, "toxic", 3, 1, each)
    if len(counts) < 2:
        return Model()
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("label", "text")
    rows = materialize(own, "toxic-sample")
    read = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_clean, n_toxic = read.get(0, 0), read.get(1, 0)
    share = counts[1] / (counts[0] + counts[1])
    if not n_clean or not n_toxic:
        return Model(base=share)
    rows = rows.repartition(partitions(docs.sparkSession))  # the sample may stand in a few files
    sums = [F.sum(c).alias(c) for c in ("clean", "toxic", "clean_share", "toxic_share")]
    tally = lambda what: arrow(rows, lambda it: _tally(it, what), _TALLY).groupBy("term").agg(*sums)
    # a share in the other class is at least that of half a typical document with one
    typical = F.col("toxic_share") / F.col("toxic")
    ratio = (F.col("toxic_share") / n_toxic) / ((F.col("clean_share") + typical / 2) / (n_clean + 1))
    often = tally(_shares).where(F.col("toxic") >= SUPPORT).withColumn("ratio", ratio).where(F.col("ratio") >= ODDS)
    ratios = {r.term: r.ratio for r in often.select("term", "ratio").collect()}
    wanted = frozenset(ratios)

    def present(batches):
        for b in batches:
            own = [[(k, v) for k, v in sorted(_candidates(t).items()) if k in wanted] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([[k for k, _ in x] for x in own], pa.list_(pa.string())), pa.array([[v for _, v in x] for x in own], pa.list_(pa.string()))], ["terms", "beside"])

    toxic = [dict(zip(r.terms, r.beside)) for r in arrow(rows.where("label = 1"), present, "terms array<string>, beside array<string>").collect()]
    terms = choose({}, toxic, n_clean, share, ratios) if ratios else {}
    if not terms:
        return Model(base=share)
    lexicon = Automaton(terms)

    def loose(text):
        return {f"{plain(w)} {m[0]}": 1 for w, m in matches(text, lexicon).items() if m[1] > 0}

    near = [(*r.term.split(" "), r.clean, r.toxic) for r in tally(loose).collect()]
    innocent = frozenset(w for w, _, clean, toxic in near if clean * (n_toxic + 1) * 4 > toxic * (n_clean + 1))
    model = Model(terms, innocent, share=share)
    for t in terms:
        clean, toxic = (sum(x[k] for x in near if x[1] == t) for k in (2, 3))
        if clean >= SUPPORT:  # harmless words are spelled much alike
            model.loose[t] = max(0.0, math.log((toxic + 0.5) / (clean + 0.5) * n_clean / n_toxic))

    def found(batches):
        for b in batches:
            got = [hits(t, lexicon, innocent) for t in b.column("text").to_pylist()]
            lists = [pa.array([[h[k] for h in x] for _, x in got], pa.list_(t)) for k, t in enumerate((pa.string(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([n for n, _ in got], pa.int64()), *lists], ["label", "n", "terms", "edits", "quoted"])

    seen = arrow(rows, found, "label int, n long, terms array<string>, edits array<int>, quoted array<boolean>").collect()
    seen = sorted((r.label, r.n, list(zip(r.terms, r.edits, r.quoted))) for r in seen)
    by: dict[str, list[int]] = {k: [0, 0] for k in ("none", "plain", "loose", "quoted")}
    for label, _, x in seen:
        got = {"quoted" if q else "loose" if e else "plain" for _, e, q in x}
        by[next((k for k in ("plain", "loose", "quoted") if k in got), "none")][label] += 1
    rate = lambda k, a, b: ((q := by[k][1] * share / n_toxic) + a * 1e-4) / (q + by[k][0] * (1 - share) / n_clean + (a + b) * 1e-4)
    left = lambda k, a, b: (logit(rate(k, a, b)) - logit(share)) / (logit(min(0.9999, median(terms.values()))) - logit(share))
    model.base, model.quoted, model.misspelled = min(0.5, rate("none", 0.05, 0.95)), min(1.0, max(0.05, left("quoted", 3, 7))), min(1.0, max(0.5, left("loose", 9, 1)))
    dense = [sum(not q and not e for _, e, q in x) / n for label, n, x in seen if label and x]
    model.density = max(1e-4, median([d for d in dense if d] or [0.02]))
    x = [(model.evidence(n, x), label) for label, n, x in seen if x]
    if x:
        model.slope, model.offset = calibrate(np.clip([v for v, _ in x], -20, 20), np.array([k for _, k in x], bool), share, (n_clean, n_toxic))
    return model


def evaluate(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        lexicon = Automaton(m.terms)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([score(t, m, lexicon) for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``, learned from ``labels``.

    A null text is an empty one and has no match; a null doc_id is kept; repeated rows come out as often as they came
    in; without labels of both classes no text has a match. Other columns are ignored.
    """
    found = evaluate(docs, learn(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"))
