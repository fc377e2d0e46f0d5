"""Quality of documents by a linear-chain conditional random field over their lines.

Each line is good or bad. What a line shows (shares of kinds of characters, lengths and repeats of its words) is dealt into
bins, and a line's evidence is the sum of weights of its own bins and of those of the lines before and after it; a further
weight ties the labels of neighbours. A document's score is the mean of its lines' marginals, weighted by their length.

Only documents are labelled, so in training every line bears its document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hide, stash

#: Labelled documents that a model is fitted on at most, and runs of at most CHAIN_LINES lines of them.
FIT_DOCS, FIT_CHAINS, CHAIN_LINES = 6_000, 8_000, 128
#: A line of more characters is labelled in pieces of so many.
LINE_CHARS = 4_096
#: Characters whose features are made at once; a text is never cut but at its lines.
BATCH_CHARS = 1 << 19
#: Bins by increasing bounds, for each thing that is measured of a line.
BOUNDS = {
    "chars": (20, 60, 120, 250, 500, 1000, 2000),
    "letters": (0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9),
    "upper": (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "digits": (0.001, 0.01, 0.03, 0.1, 0.2, 0.4),
    "spaces": (0.05, 0.1, 0.13, 0.16, 0.19, 0.22, 0.3),
    "marks": (0.001, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2),
    "signs": (0.001, 0.005, 0.01, 0.03, 0.06, 0.12, 0.25),
    "words": (1, 3, 6, 12, 25, 60, 150),
    "word_length": (2, 3, 3.5, 4, 4.5, 5, 6, 7, 9, 12),
    "long_words": (0.01, 0.05, 0.1, 0.2, 0.3, 0.5),
    "distinct": (0.1, 0.25, 0.4, 0.55, 0.7, 0.8, 0.9, 0.99),
    "commonest": (0.03, 0.06, 0.1, 0.15, 0.2, 0.35, 0.6),
    "repeats": (0.001, 0.02, 0.05, 0.1, 0.3, 0.6),
    "ends": (0.5,),
    "seen": (0.5,),
}
_BINS = max(map(len, BOUNDS.values())) + 1
_LETTER, _UPPER, _DIGIT, _SPACE, _MARK, _SIGN = 1, 2, 4, 8, 16, 32
# Marks of prose; every other sign counts against it.
_MARKS = ".,;:!?'\"()-‘’“”«»¿¡"


@cache
def _kinds() -> np.ndarray:
    """Kinds of every character, as bits; a worker makes them once for all of its tasks."""
    out = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if c.isalpha():
            out[code] = _LETTER | (_UPPER if c.isupper() else 0)
        elif c.isspace():
            out[code] = _SPACE
        elif c.isdigit():
            out[code] = _DIGIT
        else:
            out[code] = _MARK if c in _MARKS else _SIGN
    return out


def lines_of(text: str | None) -> list[str]:
    """The lines of a text that hold more than white space, long ones in pieces."""
    found = (line[k : k + LINE_CHARS] for line in (text or "").split("\n") for k in range(0, len(line), LINE_CHARS))
    return [x for x in found if not x.isspace()]


class LineReader:
    """Bins of lines, made for many lines at once."""

    def __init__(self):
        self.kinds = _kinds()

    def bins(self, lines: list[str], owner: np.ndarray) -> np.ndarray:
        """A row of bins for each line, whose document ``owner`` tells; no line is empty."""
        size = np.array([len(x) for x in lines], np.int64)
        first = np.cumsum(size) - size
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[codes]
        line = np.repeat(np.arange(len(lines)), size)
        share = lambda bit: np.add.reduceat((kind & bit) > 0, first, dtype=np.int64) / size
        # words: runs without white space within a line, and a hash of each by its characters and their places
        ink = (kind & _SPACE) == 0
        starts = ink & np.r_[True, ~ink[:-1] | (line[1:] != line[:-1])]
        word = np.cumsum(starts) - 1
        at, of = np.flatnonzero(starts), line[starts]
        if len(at):
            inside = np.flatnonzero(ink)
            place = (inside - at[word[inside]]).astype(np.uint64)
            mixed = (codes[inside].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * ((place * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))
            mixed ^= mixed >> np.uint64(29)
            begins = np.flatnonzero(np.r_[True, word[inside][1:] != word[inside][:-1]])
            hashes = np.add.reduceat(mixed * np.uint64(0x94D049BB133111EB), begins)
            length = np.diff(np.r_[begins, len(inside)])
        else:
            hashes, length = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        words = np.bincount(of, minlength=len(lines))
        some = np.maximum(words, 1)
        order = np.lexsort((hashes, of))
        new = np.r_[True, (of[order][1:] != of[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])][: len(order)]
        kinds_of = np.bincount(of[order][new], minlength=len(lines))
        times = np.diff(np.r_[np.flatnonzero(new), len(order)])
        most = np.zeros(len(lines), np.int64)
        np.maximum.at(most, of[order][new], times)
        again = (of[1:] == of[:-1]) & (hashes[1:] == hashes[:-1])
        whole = np.zeros(len(lines), np.uint64)
        np.add.at(whole, of, hashes * (np.arange(len(of), dtype=np.uint64) - (np.cumsum(words) - words).astype(np.uint64)[of] + np.uint64(1)))
        by = np.lexsort((np.arange(len(lines)), whole, owner))
        seen = np.zeros(len(lines), bool)
        seen[by[1:]] = (owner[by][1:] == owner[by][:-1]) & (whole[by][1:] == whole[by][:-1])
        measured = {
            "chars": size, "letters": share(_LETTER), "upper": share(_UPPER), "digits": share(_DIGIT), "spaces": share(_SPACE), "marks": share(_MARK), "signs": share(_SIGN),
            "words": words, "word_length": np.bincount(of, length, len(lines)) / some, "long_words": np.bincount(of, length > 12, len(lines)) / some,
            "distinct": kinds_of / some, "commonest": most / some, "repeats": np.bincount(of[1:], again, len(lines)) / some,
            "ends": np.array([x.rstrip()[-1] in ".!?" for x in lines]), "seen": seen,
        }
        return np.stack([np.searchsorted(BOUNDS[k], measured[k], "right") for k in BOUNDS], 1).astype(np.uint8)

    def documents(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bins, lengths) of the lines of each text, in order."""
        held: list[list[str]] = []
        room = BATCH_CHARS
        for text in texts:
            held.append(lines_of(text))
            room -= len(text or "")
            if room <= 0:
                yield from self._flush(held)
                held, room = [], BATCH_CHARS
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        counts = [len(x) for x in held]
        lines = [x for doc in held for x in doc]
        bins = self.bins(lines, np.repeat(np.arange(len(held)), counts)) if lines else np.zeros((0, len(BOUNDS)), np.uint8)
        size = np.array([len(x) for x in lines], np.int64)
        for end, n in zip(np.cumsum(counts), counts, strict=True):
            yield bins[end - n : end], size[end - n : end]


@dataclass(frozen=True)
class Field:
    """Weights of a line's bins and its neighbours' (3 x features x bins) for good, a bias, what equal neighbours gain, and
    what a document without lines scores."""

    weights: np.ndarray
    bias: float
    tie: float
    prior: float


def _around(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices into flat weights for each line: its bins, those of the line before and after; the last index where there is none."""
    n, k = bins.shape
    flat = bins.astype(np.int64) + np.arange(k) * _BINS
    out = np.full((n, 3 * k), 3 * k * _BINS, np.int64)
    out[:, :k] = flat
    starts = np.zeros(n + 1, bool)
    starts[first[first < n]] = True
    starts[n] = True
    later = np.flatnonzero(~starts[:n])
    out[later, k : 2 * k] = flat[later - 1] + k * _BINS
    out[later - 1, 2 * k :] = flat[later] + 2 * k * _BINS
    return out


def _evidence(model: Field, at: np.ndarray) -> np.ndarray:
    return np.append(model.weights.ravel(), 0.0)[at].sum(1) + model.bias


def marginals(evidence: np.ndarray, tie: float, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains of lines at once: P(good) of each line, P(equal labels) of each line and the one before
    it (0 for the first of a chain), and the log partition sum of each chain.

    ``evidence`` is what good gains over bad. Messages are log ratios of good to bad, so nothing under- or overflows.
    Chains are taken by falling length, so step t runs over those that reach so far.
    """
    n = len(evidence)
    pass_on = lambda x: np.logaddexp(x + tie, 0) - np.logaddexp(x, tie)
    order = np.argsort(-size, kind="stable")
    start, length = first[order], size[order]
    longest = int(length[0]) if len(length) else 0
    reach = np.searchsorted(-length, -np.arange(1, longest + 1), "right")
    ahead, behind, same, logz = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(len(first))
    scale = np.zeros(len(first))
    for t in range(longest):
        i = start[: reach[t]] + t
        if t:
            before = ahead[i - 1]
            scale[: reach[t]] += np.logaddexp(before, tie)
            ahead[i] = evidence[i] + pass_on(before)
        else:
            ahead[i] = evidence[i]
    for t in range(longest - 2, -1, -1):
        i = start[: reach[t + 1]] + t
        behind[i] = pass_on(evidence[i + 1] + behind[i + 1])
    if longest:
        whole = length > 0
        logz[order[whole]] = scale[whole] + np.logaddexp(ahead[start[whole] + length[whole] - 1], 0)
    later = np.ones(n, bool)
    later[first[size > 0]] = False
    j = np.flatnonzero(later)
    x, y = ahead[j - 1], evidence[j] + behind[j]
    equal = np.logaddexp(x + y, 0) + tie
    same[j] = np.exp(equal - np.logaddexp(equal, np.logaddexp(x, y)))
    return 1 / (1 + np.exp(-np.clip(ahead + behind, -700, 700))), same, logz


def fit(chains: list[np.ndarray], good: np.ndarray, prior: float, steps: int = 150, ridge: float = 1.0) -> Field:
    """Weights of most likelihood under a ridge, by gradient steps with momentum and a scale for each weight over all chains."""
    k = len(BOUNDS)
    size = np.array([len(x) for x in chains], np.int64)
    if not len(chains) or not size.sum():
        return Field(np.zeros((3, k, _BINS)), 0.0, 0.0, prior)
    first = np.cumsum(size) - size
    at = _around(np.concatenate(chains), first)
    label = np.repeat(good, size).astype(float)
    inside = np.ones(len(label))
    inside[first[size > 0]] = 0
    w = np.zeros(3 * k * _BINS + 2)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        model = Field(w[:-2].reshape(3, k, _BINS), w[-2], w[-1], prior)
        p, same, _ = marginals(_evidence(model, at), model.tie, first, size)
        off = label - p
        # every line of a chain has its document's label, so neighbours are always equal there
        g = np.bincount(at.ravel(), np.repeat(off, 3 * k), 3 * k * _BINS + 1)[:-1]
        g = np.append(g, (off.sum(), (inside - same).sum())) - ridge * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        rate = 0.2 / (1 + step / 40)
        w = w + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(w[:-2].reshape(3, k, _BINS), float(w[-2]), float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chains: int = FIT_CHAINS) -> Field:
    """A model of ``docs`` (doc_id, text) whose doc_id ``labels`` (doc_id, quality: 1 good, 0 bad, others don't count) names.

    It is fitted on the ``fit_docs`` labels whose documents come first by a hash of their ids, on all of these documents' lines
    in chains of at most CHAIN_LINES, of which again the first ``fit_chains`` by hash count: what reaches the driver is
    bounded, whatever texts are like. A document with several labels is as many examples.
    """
    marked = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("good"))
    known = docs.filter("doc_id is not null").select("doc_id").join(marked, "doc_id")
    some = stash(known.orderBy(F.xxhash64("doc_id", "good"), "doc_id", "good").limit(fit_docs))
    # at most fit_docs rows, of an id and a label each
    texts = docs.filter("doc_id is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "good")

    def make():
        reader = LineReader()

        def step(b):
            out = {"good": [], "nth": [], "bins": []}
            for good, (bins, _) in zip(b["good"].to_pylist(), reader.documents(b["text"].to_pylist()), strict=True):
                for k in range(0, max(len(bins), 1), CHAIN_LINES):
                    out["good"].append(good)
                    out["nth"].append(k)
                    out["bins"].append(bins[k : k + CHAIN_LINES].tobytes())
            return out

        return step

    chains = arrow_map(texts, make, "good int, nth int, bins binary").withColumn("h", F.xxhash64("bins", "nth"))
    got = chains.orderBy("h", "bins", "good").limit(fit_chains).select("good", "nth", "bins").collect()
    docs_of = [r["good"] for r in got if r["nth"] == 0]
    # one document more of each kind, so that no score is certain
    prior = (sum(docs_of) + 1) / (len(docs_of) + 2)
    rows = [(np.frombuffer(r["bins"], np.uint8).reshape(-1, len(BOUNDS)), r["good"]) for r in got if r["bins"]]
    return fit([x for x, _ in rows], np.array([y for _, y in rows]), prior)


def score(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """``docs`` with score: the length-weighted mean of P(good) over the lines of each whole text, 0 to 1.

    A text that is null, empty or white space has no line and scores the share of good documents. Every row is scored by
    its text alone, one by one, so repeats score alike. A column named score is replaced.
    """
    docs, names = hide(docs.drop("score"))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in docs.dtypes], "score double"])
    column = names[text]

    def make():
        reader = LineReader()

        def step(b):
            found, held = [], list(reader.documents(b[column].to_pylist()))
            counts = np.array([len(x) for x, _ in held], np.int64)
            first = np.cumsum(counts) - counts
            if counts.sum():
                p, _, _ = marginals(_evidence(model, _around(np.concatenate([x for x, _ in held]), first)), model.tie, first, counts)
            for at, n, (_, size) in zip(first, counts, held, strict=True):
                found.append(float(p[at : at + n] @ size / size.sum()) if n else model.prior)
            return {c: b[c] for c in b.schema.names} | {"score": pa.array(found, pa.float64())}

        return step

    back = {v: k for k, v in names.items()}
    return arrow_map(docs, make, schema).select(*[F.col(c).alias(back.get(c, c)) for c in (*names.values(), "score")])
