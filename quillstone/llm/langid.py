"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of ``ORDER``; all are kept in one sorted array of n-gram hashes, with a column of
log-probabilities for each language and one of log back-off weights. A text goes to the language of least cross-entropy
per character. Thresholds for rejection are calibrated on sampled documents that the counts have not seen: a text goes
if it deviates from its language's documents by more than all but ``FALSE_REJECTIONS`` of those, with a margin.

The models are fit on a bounded sample of labelled rows: at most ``SAMPLE_DOCS`` distinct texts over all languages, read
whole; a third of them calibrates. Predictions read whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ddl, hide

ORDER = 4
SAMPLE_DOCS = 2048
#: Share of calibration documents over whose deviation a text is rejected, and the factor that leaves room for others.
FALSE_REJECTIONS = 0.001
MARGIN = 1.25
#: Standard deviations from which a text is rejected where under CALIBRATION_DOCS documents calibrate.
REJECT_Z = 10.0
CALIBRATION_DOCS = 200
#: Characters that count in the score at most; more would drive every score to 1.
SCORE_CHARS = 32
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = 32


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


_LETTER: list[np.ndarray] = []


def characters(text: str | None) -> np.ndarray:
    """Lower-cased letters, and one space for each run of anything else, within a leading and a closing space."""
    if not _LETTER:
        _LETTER.append(_letters())
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(code, 0xFFFF)
    letter = _LETTER[0][low]
    if len(code) and code.max() > 0xFFFF:
        far = np.flatnonzero(code > 0xFFFF)
        letter[far] = [chr(c).isalpha() for c in code[far].tolist()]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    kept = np.where(letter, code, _SPACE)[keep]
    return np.concatenate(([_SPACE], kept, [_SPACE] if len(kept) and kept[-1] != _SPACE else [])).astype(np.uint64) if len(kept) else np.zeros(0, np.uint64)


def grams(chars: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams ending at each character from the n-th on."""
    h = np.full(len(chars) - n + 1, n, np.uint64) if len(chars) >= n else np.zeros(0, np.uint64)
    for k in range(n if len(h) else 0):
        h = (h ^ chars[k : len(chars) - n + 1 + k]) * _A
        h ^= h >> np.uint64(29)
    return h * _B


@dataclass
class Models:
    """langs; keys (sorted hashes) with log_p[key, lang]; contexts (sorted hashes) with log_back[context, lang]."""

    langs: list[str]
    order: int
    keys: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_back: np.ndarray
    floor: float
    mean: np.ndarray
    sd: np.ndarray
    char_sd: np.ndarray
    z: float = REJECT_Z

    def log_probs(self, chars: np.ndarray) -> np.ndarray:
        """Natural log-probability of each character after the first, by language."""
        n = len(chars) - 1
        out = np.zeros((max(n, 0), len(self.langs)), np.float32)
        todo = np.arange(n)
        hashes = {k: grams(chars, k) for k in range(1, self.order + 1)}
        for k in range(self.order, 0, -1):
            full = todo + 1 >= k - 1  # gram of k characters that ends at todo + 1
            ok = todo[full]
            h = hashes[k][ok + 2 - k]
            at = np.searchsorted(self.keys, h)
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == h
            out[ok[hit]] += self.log_p[at[hit]]
            miss = ok[~hit]
            if k > 1 and len(miss):
                c = hashes[k - 1][miss + 2 - k]  # its context
                at = np.searchsorted(self.contexts, c)
                there = self.contexts[np.minimum(at, len(self.contexts) - 1)] == c
                out[miss[there]] += self.log_back[at[there]]
            elif k == 1:
                out[miss] += self.floor
            todo = np.concatenate((todo[~full], miss))
        return out

    def decide(self, chars: np.ndarray) -> tuple[int, float, float, bool]:
        """(language or -1, score, cross-entropy in nats a character, whether to reject)."""
        if not len(chars) or not self.langs:
            return -1, 0.0, 0.0, True
        n = len(chars) - 1
        total = np.zeros(len(self.langs))
        for at in range(0, n, 1 << 16):
            begin = max(at - self.order + 1, 0)
            total += self.log_probs(chars[begin : at + (1 << 16) + 1])[at - begin :].sum(0, dtype=np.float64)
        entropy = -total / n
        best = int(entropy.argmin())
        score = 1 / np.exp(-(entropy - entropy[best]) * min(n, SCORE_CHARS)).sum()
        limit = self.mean[best] + self.z * np.sqrt(self.sd[best] ** 2 + self.char_sd[best] ** 2 / n)
        return best, float(score), float(entropy[best]), bool(entropy[best] > limit)


def _kneser_ney(samples: list[np.ndarray], order: int, vocabulary: int) -> tuple[list[dict[int, float]], list[dict[int, float]]]:
    """For one language: probabilities of its n-grams by order, and back-off weights of its contexts by length."""
    grams_of = {k: np.concatenate([grams(c, k) for c in samples] or [np.zeros(0, np.uint64)]) for k in range(1, order + 1)}
    seen: dict[int, tuple] = {}
    for k in range(1, order + 1):
        # of each distinct k-gram: its context and its suffix, which lie at the same place of the (k-1)-grams
        ctx = np.concatenate([grams(c, k - 1)[: max(len(c) - k + 1, 0)] for c in samples]) if k > 1 else np.zeros(len(grams_of[1]), np.uint64)
        suf = np.concatenate([grams(c, k - 1)[1 : 1 + max(len(c) - k + 1, 0)] for c in samples]) if k > 1 else np.zeros(len(grams_of[1]), np.uint64)
        keys, first, count = np.unique(grams_of[k], return_index=True, return_counts=True)
        seen[k] = (keys, ctx[first], suf[first], count)
    probs, backs = [], []
    lower: dict[int, float] = {}
    for k in range(1, order + 1):
        keys, ctx, suf, count = seen[k]
        if k < order:  # how many characters precede it
            nxt = seen[k + 1]
            at = np.searchsorted(keys, nxt[2])
            count = np.bincount(at[keys[np.minimum(at, len(keys) - 1)] == nxt[2]], minlength=len(keys)) if len(keys) else count
            count = np.maximum(count, 1)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
        contexts, inverse = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(inverse, count), np.bincount(inverse)
        back = discount * kinds / np.maximum(total, 1)
        below = np.array([lower[s] for s in suf.tolist()]) if k > 1 else np.full(len(keys), 1 / vocabulary)
        p = (count - discount) / total[inverse] + back[inverse] * below if len(keys) else np.zeros(0)
        lower = dict(zip(keys.tolist(), p.tolist(), strict=True))
        probs.append(lower)
        backs.append(dict(zip(contexts.tolist(), back.tolist(), strict=True)))
    return probs, backs


def fit_models(samples: dict[str, list[np.ndarray]], order: int = ORDER, false_rejections: float = FALSE_REJECTIONS) -> Models:
    """Models of each language's samples; every third sample is kept for calibration."""
    langs = sorted(k for k, v in samples.items() if v)
    known = {k: [c for i, c in enumerate(samples[k]) if i % 3 != 2 or len(samples[k]) < 8] for k in langs}
    alphabet = len(set().union(*(np.unique(c).tolist() for k in langs for c in known[k]))) + 1 if langs else 1
    fitted = [_kneser_ney(known[k], order, alphabet) for k in langs]
    # in the shared arrays a language has a value for every n-gram of any language: its own, or its back-off
    parent = {}
    for k in langs:
        for c in known[k]:
            for n in range(2, order + 1):
                g, low = grams(c, n), grams(c, n - 1)
                parent.update(zip(g.tolist(), zip(low[: len(g)].tolist(), low[1 : 1 + len(g)].tolist(), strict=True), strict=True))
    keys_of = [sorted(set().union(*(f[0][n] for f in fitted))) if fitted else [] for n in range(order)]
    table: dict[int, list[float]] = {}
    for n in range(order):
        for g in keys_of[n]:
            row = []
            for j, (p, back) in enumerate(fitted):
                own = p[n].get(g)
                if own is None:
                    own = back[0].get(0, 1.0) / alphabet if n == 0 else back[n].get(parent[g][0], 1.0) * table[parent[g][1]][j]
                row.append(own)
            table[g] = row
    weights: dict[int, list[float]] = {}
    for n in range(1, order):
        for c in set().union(*(f[1][n] for f in fitted)) if fitted else ():
            weights[c] = [f[1][n].get(c, 1.0) for f in fitted]
    keys = np.array(sorted(table), np.uint64)
    contexts = np.array(sorted(weights), np.uint64)
    width = len(langs)
    log = lambda d, k: np.log(np.array([d[x] for x in k.tolist()]).reshape(-1, width)).astype(np.float32)
    m = Models(langs, order, keys if len(keys) else np.zeros(1, np.uint64), log(table, keys) if len(keys) else np.zeros((1, width), np.float32), contexts if len(contexts) else np.zeros(1, np.uint64), log(weights, contexts) if len(contexts) else np.zeros((1, width), np.float32), float(np.log(1e-2 / alphabet)), np.zeros(width), np.full(width, 1.0), np.full(width, 2.0))
    deviations = []
    for j, k in enumerate(langs):
        held = [c for i, c in enumerate(samples[k]) if i % 3 == 2 and len(samples[k]) >= 8] or known[k]
        per = [-m.log_probs(c)[:, j].astype(np.float64) for c in held if len(c) > 1]
        if per:
            entropy, weight = np.array([x.mean() for x in per]), np.array([len(x) for x in per])
            m.mean[j] = np.average(entropy, weights=np.minimum(weight, 1000))
            m.char_sd[j] = max(np.concatenate(per).std(), 0.5)
            # what documents differ by beyond the noise of their characters
            excess = (entropy - m.mean[j]) ** 2 - m.char_sd[j] ** 2 / weight
            m.sd[j] = max(np.sqrt(max(np.average(excess, weights=np.minimum(weight, 1000)), 0)), 0.05)
            if held is not known[k]:
                deviations.append((entropy - m.mean[j]) / np.sqrt(m.sd[j] ** 2 + m.char_sd[j] ** 2 / weight))
    pooled = np.concatenate(deviations) if deviations else np.zeros(0)
    if len(pooled) >= CALIBRATION_DOCS:
        m.z = MARGIN * float(np.quantile(pooled, 1 - false_rejections))
    return m


def train(labelled: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Models from rows of ``labelled`` (text, lang) whose lang and text are not null; the sample is bounded, see the module.

    Sampled are the distinct texts of each language with the smallest hashes. Hashes are spread evenly, so a threshold on
    the hash, from an estimate of a language's distinct texts, picks them in one pass; rank among so few decides at the
    driver. No such rows: models of no language.
    """
    rows = labelled.filter("lang is not null and length(trim(text)) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    if not sizes:
        return fit_models({}, order)
    each = max(8, sample_docs // len(sizes))
    # a fifth and some more, so that a language that has ``each`` texts almost surely gives as many
    limits = [(r["lang"], min(int(2**64 * min(1.0, (1.2 * each + 64) / max(r["n"], 1))) - 2**63, 2**63 - 1)) for r in sizes]
    limits = labelled.sparkSession.createDataFrame(limits, "l string, most long")
    texts = rows.join(F.broadcast(limits), (F.col("lang") == F.col("l")) & (F.col("h") <= F.col("most")))
    texts = texts.groupBy("lang", "h").agg(F.min("text").alias("text"))
    samples: dict[str, list[np.ndarray]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"])):
        c = characters(r["text"])
        if len(c) > 1 and len(samples.setdefault(r["lang"], [])) < each:
            samples[r["lang"]].append(c)
    return fit_models(samples, order)


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected.

    lang_pred is ``und``, with score 0 and rejected, where the text is null or has no letter. A text over its language's
    calibrated threshold is rejected too, but keeps its prediction. Ties go to the first language by name. Columns of
    ``docs`` with one of the four names give way; use :func:`recognised` to keep them.
    """
    hidden, names = hide(docs)
    out = _identified(hidden, names["text"], models)
    kept = [c for c in docs.columns if c not in _ADDED]
    return out.select(*(F.col(names[c]).alias(c) for c in kept), *_ADDED)


def recognised(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of ``docs`` that :func:`identify` does not reject, with the columns of ``docs``, whatever their names."""
    hidden, names = hide(docs)
    return _identified(hidden, names["text"], models).filter("not rejected").select(*names.values()).toDF(*docs.columns)


_ADDED = ("lang_pred", "score", "cross_entropy", "rejected")


def _identified(hidden: DataFrame, text: str, models: Models) -> DataFrame:
    held = hidden.sparkSession.sparkContext.broadcast(models)

    def make():
        models = held.value
        names = [*models.langs, "und"]

        def step(b):
            found = [models.decide(characters(t)) for t in b.column(text).to_pylist()]
            out = {c: b.column(c) for c in b.schema.names}
            return out | {"lang_pred": [names[f[0]] for f in found]} | {c: [f[k] for f in found] for k, c in enumerate(_ADDED) if k}

        return step

    return arrow_map(hidden, make, f"{ddl(hidden)}, lang_pred string, score double, cross_entropy double, rejected boolean")
