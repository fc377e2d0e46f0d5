"""Language-model scoring by a log-bilinear neural model trained with noise-contrastive estimation.

Word counts over all training documents give the unigram base. The log-bilinear model predicts a target vector from
the two tokens before it: score(w | a, b) = (q_a C1 + q_b C2) . r_w + bias_w, over the ``VOCABULARY`` most frequent
tokens, the end of a text, and one token for all other words. It starts at the unigram distribution and learns, by
noise-contrastive estimation in numpy, from every training token, ``ROUNDS`` times: in a round each partition trains
from the same parameters over its own documents, and the next round starts from their mean by tokens seen. A round
brings less the more partitions share a given text, so scores depend somewhat on the number of partitions.

Probabilities are normalised exactly: as the score is a sum of a term of each context token, the normalisers of all
contexts are one matrix product, exp(S1) @ exp(S2 + bias)'. A word outside the vocabulary has the probability of "other"
times its smoothed share of the other words.

Counts are exact and cover all words: the most frequent ones, at most ``HEAD_WORDS``, are broadcast; occurrences of the
rest are joined with their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, hide_but, slices, texts

VOCABULARY = 2048
DIM = 24
#: Bound of the broadcast counts; a word over 64 bytes is never among them.
HEAD_WORDS = 300_000
HEAD_BYTES = 64
NOISE = 64
BATCH = 512
ROUNDS = 2
RATE = 0.15
SEED = 11
END, OTHER = 0, 1


def tokens(text: bytes) -> list[bytes]:
    """Words without ASCII white space, A-Z in lower case; the end of the text is not among them."""
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n of all rows' texts, one row for each distinct word."""

    def count(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in slices(batches):
            for t in texts(b.column(0)):
                held.update(tokens(t))
            if len(held) > 300_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int = HEAD_WORDS) -> list[tuple[bytes, int]]:
    """The most frequent words: all from a count on, so many that they are at most ``most``. Most frequent first."""
    short = counts.filter(F.octet_length("word") <= HEAD_BYTES)
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")  # a few hundred steps at any size
    left, least = most, None
    for r in sorted(short.groupBy(step).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    if least is None:
        return []
    rows = short.filter(F.floor(F.log2("n") * 8).cast("int") >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


class LogBilinear:
    """Parameters of the model over ``v`` tokens."""

    def __init__(self, share: np.ndarray, dim: int = DIM, seed: int = SEED):
        r, v = np.random.default_rng(seed), len(share)
        self.noise = share.astype(np.float32)
        self.q = r.normal(0, 0.3, (v, dim)).astype(np.float32)
        self.r = r.normal(0, 0.3, (v, dim)).astype(np.float32)
        self.c1 = np.zeros((dim, dim), np.float32)
        self.c2 = np.zeros((dim, dim), np.float32)
        self.bias = np.log(share).astype(np.float32)

    NAMES = ("q", "r", "c1", "c2", "bias")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for n in self.NAMES:
            have = getattr(self, n)
            setattr(self, n, flat[at : at + have.size].reshape(have.shape).astype(np.float32))
            at += have.size
        return self

    def scorer(self) -> Scorer:
        """Its normalised scores, made once: a worker that keeps the broadcast model keeps them for all of its tasks."""
        if not hasattr(self, "_scorer"):
            self._scorer = Scorer(self)
        return self._scorer


class Trainer:
    """Noise-contrastive estimation by AdaGrad, a batch at a time; the noise words of a batch are shared by its tokens.

    Only the rows of tokens that a batch meets have a gradient, and only they are read, summed and written. A row holds a
    token's target vector, its bias less the log of its noise, and its context vector, so that tokens are sorted once for
    all three. A noise word drawn several times is computed once and counts as often.
    """

    def __init__(self, model: LogBilinear, seed: int):
        self.m, self.random = model, np.random.default_rng(seed)
        self.cdf = np.cumsum(model.noise, dtype=np.float64)
        self.lift = np.log(NOISE * model.noise)
        self.rows = np.concatenate((model.r, (model.bias - self.lift)[:, None], model.q), 1)
        self.mix = np.concatenate((model.c2, model.c1))
        self.row_sums, self.mix_sums = (np.full(x.shape, 1e-3, np.float32) for x in (self.rows, self.mix))
        self.small = np.uint16 if len(model.bias) <= 1 << 16 else np.int64  # sorted by radix
        self.end = np.array([END], self.small)
        self.seen = 0

    def learn(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Trains on whole texts, as :func:`numbered` gives them."""
        n = -(-len(ids) // BATCH)
        noise = np.minimum(np.searchsorted(self.cdf, self.random.random((n, NOISE)) * self.cdf[-1]), len(self.cdf) - 1).astype(self.small)
        noise.sort(1)
        new = np.ones(noise.shape, bool)
        np.not_equal(noise[:, 1:], noise[:, :-1], out=new[:, 1:])
        drawn = np.r_[0, np.cumsum(new.sum(1))]
        times = np.diff(np.flatnonzero(new), append=noise.size).astype(np.float32)
        noise = noise[new]
        run = np.r_[END, END, ids].astype(self.small)
        # a text's end is the token before the next text, so of the contexts only the second of a first word is not the run's
        starts = ends[:-1] + 1
        split = np.searchsorted(starts, np.arange(n + 1) * BATCH)
        with np.errstate(over="ignore"):  # exp of much is infinite, its sigmoid 0
            for k in range(n):
                z = slice(drawn[k], drawn[k + 1])
                self._batch(run[k * BATCH : (k + 1) * BATCH + 2], starts[split[k] : split[k + 1]] - k * BATCH, noise[z], times[z])
        self.seen += len(ids)

    def _batch(self, run: np.ndarray, starts: np.ndarray, noise: np.ndarray, times: np.ndarray) -> None:
        """Trains on ``run`` but its first two tokens, of which first words have the places ``starts``; ``times``: of each noise word."""
        d, n = len(self.mix) // 2, len(run) - 2
        rows = np.concatenate((run, noise, self.end))  # the last one takes what first words give to their second context
        have = self.rows.take(rows, 0)
        q = np.empty((n, 2 * d), np.float32)
        q[:, :d], q[:, d:] = have[:n, d + 1 :], have[1 : n + 1, d + 1 :]
        q[starts, :d] = have[-1, d + 1 :]
        h = np.ones((n, d + 1), np.float32)
        np.matmul(q, self.mix, out=h[:, :d])
        rw, rz = have[2 : n + 2, : d + 1], have[n + 2 : -1, : d + 1]
        up = -1 / (1 + np.exp(np.einsum("ij,ij->i", h, rw)))
        down = h @ -rz.T
        np.exp(down, out=down)
        down += 1
        np.divide(times, down, out=down)
        dh = down @ rz[:, :d]
        dh += up[:, None] * rw[:, :d]
        dq = dh @ self.mix.T
        grad = np.zeros_like(have)
        np.multiply(up[:, None], h, out=grad[2 : n + 2, : d + 1])
        np.matmul(down.T, h, out=grad[n + 2 : -1, : d + 1])
        grad[1 : n + 1, d + 1 :] = dq[:, d:]
        grad[-1, d + 1 :] = dq[starts, :d].sum(0)
        dq[starts, :d] = 0
        grad[:n, d + 1 :] += dq[:, :d]
        at, grad = sums_by(rows, grad)
        total = self.row_sums.take(at, 0)
        step = self._step(total, grad, n)
        self.row_sums[at] = total
        self.rows[at] = self.rows.take(at, 0) - step
        self.mix -= self._step(self.mix_sums, q.T @ dh, n)

    def _step(self, sums: np.ndarray, grad: np.ndarray, n: int) -> np.ndarray:
        """AdaGrad's step by the gradient of ``n`` tokens; adds its squares to ``sums``."""
        grad *= np.float32(1 / n)
        sums += grad * grad
        grad *= np.float32(RATE)
        grad /= np.sqrt(sums)
        return grad

    def learnt(self) -> LogBilinear:
        """The model with what was learnt."""
        d = len(self.mix) // 2
        self.m.r, self.m.bias, self.m.q = self.rows[:, :d], self.rows[:, d] + self.lift, self.rows[:, d + 1 :]
        self.m.c2, self.m.c1 = self.mix[:d], self.mix[d:]
        return self.m


def sums_by(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct value of ``rows``, and the sum of ``grad`` over it; values that occur once are copied."""
    order = rows.argsort(kind="stable")
    x = rows[order]
    new = np.ones(len(x) + 1, bool)
    np.not_equal(x[1:], x[:-1], out=new[1:-1])
    alone = new[:-1] & new[1:]
    once, more = grad.take(order[alone], 0), order[~alone]
    if not len(more):
        return x, once
    first = new[:-1] & ~alone
    many = np.add.reduceat(grad.take(more, 0), np.flatnonzero(first[~alone]), axis=0)
    return np.concatenate((x[alone], x[first])), np.concatenate((once, many))


def contexts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before, and the one before that, of each token; END before a text. ends: places of the end tokens."""
    one = np.r_[END, ids[:-1]]
    two = np.r_[END, END, ids[:-2]][: len(ids)]
    start = np.r_[0, ends[:-1] + 1]
    one[start] = END
    two[start] = END
    second = start + 1
    two[second[second < len(ids)]] = END
    return one, two


class Scorer:
    """Exactly normalised log10-probabilities of a trained model."""

    def __init__(self, m: LogBilinear):
        self.s1 = ((m.q @ m.c1) @ m.r.T).astype(np.float32)
        self.s2 = ((m.q @ m.c2) @ m.r.T).astype(np.float32)
        self.bias = m.bias
        top1, top2 = self.s1.max(1, keepdims=True), (self.s2 + self.bias).max(1, keepdims=True)
        total = np.exp(self.s1 - top1) @ np.exp(self.s2 + self.bias - top2).T
        self.log_z = np.log(total) + top1 + top2.T

    def log10(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        v = len(self.bias)  # places in flat tables are read faster than rows and columns
        score = self.s1.ravel().take(one * v + w) + self.s2.ravel().take(two * v + w) + self.bias[w] - self.log_z.ravel().take(one * v + two)
        return (score / np.float32(np.log(10))).astype(np.float64)


def train_model(docs: DataFrame, index: dict[bytes, int], share: np.ndarray, rounds: int = ROUNDS) -> LogBilinear:
    """The model trained on all rows' texts; only its parameters come to the driver, once a round."""
    model = LogBilinear(share)
    for k in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast((index, share, model.flat()))
        shards = cut(docs.select("text").mapInArrow(one_round(held, k), "seen long, params array<float>"))
        place = shards.select("seen", F.posexplode("params").alias("at", "x"))
        mean = place.groupBy("at").agg((F.sum(F.col("x").cast("double") * F.col("seen")) / F.sum("seen")).alias("x")).collect()
        held.unpersist()
        if not mean:
            break
        flat = np.zeros(len(mean), np.float64)
        for r in mean:
            flat[r["at"]] = r["x"]
        model.load(flat)
    return model


def one_round(held, nth: int):
    """A task function that trains on its texts from the broadcast parameters; gives tokens seen and new parameters."""

    def fit(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        index, share, flat = held.value
        trainer = Trainer(LogBilinear(share).load(flat), SEED + 1_000_003 * nth + TaskContext.get().partitionId())
        for b in slices(batches, 1024):
            ids, ends = numbered(texts(b.column(0)), index)
            if len(ids):
                trainer.learn(ids, ends)
        if trainer.seen:
            yield pa.RecordBatch.from_arrays([pa.array([trainer.seen], pa.int64()), pa.array([trainer.learnt().flat()], pa.list_(pa.float32()))], ["seen", "params"])

    return fit


def numbered(data: list[bytes], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts' tokens, ends included, and the places of the ends. Words without an id: OTHER."""
    ids, ends, at = [], [], -1
    for t in data:
        w = tokens(t)
        ids += [index.get(x, OTHER) for x in w]
        ids.append(END)
        at += len(w) + 1
        ends.append(at)
    return np.array(ids, np.int64), np.array(ends, np.int64)


def by_size(data: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The same texts in runs of at most ``most`` bytes; a longer text is a run of its own."""
    run, size = [], 0
    for t in data:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def score_documents(docs: DataFrame, training: DataFrame, vocabulary: int = VOCABULARY, head: int = HEAD_WORDS) -> DataFrame:
    """All columns of ``docs`` but text, with n_tokens, n_known, train_tokens, base_score, score (log10) of the whole text.

    Null is the empty text, whose only token is its end. ``training`` has the texts to learn from (null: empty); without
    any, every token has probability 1. Equal texts score alike.
    """
    docs, shown = hide_but(docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score"), "text")
    names = [n for n in docs.columns if n != "text"]
    counts = cut(word_counts(training))
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    texts_n = training.count()
    total, distinct = (sums[0] or 0) + texts_n, sums[1] + (texts_n > 0)
    known = head_words(counts, head)
    least = known[-1][1] if known else None
    frequent = known[: vocabulary - 2]
    other_n, other_v = (sums[0] or 0) - sum(n for _, n in frequent), sums[1] - len(frequent)
    share = np.array([texts_n, other_n, *(n for _, n in frequent)], np.float64) + 0.5
    share /= share.sum()
    model = train_model(training, {w: k + 2 for k, (w, _) in enumerate(frequent)}, share)
    base = np.log10(total + 0.5 * (distinct + 1))
    outside = np.log10(other_n + 0.5 * (other_v + 1))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model, [w for w, _ in known], np.array([n for _, n in known], np.float64), len(frequent)))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.drop("text").dtypes)

    def make():
        from pyspark import TaskContext

        model, words, n, frequent = held.value
        scorer = model.scorer()
        rare, end = len(words), len(words) + 1  # places of a word that is not broadcast, and of a text's end
        place = {w: k for k, w in enumerate(words)}
        log_c = np.r_[np.log10(n + 0.5), 0.0, 0.0]
        number = np.r_[np.arange(2, frequent + 2), np.full(rare - frequent + 1, OTHER), END]
        # what log10(c + 0.5) adds to the model for words it has under OTHER
        under = np.where(number == OTHER, log_c - outside, 0.0)
        nth = TaskContext.get().partitionId() << 40

        def step(b):
            nonlocal nth
            out = {c: [] for c in (f"_lm_{c}" for c in ("row", "tokens", "known", "head", "model", "rare", "word", "times"))}
            for some in by_size(texts(b.column("text"))):
                flat, at, ends = [], [], []
                for t in some:
                    w = tokens(t)
                    flat += [*w, b""]
                    at.extend(map(place.get, w, repeat(rare)))
                    at.append(end)
                    ends.append(len(at) - 1)
                at, ends = np.array(at, np.int64), np.array(ends, np.int64)
                ids, starts = number[at], np.r_[0, ends[:-1] + 1]
                values = scorer.log10(*contexts(ids, ends), ids) + under[at]
                unknown = np.flatnonzero(at == rare)
                split = np.searchsorted(unknown, np.r_[starts, len(at)])
                unknown = unknown.tolist()
                met = [Counter(flat[k] for k in unknown[i:j]) for i, j in pairwise(split.tolist())]
                found = (
                    range(nth + 1, nth + 1 + len(some)), ends - starts + 1, np.add.reduceat((at < rare).astype(np.int64), starts),
                    np.add.reduceat(log_c[at], starts), np.add.reduceat(values, starts), np.diff(split), map(list, met), (list(c.values()) for c in met),
                )
                nth += len(some)
                for c, v in zip(out, found, strict=True):
                    out[c].extend(v.tolist() if isinstance(v, np.ndarray) else v)
            return out | {c: b.column(c) for c in names}

        return step

    found = cut(arrow_map(docs, make, f"{schema}{', ' * bool(schema)}_lm_row long, _lm_tokens long, _lm_known long, _lm_head double, _lm_model double, _lm_rare long, _lm_word array<binary>, _lm_times array<long>"))
    zipped = F.arrays_zip(F.col("_lm_word").alias("word"), F.col("_lm_times").alias("times"))
    rare = found.filter("_lm_rare > 0").select("_lm_row", F.explode(zipped).alias("w")).select("_lm_row", "w.word", "w.times")
    # every word that is not broadcast has a count under the least of those, or is long
    tail = counts.filter((F.octet_length("word") > HEAD_BYTES) | (F.col("n") < least)) if least is not None else counts
    c = F.coalesce("n", F.lit(0))
    met = rare.join(tail, "word", "left").groupBy("_lm_row")
    added = cut(met.agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("_lm_more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_lm_more_known")))
    end = float(np.log10(texts_n + 0.5))
    more = F.coalesce("_lm_more", F.lit(0.0))
    return found.join(added, "_lm_row", "left").select(
        *(F.col(v).alias(c) for c, v in shown.items() if c != "text"), F.col("_lm_tokens").alias("n_tokens"), (F.col("_lm_known") + F.coalesce("_lm_more_known", F.lit(0)) + F.lit(int(texts_n > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_lm_head") + more + F.lit(end) - F.col("_lm_tokens") * F.lit(float(base))).alias("base_score"), (F.col("_lm_model") + more).alias("score"),
    )
