"""Vector operators against exact cosines; language-model scores against plain counts and sums to one."""

import math
import random
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import ann, binary_codes, lm_scoring

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def vectors(n=600, dim=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    for k in range(0, 120, 3):  # near copies, exact copies, copies of another length
        x[k + 1] = x[k] + r.normal(0, 0.03, dim)
        x[k + 2] = x[k] * 2
    x[300:380] = x[300] + r.normal(0, 0.05, (80, dim))
    rows = [(k, v.tolist(), k // 3 % 4 if k < 300 else 0, "x") for k, v in enumerate(x)]
    rows += [(9000, None, 0, "x"), (9001, [0.0] * dim, 0, "x"), (9002, [float("nan")] * dim, 0, "x"), (9003, [None] + [1.0] * (dim - 1), 0, "x"), (9004, rows[0][1], None, "x"), (9005, [float("inf")] + [1.0] * (dim - 1), 0, "x")]
    return rows


def usable(v):
    return v is not None and None not in v and all(map(math.isfinite, v)) and any(v)


@pytest.mark.parametrize("block", [1024, 40])
def test_links_equal_all_pairs(spark, block):
    rows = vectors()
    good = [(i, np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)), lab) for i, v, lab, _ in rows if usable(v) and lab is not None]
    root, n = {r[0]: r[0] for r in rows}, Counter()
    near = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and a[1] @ b[1] >= 0.98]
    for a, b in near:
        n[a] += 1
        n[b] += 1
    for _ in range(100):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    got = binary_codes.near_links(spark.createDataFrame(rows, SCHEMA), block_rows=block).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], n[r[0]], root[r[0]], root[r[0]] == r[0]) for r in rows)


def test_links_of_empty_and_equal_rows(spark):
    assert binary_codes.near_links(spark.createDataFrame([], SCHEMA)).collect() == []
    none = binary_codes.near_links(spark.createDataFrame([(1, None, 0, "x"), (2, [0.0], 0, "x")], SCHEMA)).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 1, True), (2, 0, 2, True)]
    same = binary_codes.near_links(spark.createDataFrame([(k, [1.0, 2.0], 0, "x") for k in (3, 1, 2, 2)], SCHEMA)).collect()
    assert sorted(map(tuple, same)) == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False)]


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(0)
    x, q = ann.unit(r.standard_normal((4000, 32))), ann.unit(r.standard_normal((4000, 32)))
    q = ann.unit(x * 0.8 + q * 0.6)
    turn = binary_codes.rotation(32, 256, 5).T
    a, b = x @ turn, q @ turn
    assert np.allclose(np.linalg.norm(a, axis=1), 1)
    about, error = binary_codes.estimates(b, np.sign(a), np.abs(a).sum(1) / 16)
    miss = about - (x * q).sum(1)
    assert abs(miss.mean()) < 0.005 and (np.abs(miss) < 5 * error).all() and error.mean() < 0.1
    bits, bands = binary_codes.banding(10**6, 0.98)
    assert (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** bands <= binary_codes.MISS


def test_recall_and_edges_of_the_index(spark):
    rows = vectors(3000, 32, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), block_rows=700, query_rows=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v, *_ in rows if usable(v)}
    ids = np.array(list(good))
    x = np.array(list(good.values()))
    found = 0
    asked = [i for i in good if i % 50 == 0]
    assert set(got) == set(asked)
    for i in asked:
        s = x @ good[i]
        best = [j for j in np.lexsort((ids, -s.round(12))) if ids[j] != i][:5]
        found += len({int(ids[j]) for j in best} & {v for v, _ in got[i]})
        assert len(got[i]) == 5 and i not in dict(got[i]) and [v[1] for v in got[i]] == sorted((v[1] for v in got[i]), reverse=True)
        assert all(math.isclose(s[np.flatnonzero(ids == v)[0]], c, abs_tol=1e-12) for v, c in got[i])
    assert found >= 0.9 * 5 * len(asked)


def test_index_with_few_rows(spark):
    df = spark.createDataFrame([(k, [1.0, float(k % 2)], 0, "x") for k in (50, 1, 2)], SCHEMA)
    got = ann.nearest(df, df.filter("vec_id = 50")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 2), (2, 1)]
    same = spark.createDataFrame([(k, [1.0, 2.0], 0, "x") for k in range(100)], SCHEMA)
    got = ann.nearest(same, same.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]
    assert ann.nearest(same.limit(0), same).collect() == []


def corpus():
    r = random.Random(2)
    words = [f"w{k}" for k in range(80)] + ["É", "x" * 100]

    def text():
        w = [r.choice(words)]
        for _ in range(r.randint(0, 80)):  # every word has favourites
            last = words.index(w[-1]) if w[-1] in words else 0
            w.append(words[(last * 7 + r.choice([1, 1, 1, 2, 3])) % len(words)] if r.random() < 0.8 else f"rare{r.randrange(3000)}")
        return r.choice([" ", "\n", "\t "]).join(w).replace("w1", "W1")
    return [(k, text()) for k in range(400)] + [(900, None), (901, ""), (902, "never seen at all"), (1, "w1 w1"), (903, "w1 " * 20_000)]


@pytest.mark.parametrize("head", [300_000, 40])
def test_scores(spark, head):
    rows = corpus()
    training = [(d, t) for d, t in rows if d % 5 != 1]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string")
    got = lm_scoring.score_documents(df, df.filter("doc_id % 5 <> 1"), vocabulary=64, head=head).collect()
    split = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").replace("\n", " ").replace("\t", " ").split()
    c = Counter(w for _, t in training for w in split(t))
    c["\0end"] = len(training)
    total, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        w = [*split(t), "\0end"]
        want.append((d, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w)))
    key = lambda r: (r[0], r[1])
    for g, x in zip(sorted(got, key=lambda r: (r["doc_id"], r["n_tokens"])), sorted(want, key=key), strict=True):
        assert (g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"]) == x[:4] and math.isclose(g["base_score"], x[4], rel_tol=1e-9)
        assert g["score"] < 0 and g["word"] == "x"
    held = [g for g in got if g["doc_id"] % 5 == 1 and g["doc_id"] < 900]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)  # a language model beats the unigram on held-out texts


def test_probabilities_sum_to_one():
    share = np.random.default_rng(1).dirichlet(np.ones(50))
    m = lm_scoring.LogBilinear(share, dim=8)
    m.c1 += np.eye(8, dtype=np.float32)
    m.c2 -= 0.5
    s = lm_scoring.Scorer(m)
    for a, b in ((0, 1), (7, 7), (49, 3)):
        assert math.isclose((10 ** s.log10(np.full(50, a), np.full(50, b), np.arange(50))).sum(), 1, rel_tol=1e-4)


def test_contexts():
    one, two = lm_scoring.contexts(np.array([5, 6, 0, 7, 0, 0, 8]), np.array([2, 4, 5]))
    assert one.tolist() == [0, 5, 6, 0, 7, 0, 0] and two.tolist() == [0, 0, 5, 0, 0, 0, 0]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(df, df.limit(0)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0.0 and got[1]["n_known"] == 0
    assert lm_scoring.score_documents(df.limit(0), df).collect() == []


def trained(monkeypatch, share, data):
    """What a task gives that trains on these texts of words that are numbers from 2 on."""
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    index = {str(k).encode(): k for k in range(2, len(share))}
    flat = lm_scoring.LogBilinear(share).flat()
    held = SimpleNamespace(value=(index, share, flat))
    before = time.process_time()
    got = list(lm_scoring.one_round(held, 0)([pa.RecordBatch.from_arrays([pa.array(data)], ["text"])]))
    took = time.process_time() - before
    return took, got[0].column(0)[0].as_py(), np.array(got[0].column(1)[0].as_py(), np.float32)


def plainly(share, data):
    """The same by gradients of all parameters, token by token as they come, with all noise words apart."""
    m = lm_scoring.LogBilinear(share)
    par = [x.astype(np.float64) for x in (m.q, m.r, m.c1, m.c2, m.bias)]
    q, r, c1, c2, bias = par
    sums = [np.full(x.shape, 1e-3) for x in par]
    draw, cdf, lift = np.random.default_rng(lm_scoring.SEED), np.cumsum(m.noise, dtype=np.float64), np.log(lm_scoring.NOISE * m.noise)
    tokens = []
    for t in data:
        w = [0, 0, *(int(x) if x.isdigit() else 1 for x in (t or "").split()), 0]
        tokens += [(w[k - 1], w[k - 2], w[k]) for k in range(2, len(w))]
    for at in range(0, len(tokens), lm_scoring.BATCH):
        a, b, w = np.array(tokens[at : at + lm_scoring.BATCH]).T
        z = np.minimum(np.searchsorted(cdf, draw.random(lm_scoring.NOISE) * cdf[-1]), len(cdf) - 1)
        h = q[a] @ c1 + q[b] @ c2
        up = 1 / (1 + np.exp(-((h * r[w]).sum(1) + bias[w] - lift[w]))) - 1
        down = 1 / (1 + np.exp(-(h @ r[z].T + bias[z] - lift[z])))
        dh = up[:, None] * r[w] + down @ r[z]
        grad = [np.zeros_like(x) for x in par]
        np.add.at(grad[0], a, dh @ c1.T)
        np.add.at(grad[0], b, dh @ c2.T)
        np.add.at(grad[1], w, up[:, None] * h)
        np.add.at(grad[1], z, down.T @ h)
        grad[2] += q[a].T @ dh
        grad[3] += q[b].T @ dh
        np.add.at(grad[4], w, up)
        np.add.at(grad[4], z, down.sum(0))
        for x, s, g in zip(par, sums, grad, strict=True):
            s += (g / len(w)) ** 2
            x -= lm_scoring.RATE * g / len(w) / np.sqrt(s)
    return len(tokens), np.concatenate([x.ravel() for x in par])


@pytest.mark.parametrize("data", [
    [None],
    ["", "7", None, "2 2 2", "nowhere 5"],
    [" ".join(str(3 + (k * j) % 90) for k in range(j * 7 % 800)) for j in range(60)],
    [f"{k % 97 + 2}" for k in range(700)],
])
def test_training_equals_plain_gradients(monkeypatch, data):
    share = 1 / np.arange(1.0, 101)
    share[1] = 2.0  # most noise words are drawn several times
    share /= share.sum()
    _, seen, got = trained(monkeypatch, share, data)
    n, want = plainly(share, data)
    assert seen == n and np.allclose(got, want, rtol=1e-3, atol=1e-4)


def test_training_time_does_not_follow_the_vocabulary(monkeypatch):
    text = " ".join(str(2 + k * 7 % 400) for k in range(40 * lm_scoring.BATCH))

    def each(v):
        share = np.r_[np.full(400, 1.0), np.full(v - 400, 1e-9)]
        share /= share.sum()
        return min(trained(monkeypatch, share, [text])[0] for _ in range(3)) - min(trained(monkeypatch, share, ["2"])[0] for _ in range(3))

    assert each(40_000) < 4 * each(500)


def test_runs_of_texts_by_size():
    data = [b"a" * n for n in (3, 3, 20, 0, 4, 6, 1)]
    got = list(lm_scoring.by_size(data, 10))
    assert [[len(t) for t in run] for run in got] == [[3, 3], [20], [0, 4, 6], [1]]
    assert list(lm_scoring.by_size([])) == []
