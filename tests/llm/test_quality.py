"""The line field against sums over all labellings, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillstone.llm import quality
from quillstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
GOOD = ["The cat sat on the mat and looked at the sea.", "Rain fell over the hills all night long.", "We met again, after a while, in the old town."]
BAD = ["BUY!! NOW!! BUY!! NOW!!", "home | about | links | login | home", "zz### qq$$$ rr%%% zz###"]


def brute(evidence, tie):
    """(P(good), P(equal to the line before), log partition) of one chain by all of its labellings."""
    n = len(evidence)
    total, good, same = 0.0, np.zeros(n), np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        equal = np.array([0, *(a == b for a, b in zip(labels, labels[1:], strict=False))])
        mass = np.exp(np.dot(labels, evidence) + tie * equal.sum())
        total += mass
        good += mass * np.array(labels)
        same += mass * equal
    return good / total, same / total, np.log(total)


def test_marginals_of_chains_of_any_length():
    rng = np.random.default_rng(1)
    size = np.array([3, 0, 1, 7, 2, 7, 0, 5])
    first = np.cumsum(size) - size
    evidence, tie = rng.normal(0, 2, size.sum()), 0.8
    p, same, logz = quality.marginals(evidence, tie, first, size)
    for at, n, z in zip(first, size, logz, strict=True):
        if n:
            want = brute(evidence[at : at + n], tie)
            assert np.allclose(p[at : at + n], want[0]) and np.allclose(same[at : at + n], want[1]) and np.isclose(z, want[2])


def test_marginals_of_strong_evidence_stay_finite():
    p, same, logz = quality.marginals(np.array([900.0, -900.0, 5.0]), 3.0, np.array([0]), np.array([3]))
    assert np.isfinite(p).all() and np.isfinite(same).all() and np.isfinite(logz).all() and p[0] > 0.99 > 0.01 > p[1]


def test_a_fit_is_a_maximum():
    rng = np.random.default_rng(2)
    chains = [rng.integers(0, 3, (rng.integers(1, 6), len(quality.BOUNDS))).astype(np.uint8) for _ in range(60)]
    good = np.array([int(x[:, 0].mean() + rng.normal(0, 0.7) > 1) for x in chains])
    model = quality.fit(chains, good, 0.5, steps=1500)
    size = np.array([len(x) for x in chains])
    first = np.cumsum(size) - size
    at = quality._around(np.concatenate(chains), first)

    def likelihood(w, bias, tie):
        e = quality._evidence(quality.Field(w, bias, tie, 0.5), at)
        _, _, z = quality.marginals(e, tie, first, size)
        told = sum((e[a : a + n].sum() if y else 0) + tie * (n - 1) for a, n, y in zip(first, size, good, strict=True))
        return told - z.sum() - 0.5 * ((w**2).sum() + bias**2 + tie**2)

    best = likelihood(model.weights, model.bias, model.tie)
    for _ in range(20):
        step = rng.normal(0, 0.05, model.weights.shape)
        assert likelihood(model.weights + step, model.bias, model.tie) < best
    assert likelihood(model.weights, model.bias + 0.1, model.tie) < best and likelihood(model.weights, model.bias, model.tie - 0.1) < best


def test_lines_keep_the_whole_text():
    text = "a" * 10_000 + "\n\n \n" + "b c\r\n" + "x y" * 3
    assert "".join(quality.lines_of(text)) == text.replace("\n\n \n", "").replace("\n", "") and max(map(len, quality.lines_of(text))) == quality.LINE_CHARS
    assert quality.lines_of(None) == quality.lines_of("") == quality.lines_of(" \n\t\n") == []


def test_bins_do_not_depend_on_company():
    rng = random.Random(4)
    texts = ["\n".join(rng.choices(GOOD + BAD + ["", "é" * 5, "one", "ﷺ 12 34"], k=rng.randrange(9))) for _ in range(50)] + [None, "word " * 60_000]
    reader = quality.LineReader()
    together = list(reader.documents(texts))
    for text, (bins, size) in zip(texts, together, strict=True):
        (alone, own), = reader.documents([text])
        assert (alone == bins).all() and (own == size).all()


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(6)
    docs = [(k, "\n".join(rng.choices(GOOD if k % 3 else BAD, k=5))) for k in range(150)]
    labels = [(k, int(k % 3 > 0)) for k in range(150)] + [(0, None), (1, 7), (None, 1), (900, 0)]
    return quality.train(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int"))


def test_scores(spark, model):
    texts = ["\n".join(GOOD), "\n".join(BAD), None, "", " \n ", "\n".join(GOOD * 3000), "\n".join(BAD * 3000), "\n".join(GOOD)]
    rows = spark.createDataFrame([(k, t, "s", k) for k, t in enumerate(texts)], "doc_id bigint, text string, score string, c0 int")
    got = {r["doc_id"]: r for r in quality.score(rows, model).collect()}
    s = [got[k]["score"] for k in range(len(texts))]
    assert all(0 <= x <= 1 for x in s) and s[0] > 0.9 and s[1] < 0.1 and s[5] > 0.9 and s[6] < 0.1
    assert s[2] == s[3] == s[4] == model.prior and 0.6 < model.prior < 0.72 and s[7] == s[0]
    assert all(got[k]["c0"] == k and got[k]["text"] == texts[k] for k in got)
    assert quality.score(rows.limit(0), model).collect() == []


def test_mixed_documents_lie_between(spark, model):
    mixed = "\n".join(GOOD * 4 + BAD * 4)
    got = quality.score(spark.createDataFrame([(mixed,)], "text string"), model).first()["score"]
    assert 0.2 < got < 0.95


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "One line.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()] == [0.5]


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_line_quality"](spark, SF).collect()}
    quality_of = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    ids = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist()
    assert sorted(got) == sorted(ids) and all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in ids)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [k for k in quality_of if got[k]["held_out"]]
    right = sum(got[k]["predicted"] == quality_of[k] for k in held)
    assert len(held) > 50 and right / len(held) >= 0.95
    good = [k for k in held if quality_of[k] == 1]
    assert sum(got[k]["predicted"] for k in good) / len(good) >= 0.98
