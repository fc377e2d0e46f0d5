"""Suffix-array dedup against counting every string."""

import hashlib
import random
from collections import Counter

import pytest

from quillstone.llm import suffix_dedup
from quillstone.llm.suffix_sort import equal_classes

SCHEMA = "doc_id long, text string, source string"


def brute(rows, length):
    data = [(t or "").encode() for _, t, *_ in rows]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, *_), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((doc, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéö") for _ in range(r.randint(1, 9))) for _ in range(200)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, copy = prose(90), prose(150)
    rows = [(k, prose(r.randint(0, 120)) + passage[: r.choice([200, 450, 900])] + prose(r.randint(0, 60)), "s") for k in range(60)]
    rows += [(100 + k, copy if k % 3 else copy.replace("a", "b", k), "s") for k in range(12)]
    rows += [(200, None, "s"), (201, "", None), (202, "z" * 1000, "s"), (203, "xy" * 450, "s"), (203, "xy" * 450, "s"), (None, copy[50:700], "s"), (204, "a" * 399, "s"), (205, prose(20) + "line one two three\n" * 60, "s")]
    return rows


@pytest.mark.parametrize("group_records", [512, 3])
@pytest.mark.parametrize("length", [400, 64])
def test_equals_counting_every_string(spark, length, group_records):
    rows = corpus()
    got = suffix_dedup.cut_texts(spark.createDataFrame(rows, SCHEMA), length=length, group_records=group_records)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute(rows, length)


def test_empty_table(spark):
    assert suffix_dedup.cut_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_drop_repeats_keeps_columns_and_whole_characters(spark):
    rows = corpus()
    more = ("spans", "doc", "marks", "text_hash", "c0", "at", "row")
    docs = spark.createDataFrame([(a, b, c, 0, *more) for a, b, c in rows], SCHEMA + ", n_chars long, " + ", ".join(f"{m} string" for m in more))
    got = suffix_dedup.drop_repeats(docs, length=400, words=0).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "source", "n_chars", *more]
    assert all(tuple(r)[4:] == more for r in got)
    assert all((r["text"] is None) or r["n_chars"] == len(r["text"]) for r in got)
    lost = sum(len((t or "").encode()) for _, t, _ in rows) - sum(len((r["text"] or "").encode()) for r in got)
    assert 0 <= sum(x[2] for x in brute(rows, 400)) - lost < 4 * len(rows)
    told = suffix_dedup.removed_spans(docs).collect()
    assert sorted(repr(r["row"]["doc_id"]) for r in told) == sorted(repr(r[0]) for r in rows)


def test_passages_of_fifty_words_go_and_shorter_repeats_stay(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, short = prose(51), prose(45)
    rows = [(k, f"{prose(r.randint(30, 90))} {long if k % 2 else short} {prose(40)}", "s") for k in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeats(docs).collect()}
    for k, text, _ in rows:
        assert got[k].split() == (text.replace(long, "") if k % 2 else text).split()
    told = {r["doc_id"]: (r["n_passages"], r["passage_words"], r["text"]) for r in suffix_dedup.cut_texts(docs).collect()}
    assert all(told[k][:2] == ((1, 51) if k % 2 else (0, 0)) and (told[k][2] == t or len(long) >= 400) for k, t, _ in rows)


def test_deep_shallow_sort_orders_and_equates():
    r = random.Random(3)
    text = bytes(r.choice(b"ab") for _ in range(300)) + bytes(300) + b"ab" * 200
    at = [r.randrange(len(text) - 100) for _ in range(400)]
    group = [r.randrange(3) for _ in at]
    import numpy as np

    label = equal_classes(text, np.array(at), np.array(group), 100).tolist()
    keys = [(g, text[a : a + 100]) for g, a in zip(group, at, strict=True)]
    assert len(set(zip(label, keys, strict=True))) == len(set(label)) == len(set(keys))
