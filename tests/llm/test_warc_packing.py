"""WARC archives and SentencePiece by round trip and the library; packing by its rules."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.llm import packing, sentence_pieces, warc
from quillstone.llm.queries import tokenizer_file, word_spec

PAGES = "page_id long, url string, html string, payload string"


def pages():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abc é<>\r\n\u0000日") for _ in range(n))
    rows = [(k, f"http://h/{k} x\n", text(r.choice([0, 1, 50, 3000, 40_000])), "p") for k in range(40)]
    rows += [(100 + k, "http://copy", rows[5][2] + "same", "p") for k in range(9)]
    return rows + [(200, None, None, None), (201, "u", "", "p"), (None, "u", rows[5][2] + "same", "p"), (3, *rows[3][1:])]


@pytest.mark.parametrize(("segment", "least"), [(16_384, 0), (700, 0), (700, 100)])
def test_warc_round_trip(spark, segment, least):
    rows = pages()
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, PAGES), least, segment).collect()), key=repr)
    first = {}
    for p, _, h, _ in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h, _ in rows:
        data = (h or "").encode()
        visits = len(data) >= least and p != first.get(h or "", p)
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if visits else "response", first[h or ""] if visits else None, True))
    assert got == sorted(want, key=repr)


def test_warc_damage(spark):
    data = spark.createDataFrame([(1, "u", "x" * 5000, "p")], PAGES)
    records = warc.read_records(warc.write_archives(data, segment_bytes=1000))
    assert records.count() > 3 and warc.reassemble(records).first()["complete"]
    for bad in (records.filter("number is null or number <> 3"), records.withColumn("total", F.lit(None).cast("long")), records.withColumn("digest", F.lit("A" * 32))):
        assert [(r["payload"], r["complete"]) for r in warc.reassemble(bad).collect()] == [(None, False)]
    twice = records.unionByName(records.filter("type = 'continuation'"))  # segments count once, in any order
    assert warc.reassemble(twice.orderBy(F.desc("number"))).first()["payload"].decode() == "x" * 5000
    assert warc.round_trip(data.limit(0)).collect() == []


def documents():
    r = random.Random(6)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 9))) for _ in range(300)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 40, 300, 900])))) for k in range(200)]
    odd = ["don't STOP, it's İstanbul ß 12.5", "日本語 \U0001f600 é <|endoftext|>", "x" * 3000, "\x00\x1c\x85 a", "  "]
    return rows + [(300 + k, t) for k, t in enumerate(odd)] + [(400, None), (401, ""), (0, rows[0][1]), (None, "null id"), (402, "long " * 9000)]


@pytest.mark.parametrize("capacity", [2048, 128])
def test_packing(spark, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(word_spec())
    t.encode_special_tokens = True
    rows = documents()
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), word_spec(), capacity).collect()
    want = Counter()
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[doc, k // capacity, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // capacity) * 1.02 + 2


def test_plans_over_many_shapes():
    r = random.Random(8)
    for trial in range(40):
        cap = r.choice([10, 64, 2048])
        counts = {r.randint(1, cap): r.choice([1, 2, 7, 1000, 10**7]) for _ in range(r.randint(1, 60))}
        rows = packing.plan_packing(counts, cap, groups=r.choice([1, 4, 16]), small=r.choice([None, 0, cap]))
        placed, ranks = Counter(), Counter()
        for n, first, k, sequence, offset in rows:
            placed[n] += k
            assert k > 0 and sequence >= 0 and 0 <= offset <= cap - n
            ranks[n] = max(ranks[n], first + k)
        assert placed == ranks == Counter(counts)
        if sum(counts.values()) < 20_000:
            used = Counter()
            for n, _, k, sequence, _ in rows:
                for j in range(k):
                    used[sequence + j] += n
            assert max(used.values()) <= cap and set(used) == set(range(len(used)))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, word_spec()).collect() == []
    assert sentence_pieces.encode_documents(empty, proto()).collect() == []


def proto():
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_pieces_equal_the_library(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=proto())
    rows = documents() + [(500, "▁x ▁ y"), (501, "ab" * 500), (502, "<s> <0x41>"), (503, "\t\n two  spaces   ")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_ids int")
    got = sentence_pieces.encode_documents(df, proto(), ids=True)
    assert sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=repr) == sorted(((d, m.encode(t or "")) for d, t in rows), key=repr)
    assert all(r["round_trip"] for r in got.collect() if r["doc_id"] != 500)
    back = {r["doc_id"]: r["text"] for r in sentence_pieces.decode_documents(got, proto()).collect()}
    assert all(back[d] == (t or "") for d, t in rows if d not in (500, 0))


def test_suffix_array_and_occurrences():
    import numpy as np

    text = "abracadabra" * 3
    codes = np.array([ord(c) for c in text])
    order = sentence_pieces.suffix_array(codes, 16)
    assert [text[i : i + 16] for i in order] == sorted(text[i : i + 16] for i in range(len(text)))
    pieces = ["a", "abra", "bracad", "zz", "ra"]
    table = np.full((len(pieces), 6), -1)
    for k, p in enumerate(pieces):
        table[k, : len(p)] = [ord(c) for c in p]
    low, high = sentence_pieces.occurrences(codes, order, table, np.array([len(p) for p in pieces]))
    assert [sorted(order[a:b].tolist()) for a, b in zip(low, high, strict=True)] == [[i for i in range(len(text)) if text.startswith(p, i)] for p in pieces]
