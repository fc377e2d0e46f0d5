"""SimHash near-dedup against comparing every two fingerprints."""

import random

import numpy as np
import pytest
import xxhash

from quillstone.llm import simhash
from quillstone.llm.links import components

SCHEMA = "doc_id long, text string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def fingerprint(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius):
    fp = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, fp[i], low.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus():
    r = random.Random(7)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(1, 200))] for _ in range(40)]
    rows = []
    for k in range(300):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((k, " ".join(w)))
    return [*rows, (900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "a b C"), (3, rows[3][1]), (None, rows[5][1]), (907, "word " * 30000)]


@pytest.mark.parametrize(("radius", "partitions"), [(3, None), (3, 2), (3, 3), (5, 4)])
def test_equals_comparing_all(spark, radius, partitions):
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), radius=radius, partitions=partitions)
    assert sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got.collect()), key=repr) == brute(rows, radius)


def test_groups_over_a_block(spark):
    fps = [0x0F0F0F0F0F0F0F0F ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = simhash.link_fingerprints(df, block_rows=100)
    assert components(edges).agg({"component": "min", "*": "count"}).first()[1] == len(fps)
    assert components(edges).select("component").distinct().count() == 1


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_thresholds_cover_the_radius():
    cost = np.array([[5.0, 9, 30, 99], [1, 2, 3, 4], [50, 60, 70, 80]])
    t = simhash.thresholds(cost, 3)
    assert sum(x + 1 for x in t) == 4 and t == [-1, 3, -1]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(80)]
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {n: root[n] for a, b in edges if a != b for n in (a, b)}
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
