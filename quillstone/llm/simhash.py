"""SimHash near-duplicates with a generalised pigeonhole search.

Fingerprints that differ in at most ``radius`` bits are linked. The 64 bits are divided into partitions; if the
partition thresholds t satisfy sum(t + 1) = radius + 1, then two fingerprints within the radius differ in at most t bits
in some partition. Correlated bits go to the same partition, and a dynamic programme picks the thresholds with the
fewest estimated candidates; a threshold of -1 leaves a partition out. Every candidate is verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, hide_but, texts
from .links import BLOCK_ROWS, components, in_blocks, over_blocks, roots, shifts

RADIUS = 3
#: Fingerprints (those of the smallest hashes) on which thresholds are estimated; they decide cost only, not results.
ESTIMATE_ROWS = 4096
#: What a probe costs, which is written, shuffled and sorted, in comparisons of two fingerprints in memory.
PROBE_COST = 256


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; see :func:`fingerprints`."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
    digest = xxhash.xxh64_digest
    total, n = np.zeros(64, np.int64), 0
    while part := b"".join([digest(s, seed) for s in itertools.islice(shingles, 1 << 16)]):
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``also`` and fp (long, the fingerprint's bits) of every row.

    A-Z are lower-cased, words are runs without ASCII white space, shingles of ``words`` words are joined by a space and
    hashed by XXH64. With fewer words the whole sequence is the shingle; without words (null, empty) the fingerprint is 0.
    """
    names = ["doc_id", *also]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def make():
        def step(b):
            found = np.array([fingerprint(t, words, seed) for t in texts(b.column(len(names)))], np.uint64)
            return {c: b.column(k) for k, c in enumerate(names)} | {"fp": found.view(np.int64)}

        return step

    return arrow_map(docs.select(*names, "text"), make, f"{kinds}, fp long")


def bit_partitions(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Equal partitions of the bits, correlated bits together. together[i, j]: rows with both bits set."""
    bits = len(together)
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, out = set(range(bits)), []
    for k in range(parts):
        size = (bits - len([b for part in out for b in part])) // (parts - k)
        part = [max(left, key=lambda b: (related[b, sorted(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (related[b, part].sum(), -b)))
            left.discard(part[-1])
        out.append(sorted(part))
    return out


def thresholds(cost: np.ndarray, radius: int) -> list[int]:
    """For each partition a threshold from -1 on, sum(t + 1) = radius + 1, least total cost[partition, t]."""
    parts, most = cost.shape
    best = {0: (0.0, [])}
    for k in range(parts):
        now: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, ts) in best.items():
            for t in range(-1, min(most, radius + 1 - spent)):
                to = (c + (cost[k, t] if t >= 0 else 0.0), [*ts, t])
                if spent + t + 1 not in now or to < now[spent + t + 1]:
                    now[spent + t + 1] = to
        best = now
    return best[radius + 1][1]


def spread_bits(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint, packed from the lowest on."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def within(size: int, t: int) -> Iterator[int]:
    """Masks of at most t of ``size`` bits."""
    for k in range(t + 1):
        for chosen in itertools.combinations(range(size), k):
            yield sum(1 << b for b in chosen)


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, partitions: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``, enough to connect all that lie within ``radius`` bits."""
    distinct = cut(distinct.select("fp"))

    def make():
        def step(b):
            bits = np.unpackbits(b.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
            return {"at": [0], "n": [len(bits)], "both": [(bits.T @ bits).ravel().astype(np.int64)]}

        return step

    partial = arrow_map(distinct, make, "at int, n long, both array<long>", rows=8192)
    sums = partial.select("n", F.posexplode("both").alias("at", "both")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("both").alias("both")).collect()
    if not sums:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    n = sums[0]["n"]
    together = np.zeros(64 * 64)
    for r in sums:
        together[r["at"]] = r["both"]
    # fewer, wider partitions as rows grow, so that a partition's value stays selective
    partitions = partitions or min(radius + 1, 4 if n < 1 << 21 else 3 if n < 1 << 26 else 2)
    split = bit_partitions(together.reshape(64, 64), n, partitions)
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(ESTIMATE_ROWS).toPandas()["fp"].to_numpy().view(np.uint64)
    cost = np.zeros((partitions, radius + 1))
    for k, bits in enumerate(split):
        value = spread_bits(sample, bits)
        far = np.zeros(radius + 1)
        for at in range(0, len(value), 256):
            d = np.bitwise_count(value[at : at + 256, None] ^ value[None])
            far += [(d <= t).sum() for t in range(radius + 1)]
        scale = (n / len(sample)) ** 2 if len(sample) else 1
        variants = np.cumsum([len(list(itertools.combinations(range(len(bits)), t))) for t in range(radius + 1)])
        cost[k] = (far - len(value)) * scale / 2 + PROBE_COST * variants * n
    ts = thresholds(cost, radius)
    plan = [(k, bits, np.array(list(within(len(bits), t)), np.int64)) for k, (bits, t) in enumerate(zip(split, ts, strict=True)) if t >= 0]

    def probes():
        def step(b):
            fp = b.column(0).to_numpy()
            part, value, who, home = [], [], [], []
            for k, bits, masks in plan:
                own = spread_bits(fp.view(np.uint64), bits)
                part.append(np.full(len(fp) * len(masks), k, np.int32))
                value.append((own[:, None] ^ masks).ravel())
                who.append(np.repeat(fp, len(masks)))
                home.append(np.tile(masks == 0, len(fp)))
            return {"part": np.concatenate(part), "value": np.concatenate(value), "fp": np.concatenate(who), "home": np.concatenate(home)}

        return step

    probed = arrow_map(distinct, probes, "part int, value long, fp long, home boolean", rows=2048)

    def step(pdf, starts, ends):
        import pandas as pd

        fp, home = pdf["fp"].to_numpy(), pdf["home"].to_numpy()
        bits = fp.view(np.uint64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held, root = 0, np.arange(len(fp))
        for i, j in shifts(starts, ends, *(pdf[c].to_numpy() for c in ("own", "bi", "bj"))):
            near = (home[i] | home[j]) & (np.bitwise_count(bits[i] ^ bits[j]) <= radius)
            a.append(i[near])
            b.append(j[near])
            held += len(a[-1])
            if held > 2_000_000:  # links found so far are folded into their roots
                root = roots(len(fp), np.concatenate((np.arange(len(fp)), *a)), np.concatenate((root, *b)))
                a, b, held = [a[0][:0]], [b[0][:0]], 0
        root = roots(len(fp), np.concatenate((np.arange(len(fp)), *a)), np.concatenate((root, *b)))
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]}).drop_duplicates()

    return over_blocks(in_blocks(probed, ["part", "value"], "fp", block_rows), ["part", "value"], step, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of every row of ``docs`` (doc_id, text).

    Copies share a fingerprint and are searched for once. Rows without words share fingerprint 0 and are linked like any
    other. Rows whose doc_id repeats are told apart by their text only; null ids are never the smallest unless all are null.
    """
    fps = cut(fingerprints(docs, words, seed))
    named = linked(fps, radius, partitions)
    lowest = cut(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    names = cut(named.join(lowest, "component").select("fp", "component_id"))
    return fps.join(names, "fp").select("doc_id", "fp", "component_id")


def linked(fps: DataFrame, radius: int = RADIUS, partitions: int | None = None) -> DataFrame:
    """fp, first_id (its smallest doc_id) and component (the smallest fingerprint reachable by links) of each distinct fp."""
    first = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = components(link_fingerprints(first, radius, partitions))
    named = first.join(comp, first["fp"] == comp["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    return cut(named)


def one_of_each(docs: DataFrame, words: int = 3, radius: int = RADIUS, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest doc_id, nulls last, then the smallest hash of the row.

    Rows are told apart by all their columns, so rows that share a doc_id, or have none, stay if their texts differ.
    Rows equal in every column are one.
    """
    docs, names = hide_but(docs, "doc_id", "text")
    keyed = docs.withColumn("_row", F.md5(F.to_json(F.struct(*docs.columns))))
    fps = cut(fingerprints(keyed, words, seed, ("_row",)))
    ranked = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    # a minimum for each fingerprint before the join, so that many copies are one row there
    least = fps.groupBy("fp").agg(F.min(ranked).alias("least"))
    kept = least.join(linked(fps, radius, partitions).select("fp", "component"), "fp").groupBy("component").agg(F.min("least").alias("least"))
    kept = cut(kept.select("least._row"))
    return keyed.dropDuplicates(["_row"]).join(kept, "_row", "left_semi").select(*(F.col(v).alias(c) for c, v in names.items()))
