"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is rotated at random into ``CODE_BITS`` dimensions; its code is the signs, and its correction factor is
the inner product of the rotated vector with its own code, scaled to unit length. <code, q> / factor is an unbiased
estimate of <x, q>, and its error exceeds the confidence bound with a probability that ``EPSILON`` sets. Codes, factors
and a byte a component (the q of an estimate, whose rounding widens the bound) are computed once and stored by entry.

Pairs to estimate come from bands of further sign bits: two vectors meet where a whole band agrees, in blocks of bounded
size, and are looked at in the first band that they share only. The number of bands follows from the width of a band so
that a pair at the threshold is missed with a probability under ``MISS``. Only (entry, band) goes through the search for
shared buckets; codes are brought to the rows of shared buckets, and the vectors themselves only to rows with a pair
whose upper bound reaches the threshold. Those pairs are recomputed exactly, in double precision.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import matrix, unit, usable
from .common import arrow_map, cut
from .links import components, in_blocks, over_blocks, roots, shifts

CODE_BITS = 256
EPSILON = 5.0
MISS = 1e-7
SEED = 20240601


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """``bits`` rows; x -> rotation @ x keeps lengths: a random orthogonal matrix's first ``dim`` columns."""
    a = np.random.default_rng(seed).standard_normal((bits, dim))
    q, r = np.linalg.qr(a)
    return q * np.sign(np.diag(r))


def banding(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits of a band, bands) for n vectors: wider bands as n grows, enough bands for pairs at the threshold."""
    bits = min(30, max(8, math.ceil(math.log2(max(n, 2))) + 4))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def estimates(rotated_q: np.ndarray, code_x: np.ndarray, factor_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of <x, q> and their error at one EPSILON, pair by pair. Codes are signs +-1, one row a vector."""
    d = code_x.shape[1]
    estimate = (rotated_q * code_x).sum(1) / math.sqrt(d) / factor_x
    return estimate, np.sqrt(np.maximum(1 - factor_x**2, 0)) / factor_x / math.sqrt(d - 1)


def coded(entries: DataFrame, bits: int, bands: int) -> DataFrame:
    """e, n, label, d, code, factor, bytes, step, keys of every entry: what an estimate needs, and its key in each band."""
    wide = -(-bits * bands // 64) * 64

    def make():
        turns: dict[int, tuple] = {}

        def step(b):
            v = b.column("v").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for k, x in enumerate(v):
                by_dim.setdefault(len(x), []).append(k)
            out = {c: [None] * len(v) for c in ("d", "code", "factor", "bytes", "step", "keys")}
            weight = 1 << np.arange(bits, dtype=np.int64)
            for dim, at in by_dim.items():
                if dim not in turns:
                    turns[dim] = np.random.default_rng(SEED + 1).standard_normal((dim, wide)), rotation(dim, max(CODE_BITS, dim), SEED).T
                x = unit(matrix([v[k] for k in at]))
                keys = ((x @ turns[dim][0][:, : bits * bands] > 0).reshape(len(at), bands, bits) * weight).sum(2).astype(np.int32)
                turned = x @ turns[dim][1]
                code = np.packbits(turned >= 0, axis=1)
                factor = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
                scale = np.abs(x).max(1) / 127
                small = np.rint(x / scale[:, None]).astype(np.int8)
                for r, k in enumerate(at):
                    out["d"][k], out["code"][k], out["factor"][k] = dim, code[r].tobytes(), factor[r]
                    out["bytes"][k], out["step"][k], out["keys"][k] = small[r].tobytes(), scale[r], keys[r]
            return out | {c: b.column(c) for c in ("e", "n", "label")}

        return step

    kind = entries.schema["label"].dataType.simpleString()
    return arrow_map(entries.select("e", "n", "label", "v"), make, f"e long, n long, label {kind}, d int, code binary, factor double, bytes binary, step double, keys array<int>", rows=512)


def undecided(pdf, starts: np.ndarray, ends: np.ndarray, threshold: float):
    """Index arrays (p, q) that together hold each pair of a block whose upper bound reaches the threshold, once."""
    keys = np.array(pdf["keys"].tolist(), np.int32)
    band, dims, factor, scale = (pdf[c].to_numpy() for c in ("band", "d", "factor", "step"))
    label = pdf["label"].factorize()[0]
    sides, place = {}, np.zeros(len(pdf), np.int64)
    for d in set(dims.tolist()):
        at = np.flatnonzero(dims == d)
        place[at] = np.arange(len(at))
        wide = max(CODE_BITS, d)
        small = np.frombuffer(b"".join(pdf["bytes"].iloc[at]), np.int8).reshape(len(at), d)
        turned = (small * scale[at][:, None]) @ rotation(d, wide, SEED).T
        code = np.unpackbits(np.frombuffer(b"".join(pdf["code"].iloc[at]), np.uint8).reshape(len(at), -1), axis=1)[:, :wide]
        sides[d] = turned.astype(np.float32), code.astype(np.float32) * 2 - 1
    for i, j in shifts(starts, ends, *(pdf[c].to_numpy() for c in ("own", "bi", "bj"))):
        for at in range(0, len(i), 8192):
            p, q = i[at : at + 8192], j[at : at + 8192]
            same = keys[p] == keys[q]
            ok = (same.argmax(1) == band[p]) & (band[p] == band[q]) & same[np.arange(len(p)), band[p]] & (dims[p] == dims[q]) & (label[p] == label[q])
            p, q = p[ok], q[ok]
            for d, (turned, sign) in sides.items():
                here = dims[p] == d
                u, w = p[here], q[here]
                about, error = estimates(turned[place[w]], sign[place[u]], factor[u])
                rounding = scale[w] / 2 * math.sqrt(d) / factor[u] + 1e-5
                maybe = about + EPSILON * error + rounding >= threshold
                if maybe.any():
                    yield u[maybe], w[maybe]


def near_links(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", block_rows: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; rows of one not-null label with cosine >= threshold are linked.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with nothing.
    Equal vectors of a label are one entry with a count. Rows whose id repeats count as other vectors. No rows: no rows.
    Vectors of different lengths don't link.
    """
    # two hashes name an entry: of a billion entries, two share one hash with a probability of a few per cent
    named_by = {"h1": F.xxhash64("v", "label"), "h2": F.xxhash64(F.lit(SEED), "v", "label")}
    rows = cut(vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label")))
    good = usable(rows.filter("label is not null"), "v")
    entries = good.groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    entries = cut(entries.withColumns(named_by).withColumn("e", F.monotonically_increasing_id()))
    n = entries.count()
    if not n:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    codes = cut(coded(entries, *banding(n, threshold)))
    posted = codes.select("e", F.posexplode("keys").alias("band", "key"), "label", "d")
    posted = posted.select("e", "band", F.xxhash64("label", "d", "band", "key").alias("bucket"))
    met = in_blocks(posted, ["bucket"], "e", block_rows, held=True).join(codes, "e")

    def doubtful(pdf, starts, ends):
        doubt = np.zeros(len(pdf), bool)
        for p, q in undecided(pdf, starts, ends, threshold):
            doubt[p] = doubt[q] = True
        return pdf.loc[doubt, ["e", "band", "bucket", "own", "bi", "bj"]]

    def exact(pdf, starts, ends):
        import pandas as pd

        e, n = pdf["e"].to_numpy(), pdf["n"].to_numpy()
        own = [unit(matrix([v]))[0] for v in pdf["v"]]
        links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        a, b, held = [], [], 0

        def fold():
            nonlocal root, a, b, held
            root = roots(len(pdf), np.concatenate((np.arange(len(pdf)), *a)), np.concatenate((root, *b)))
            a, b, held = [], [], 0

        for p, q in undecided(pdf, starts, ends, threshold):
            cosine = (np.array([own[k] for k in p]) * np.array([own[k] for k in q])).sum(1)
            s, t = p[cosine >= threshold], q[cosine >= threshold]
            links += np.bincount(s, n[t], minlength=len(pdf)).astype(np.int64) + np.bincount(t, n[s], minlength=len(pdf)).astype(np.int64)
            a.append(s)
            b.append(t)
            held += len(s)
            if held > 1_000_000:
                fold()
        fold()
        hit = np.flatnonzero(links > 0)
        return pd.DataFrame({"e": e[hit], "links": links[hit], "root": e[root[hit]]})

    doubts = cut(over_blocks(met, ["bucket"], doubtful, "e long, band int, bucket long, own int, bi int, bj int"))
    full = doubts.join(codes, "e").join(entries.select("e", "v"), "e")
    found = cut(over_blocks(full, ["bucket"], exact, "e long, links long, root long"))
    counts = found.groupBy("e").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("e").alias("a"), F.col("root").alias("b")))
    named = entries.select("e", "h1", "h2", "low", "n").join(counts, "e", "left").join(comp.withColumnRenamed("node", "e"), "e", "left")
    named = cut(named.select("h1", "h2", "low", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "e").alias("component")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = cut(named.join(lowest, "component").select("h1", "h2", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"))
    sure = rows.withColumns({h: F.when(F.col("label").isNotNull(), x) for h, x in named_by.items()})
    out = sure.join(named, ["h1", "h2"], "left")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"),
    )
