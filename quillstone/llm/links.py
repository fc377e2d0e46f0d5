"""Links within groups of any size, and the components they make.

A group is cut into blocks of bounded size and every two blocks meet in a task of their own, so a group that holds a
third of all rows is shared by many tasks. A task never emits its pairs: it emits, for each row, one link to the
smallest row it is connected with there, which keeps every component whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts

BLOCK_ROWS = 1024


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected with each of n, given links a-b."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def in_blocks(df: DataFrame, keys: list[str], spread: str, block_rows: int = BLOCK_ROWS, held: bool = False) -> DataFrame:
    """Adds bi, bj, own: each row once for each pair of blocks of its group that it takes part in.

    Groups of one row go. A group of at most ``block_rows`` rows is one block (0, 0). A larger one is dealt by
    a hash of ``spread`` over count / block_rows blocks, and its rows come once for each block they meet.
    ``df`` is read twice: cut first, unless ``held`` says that it comes cheaply from stored rows.
    """
    df = df if held else cut(df)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("group_rows")).filter("group_rows > 1")
    sizes = cut(sizes)
    n = F.ceil(F.col("group_rows") / block_rows).cast("int")
    own = F.pmod(F.xxhash64(F.col(spread), F.lit("block")), F.col("blocks")).cast("int")
    met = df.join(sizes, keys).withColumn("blocks", n).drop("group_rows").withColumn("own", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("blocks", "other")


def over_blocks(df: DataFrame, keys: list[str], step: Callable, schema: str) -> DataFrame:
    """Calls step(pdf, starts, ends) with whole groups of equal (keys, bi, bj), many small ones at a time.

    Row i of pdf belongs to the group that spans starts[i] to ends[i]; rows of a group lie side by side.
    """
    keys = [*keys, "bi", "bj"]
    dealt = df.repartition(parts(df.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(frames):
        import pandas as pd

        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
            new = np.r_[True, (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(1)] if len(pdf) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            if not len(first):
                continue
            rest = pdf.iloc[first[-1] :]
            if len(first) > 1:
                yield from group(pdf.iloc[: first[-1]].reset_index(drop=True), first)
        if rest is not None and len(rest):
            yield from group(rest.reset_index(drop=True), np.array([0, len(rest)]))

    def group(pdf, first):
        size = np.diff(first)
        out = step(pdf, np.repeat(first[:-1], size), np.repeat(first[1:], size))
        if out is not None and len(out):
            yield out

    return dealt.mapInPandas(run, schema)


def shifts(starts: np.ndarray, ends: np.ndarray, own: np.ndarray, bi: np.ndarray, bj: np.ndarray):
    """Index arrays (i, j), i < j, that together hold every pair to compare once: within a block, or across two."""
    i = np.arange(len(starts))
    s = 1
    while len(i := i[i + s < ends[i]]):
        j = i + s
        meet = (bi[i] == bj[i]) | (own[i] != own[j])
        yield i[meet], j[meet]
        s += 1


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node and component (its smallest reachable node) of every node that an edge (a, b) names.

    Alternates the large-star and small-star steps, each a minimum over neighbours with partial aggregation and a join
    that Spark may split where a node is hot. Every round is cut with a checkpoint. No edges, no rows.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        e = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut(e.distinct())
        low = cut(e.groupBy("u").agg(F.min("v").alias("m")))
        moved = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        e = cut(e.join(low, "u").select(moved.alias("x")).selectExpr("x.u", "x.v").filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    near = e.withColumnsRenamed({"u": "node", "v": "component"})
    return cut(near.unionByName(near.select(F.col("component").alias("node"), "component")).distinct())
