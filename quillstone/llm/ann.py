"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. It is posted under each of them, with the pivot's rank, in
the pivot's inverted file. A query gathers the postings of its own nearest pivots, vectors are ranked by footrule
distance between the two orders (a pivot that one of them lacks counts as just beyond its last), and the best ones are
reranked by exact cosine on the original vectors.

Pivots are fit on a bounded sample; every vector is indexed. The index lies in blocks of bounded size and meets the
queries in blocks, so neither is ever whole in a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Pivots, the bound of the sample.
PIVOTS = 256
#: Nearest pivots that represent a vector.
PREFIX = 96
#: Share of a block that is reranked, and the least number.
RERANK = 0.05
RERANK_LEAST = 256
BLOCK_ROWS = 8192
QUERY_ROWS = 1024


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector can have a cosine: not null, not zero, all components finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0))


def matrix(column) -> np.ndarray:
    return np.array(list(column), np.float64) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = x @ pivots.T
    top = np.argpartition(-near, min(prefix, near.shape[1]) - 1, axis=1)[:, :prefix]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


class Block:
    """The inverted files of one block."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.prefix = order.shape
        rank = np.tile(np.arange(self.prefix), n)
        who = np.repeat(np.arange(n), self.prefix)
        by = np.argsort(order.ravel(), kind="stable")
        self.who, self.rank = who[by], rank[by].astype(np.int32)
        self.starts = np.searchsorted(order.ravel()[by], np.arange(pivots + 1))
        self.n = n

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of a query's order to every vector of the block."""
        far, m = np.zeros(self.n, np.int64), self.prefix
        saved = np.zeros(self.n, np.float64)
        for r, p in enumerate(order.tolist()):
            i, j = self.starts[p], self.starts[p + 1]
            # against both lacking it: (m - r) + (m - rank) less |r - rank|
            rank = self.rank[i:j]
            saved[self.who[i:j]] += (m - r) + (m - rank) - np.abs(rank - r)
        return far + m * (m + 1) - saved


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest by cosine among the other rows of ``vectors``.

    Rows count, not ids: of rows that repeat a query's id and vector only one is its own, and a row of its id with another
    vector is a row like any other; a query that is asked twice is answered twice. Ties go to the smaller id; fewer than k
    others, fewer rows. Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids, nor
    vectors of another length than most have (of equally common lengths, the larger). No rows: no rows.
    """
    spark = vectors.sparkSession
    have = cut(usable(vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v")), "v"))
    common = have.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    have = have.filter(F.size("v") == (common["d"] if common else 0))
    # equal vectors are one entry with the ids of the first k + 1 rows, which is all that a list of k can show
    same = Window.partitionBy("v").orderBy("id")
    few = have.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
    entries = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = usable(queries.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v")), "v")
    asked = cut(asked.filter(F.size("v") == (common["d"] if common else 0)).withColumn("row", F.monotonically_increasing_id()))
    n, nq = entries.count(), asked.count()
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"row long, query_id {kind}, vec_id {kind}, score double"
    if not n or not nq:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    sample = unit(matrix(entries.orderBy(F.xxhash64("v")).limit(pivots).toPandas()["v"]))
    held = spark.sparkContext.broadcast(sample)
    blocks, query_blocks = -(-n // block_rows), -(-nq // query_rows)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = entries.withColumn("b", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")).withColumn("q", every(query_blocks))
    ask = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("b", every(blocks))

    def search(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}, dtype=object)
        pivots = held.value
        x, q = unit(matrix(left["v"])), unit(matrix(right["v"]))
        block = Block(orders(x, pivots, prefix), len(pivots))
        take = min(len(x), max(RERANK_LEAST, int(len(x) * rerank)))
        rows, query, vec, score = [], [], [], []
        ids, own, row = left["ids"].tolist(), right["id"].tolist(), right["row"].tolist()
        place = {v.tobytes(): k for k, v in enumerate(np.asarray(left["v"].tolist(), np.float64) + 0.0)}
        self_at = [place.get(v.tobytes(), -1) for v in np.asarray(right["v"].tolist(), np.float64) + 0.0]
        for a, order in enumerate(orders(q, pivots, prefix)):
            far = block.footrule(order)
            best = np.argpartition(far, take - 1)[:take]
            s = x[best] @ q[a]
            low = np.sort(s)[-min(k + 1, len(s))]
            for c in np.flatnonzero(s >= low).tolist():
                others = list(ids[best[c]])
                if best[c] == self_at[a] and own[a] in others:
                    others.remove(own[a])
                for i in others:
                    rows.append(row[a])
                    query.append(own[a])
                    vec.append(i)
                    score.append(s[c])
        return pd.DataFrame({"row": rows, "query_id": query, "vec_id": vec, "score": score})

    found = index.groupBy("b", "q").cogroup(ask.groupBy("b", "q")).applyInPandas(search, schema)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
