"""Merkle manifests of datasets: a tree of digests for each group of rows, one over the groups, and a proof for each row.

Trees are built level by level as DataFrames. A node's place divided by the fanout is its parent's place, so a level is one
aggregation of at most ``fanout`` children a group, however large the tree is. Proofs are made from the top down: the path
of a run is joined to its children once, each level has as many rows as nodes, and all levels together have about twice as
many as leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .numbering import numbered

FANOUT = 2


def digest(text) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def leaf(*fields) -> Column:
    """Digest of fields as length-prefixed text, so that no two different rows are written alike; null is ``-``, unlike any value."""
    def shown(c):
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(F.concat(*[shown(c) for c in fields]))


def text_of(digests) -> Column:
    """Hex text of joined binary digests."""
    return F.lower(F.hex(digests))


def _climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Levels of runs, lowest first: g, at and n of the parent, its digest h, and kids (at, h and at first row), in order.

    A group whose nodes are one has reached its root and goes no further.
    """
    most, levels = nodes.agg(F.max("n")).first()[0] or 0, []
    while most > 1:
        kid = F.struct("at", "h", *([] if levels else ["row"]))
        runs = nodes.filter("n > 1").groupBy("g", F.expr(f"at div {fanout}").alias("up")).agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.max("n").alias("n"))
        h = F.unhex(digest(F.array_join(F.transform("kids", lambda k: text_of(k["h"])), "")))
        nodes = stash(runs.select("g", F.col("up").alias("at"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), h.alias("h"), "kids"))
        levels.append(nodes)
        most = -(-most // fanout)
    return levels


def _roots(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """g, h and level of the last node of each group."""
    tops = [held.filter("n = 1").select("g", "h", F.lit(k).alias("level")) for k, held in enumerate([nodes, *levels])]
    return reduce(DataFrame.unionByName, tops)


def _descend(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """row, steps and the other columns of ``above`` (g, level of the group's root, steps and others) for every leaf.

    steps go from the leaf to the root: struct(left, right) of the joined digests beside the path, empty where a run has none.
    """
    more = [c for c in above.columns if c not in ("g", "level", "steps")]
    out = ["g", "at", "steps", *more]
    paths = None
    for k in range(len(levels), 0, -1):
        row = ["row"] if k == 1 else []
        begun = above.filter(F.col("level") == k).withColumn("at", F.lit(0).cast("bigint")).select(*out)
        paths = begun if paths is None else paths.unionByName(begun)
        side = lambda kids: F.unhex(F.array_join(F.transform(kids, lambda x: F.hex(x["h"])), ""))
        beside = lambda x: F.struct(side(F.filter("kids", lambda y: y["at"] < x["at"])).alias("left"), side(F.filter("kids", lambda y: y["at"] > x["at"])).alias("right"))
        each = F.transform("kids", lambda x: F.struct(x["at"].alias("at"), *[x[c].alias(c) for c in row], beside(x).alias("step")))
        met = levels[k - 1].select("g", "at", each.alias("kids")).join(paths, ["g", "at"]).select("g", F.explode("kids").alias("k"), "steps", *more)
        paths = met.select("g", "k.at", *[f"k.{c}" for c in row], F.concat(F.array("k.step"), "steps").alias("steps"), *more)
    alone = nodes.filter("n = 1").join(above.filter("level = 0"), "g").select("row", "steps", *more)
    return alone if paths is None else paths.select("row", "steps", *more).unionByName(alone)


def manifest(leaves: DataFrame, group: str, order: str, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (with ``leaf``, a hex digest) with subroot, root and steps, the proof of each leaf.

    Per ``group`` (null is one of them) leaves stand by ``order``, nulls first, then by digest; rows that tie in both are equal
    leaves, and which of them stands first changes no digest. While a level has several nodes, every ``fanout`` consecutive
    ones make their digest's, the last run of fewer, even of one. Groups stand in bytewise order, null first, and their
    subroots make the root alike. No leaves, no rows. Columns of any name are kept but leaf, subroot, root and steps,
    which are replaced or added.
    """
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    columns = [c for c in leaves.columns if c not in ("leaf", "subroot", "root", "steps")]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], F.lit(0).alias("_"))
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    # texts have been read by now: ranges are found on digests and carried columns alone
    held = stash(leaves.select(named.alias("g"), F.col(f"`{order}`").alias("o"), F.unhex("leaf").alias("h"), row.alias("row")))
    nodes = numbered(held, "g", ["o", "h"]).drop("o")
    levels = _climb(nodes, fanout)
    subroots = stash(_roots(nodes, levels))
    tops = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), "h", F.struct("g", "level", F.col("h").alias("subroot")).alias("row")), "g", ["o"]).drop("o")
    over = _climb(tops, fanout)
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    root = stash(_roots(tops, over).select("g", "level", none.alias("steps"), F.col("h").alias("root")))
    above = stash(_descend(tops, over, root).select("row.g", "row.level", "steps", "row.subroot", "root"))
    paths = _descend(nodes.withColumn("row", F.struct(F.col("h").alias("leaf"), "row")), _with_leaf(levels), above)
    digests = [text_of(c).alias(n) for c, n in (("row.leaf", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    return paths.select(*[F.col(f"row.row.c{k}").alias(c) for k, c in enumerate(columns)], *digests, "steps")


def _with_leaf(levels: list[DataFrame]) -> list[DataFrame]:
    """The lowest level's children with their own digest in row."""
    if not levels:
        return levels
    kids = F.transform("kids", lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), F.struct(x["h"].alias("leaf"), x["row"].alias("row")).alias("row")))
    return [levels[0].withColumn("kids", kids), *levels[1:]]


def folded(claimed, steps="steps") -> Column:
    """The root that a claimed leaf (hex) leads to along a proof."""
    return F.aggregate(steps, F.col(claimed) if isinstance(claimed, str) else claimed, lambda h, s: digest(F.concat(text_of(s["left"]), h, text_of(s["right"]))))


def proof_digest(steps="steps") -> Column:
    """Digest of a proof's digests, from the leaf's level to the root, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: text_of(F.concat(s["left"], s["right"]))), ""))
