"""Connected components by contraction in random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidewheel.sources.shared import written

LOW = (1 << 32) - 1


def _shuffled(x: Column, salt: int, back: bool = False) -> Column:
    """A permutation of all 64-bit numbers (a Feistel network of four hashed rounds), or its inverse."""
    low = F.lit(LOW).cast("bigint")
    left, right = F.shiftrightunsigned(x, 32), x.bitwiseAND(low)
    for i in range(3, -1, -1) if back else range(4):
        if back:
            left, right = right.bitwiseXOR(F.xxhash64(F.lit(salt), F.lit(i), left).bitwiseAND(low)), left
        else:
            left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(salt), F.lit(i), right).bitwiseAND(low))
    return F.shiftleft(left, 32).bitwiseOR(right)


def components(links: DataFrame) -> DataFrame:
    """node and root (one node of its component) for every node of the links (a, b).

    In each round every node moves to the neighbour (or itself) that a salted order ranks lowest, and the graph of
    those targets remains. The salt changes each round, so chains shrink by a constant factor and stars at once;
    the number of rounds grows with the logarithm of a component's size. The moves of each round are kept and composed
    from the last one on, so each round and each step costs what is left of the graph. A hub's edges are reduced
    before they are shuffled. Links from a node to itself make it a node; no links: no rows.

    The order of whole numbers is a permutation, whose lowest value alone tells the node: a hash table of fixed width
    finds it. Nodes of other types are kept beside their hash, which takes a sort."""
    kind = links.select("a").union(links.select("b")).schema[0].dataType
    whole = isinstance(kind, IntegralType)
    own = [F.col(x).cast("bigint" if whole else kind).alias(x) for x in ("a", "b")]
    edges, moves = written(links.where("a is not null or b is not null").select(*own)), []
    while not moves or not edges.isEmpty():
        salt = len(moves)

        def ranked(x: str, salt: int = salt) -> Column:
            return _shuffled(F.col(x), salt) if whole else F.struct(F.xxhash64(F.lit(salt), F.col(x)).alias("h"), F.col(x).alias("to"))

        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.where("a is not null").groupBy("a").agg(F.min(F.when(F.col("b").isNotNull(), ranked("b"))).alias("near"))
        lowest = near.select("a", F.least(ranked("a"), F.col("near")).alias("lowest"))
        to = written(lowest.select("a", (_shuffled(F.col("lowest"), salt, back=True) if whole else F.col("lowest")["to"]).alias("to")))
        moves.append(to)
        edges = edges.where("a != b").join(to, "a").select(F.col("to").alias("x"), "b").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = written(edges.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    roots = moves.pop()
    while moves:
        later = roots.select(F.col("a").alias("to"), F.col("to").alias("root"))
        roots = written(moves.pop().join(later, "to", "left").select("a", F.coalesce("root", "to").alias("to")))
    return roots.select(F.col("a").cast(kind).alias("node"), F.col("to").cast(kind).alias("root"))


def sized(roots: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) and size, of nodes and roots."""
    of = roots.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    return roots.join(of, "root").select("node", "component", "size")


def labelled(links: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) and size."""
    return sized(components(links))
