"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component. A null end or a
    link of a node with itself says nothing; links may repeat. Without links the result is empty.

    Contraction: every node points to its smallest neighbour or itself, pointers are doubled until each points to the
    root of its tree, and the links between different trees are what the next round works on. Each round at least
    halves the trees that have a link left, and doubling takes as many steps as the logarithm of a tree's height, so
    a chain of any order settles in few rounds. The minima are combined before the shuffle, so a hub of any size
    is a row per task. There is no limit on rounds: each one removes links or ends the loop.
    """
    with Scratch(links.sparkSession, "components") as scratch:
        ends = links.where("a is not null and b is not null and a <> b")
        edges = scratch.keep(ends.select("a", "b").unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        maps: list[DataFrame] = []
        while not edges.isEmpty():
            near = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
            maps.append(_doubled(near.select("node", F.least("node", "m").alias("root")), scratch))
            start, end = _named(maps[-1], "a", "x"), _named(maps[-1], "b", "y")
            across = edges.join(start, "a").join(end, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
            edges = scratch.keep(across.distinct())
        # A round's roots are the nodes of the next one, but for those that had no link left.
        roots = maps[0] if maps else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        for later in maps[1:]:
            roots = roots.join(_named(later, "root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        return scratch.result(roots)


def _named(pointers: DataFrame, node: str, root: str) -> DataFrame:
    return pointers.select(F.col("node").alias(node), F.col("root").alias(root))


def _doubled(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """``pointers`` (node, root) with each node's root followed to its end; a root never is larger than its node."""
    pointers = scratch.keep(pointers)
    while True:
        higher = pointers.join(_named(pointers.where("node <> root"), "root", "top"), "root", "left")
        if higher.where("top is not null").isEmpty():
            return pointers
        pointers = scratch.keep(higher.select("node", F.coalesce("top", "root").alias("root")))
