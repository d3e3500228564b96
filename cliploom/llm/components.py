"""Connected components by randomised contraction, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is the smallest node of its component.

    In each round every node moves to the neighbour, or itself, of smallest priority, a hash that
    changes from round to round; links between places that remain are the next round's.  A
    constant share of nodes goes in each round, whatever the shape, long paths and stars included:
    minima are aggregated before the shuffle, and joins are plain joins of written tables, which
    adaptive execution splits where a node has very many links.
    """
    edges = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    moves: list[DataFrame] = []
    while edges.take(1):

        def priority(c: str, seed: int = len(moves)) -> Column:
            return F.struct(F.xxhash64(F.lit(seed), c).alias("hash"), F.col(c).alias("node"))

        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy(F.col("a").alias("node")).agg(F.min(priority("b")).alias("p"))
        move = written(move.select("node", F.least(F.col("p"), priority("node"))["node"].alias("to")), "moves")
        moves.append(move)
        ends = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = written(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    roots = moves[-1]
    for move in reversed(moves[:-1]):
        on = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = written(move.join(on, "to", "left").select("node", F.coalesce("root", "to").alias("to")), "roots")
    least = written(roots.groupBy("to").agg(F.min("node").alias("label")), "labels")
    return written(roots.join(least, "to").select("node", F.least("node", "label").alias("label")), "components")
