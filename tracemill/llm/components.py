"""Connected components by alternating large-star and small-star steps, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._io import cut, discard


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (id, component_id), the smallest id that is reachable.

    Only ids that have a link are returned. Self links and repeated links do no harm; an empty
    table gives an empty one. Every round is written to the shared folder. No list of neighbours
    is ever built: a round takes the minimum of each id's neighbours and joins it back. Rounds go on until nothing changes,
    which takes in the order of the square of the logarithm of the longest path.
    """
    e = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = _mark(e)
    done = not before[0]
    while not done:
        # large star: larger neighbours of u go to the least of u and its neighbours
        both = e.union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours of u and u itself go to the least of them (a > b here)
        large = cut(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = cut(small.filter("a <> b").distinct(), "small")
        mark = _mark(after)
        discard(large)
        discard(e)
        e, done, before = after, mark == before or not mark[0], mark
    roots = e.select(F.col("b").alias("id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots.select("id", F.col("id").alias("component_id")))
