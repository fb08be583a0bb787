"""Connected components of a graph given as edges: alternating large-star and small-star rounds (a published method)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex that has an edge: root is the least vertex of its component.

    ``edges`` has long columns ``a`` and ``b``.  Each round only joins and aggregates by
    vertex, so no component is ever held in one place; the edges of a round are written
    to the shared folder.  The number of rounds grows with the logarithm of a component's size.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lower, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        new = written(small, "edges")
        new_mark = _mark(new)
        remove(now)
        now, done = new, new_mark == mark
        mark = new_mark
        if done:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("v"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
