"""Connected components of a distributed graph by alternating large-star and small-star steps (DataFrame operations only).

Each step replaces a node's links by links to the smallest of its neighbours; what remains at the end is a star for each
component. A step is a pre-aggregated minimum and a join, so a node with very many links is split like any skewed key, and
its result is a table in the shared folder. Few links are one task's work: no step shuffles them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Links up to which a step is one task (their number is checked).
FEW = 200_000


def _star(links: DataFrame, large: bool, few: bool = False) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = both.coalesce(1) if few else both
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("key"))
    if large:  # larger neighbours go to the smallest one
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    # a node and its smaller neighbours go to the smallest one
    return joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node of links(a, b) that is not the smallest itself."""
    now = written(links.where("a <> b").select("a", "b").distinct(), "links")
    before, state = None, _state(now)
    few = state[0] <= FEW  # a step makes no more links than there were
    while state != before:
        before = state
        middle = written(_star(now, True, few), "links")
        after = written(_star(middle, False, few), "links")
        forget(now)
        forget(middle)
        now, state = after, _state(after)
    return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
