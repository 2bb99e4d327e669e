"""Connected components over link tables, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, written


def _minimum(edges: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours; partial minima come before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``links`` (u, v).

    Alternates large-star and small-star steps: every node's larger neighbours
    are hung on its smallest neighbour, then its smaller ones are.  The number
    of rounds grows with the logarithm of the longest path.  Each round is a
    table in the shared folder; a hub's rows are spread by the skew handling of
    the join, its minimum by partial aggregation.  Self links and repeated
    links do no harm; rows with a null end are ignored.
    """
    cut = written(links.filter("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct())
    before = None
    while True:
        both = cut.unionByName(cut.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minimum(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        large = written(large)
        low = _minimum(large)
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        hung = low.select("u", F.col("m").alias("v"))
        after = written(small.unionByName(hung).filter("u <> v").distinct())
        # the rounds are over when a round changes nothing; counts and a checksum tell
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(cut)
        drop_table(large)
        cut = after
        if state == before or state[0] == 0:
            break
        before = state
    roots = cut.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return cut.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
