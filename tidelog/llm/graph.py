"""Connected components of a link table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.tables import dropped, written


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component_id) of all ids in `links` (a, b): the smallest id reachable. Links to itself are allowed.

    Every round turns each neighbourhood towards its smallest member, by a grouped minimum and a join; the number of rounds
    grows with the logarithm of the longest path. Rounds are written to the shared folder and the last but one deleted.
    """

    def state(edges: DataFrame) -> tuple:
        return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = written(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        now = state(nxt)
        dropped(edges, least, large, lower)
        edges = nxt
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots).distinct()
