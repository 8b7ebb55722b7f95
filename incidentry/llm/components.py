"""Connected components of a link table, by large-star and small-star rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import in_few_tasks, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``links`` has long columns ``a`` and ``b``; the result has ``node`` and ``root``, the least node it reaches.

    Every node of a link between two different nodes is listed, roots too. Nulls and self-links are passed over.
    Each round is written out; the number of rounds grows with the logarithm of the longest path. A node with a
    large share of all links is aggregated before it is joined, and adaptive execution splits it in the join.
    With ``rounds`` given, only so many are run: roots are then nodes reached, not always the least ones.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges if rounds else in_few_tasks(edges, links.count()), "links")
    seen, done = None if rounds else _state(edges), 0
    while rounds or seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        few = (lambda df: in_few_tasks(df, 2 * seen[0])) if seen else (lambda df: df)
        large = written(few(large.where("a <> b")), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = written(few(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()), "small-star")
        done += 1
        if done == rounds:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        if not rounds:
            now = _state(edges)
            if now == seen:
                break
            seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
