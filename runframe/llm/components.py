"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # as many rows as links


def _small(links: DataFrame) -> DataFrame:
    """Links of a node to lesser ones are few after ``_large``, so they are dealt once, and a task drops what it repeats before they are dealt again."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).repartition("a")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = F.array(F.struct(F.greatest("a", "m").alias("a"), F.least("a", "m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return down.join(least, "a").select(F.explode(moved).alias("link")).select("link.a", "link.b").where("a != b").distinct()


def _noted(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, written, and a mark of them, which is taken while they are written."""
    mark = Observation()
    links = written(links.observe(mark, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
    return links, (mark.get["n"], mark.get["h"])


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node in a link (a, b): component is the smallest node reachable.

    Links may repeat, point either way or loop. What an earlier call returned, if ``known``, stands for that call's links. Each round writes
    a table of at most as many links as there were, so a lost executor costs a round at most; rounds grow with the logarithm of the nodes.
    """
    if known is not None:
        links = links.select("a", "b").unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
    links, mark = _noted(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        links, now = _noted(_small(_large(links)))
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
