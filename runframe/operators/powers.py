"""Composition and powers of permutations as interval tables: (seq_id, start, length, image) with intervals that need not be maximal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY
from ..scratch import written
from .runs import decompose, expand
from .scan import BLOCK, as_of, refined

MAP = (KEY, "start", "length", "image")


def merged(rows: DataFrame, equal: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Intervals joined where both starts and images go on and the columns ``equal`` agree; at block edges they stay apart."""
    rows = rows.withColumn("_block", F.floor(F.col("start") / block))
    inside = Window.partitionBy(KEY, "_block").orderBy("start")
    before = F.lag(F.struct("start", "length", "image", *equal)).over(inside)
    rows = rows.withColumn("_before", before)
    on = (F.col("_before.start") + F.col("_before.length") == F.col("start")) & (F.col("_before.image") + F.col("_before.length") == F.col("image"))
    for column in equal:
        on &= F.col(f"_before.{column}").eqNullSafe(F.col(column))
    rows = rows.withColumn("_run", F.sum(F.when(on, 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(KEY, "_block", "_run").agg(F.min("start").alias("start"), F.sum("length").cast("long").alias("length"), F.min("image").alias("image"), *(F.first(c).alias(c) for c in equal))
    return out.select(*MAP, *equal)


def compose(first: DataFrame, then: DataFrame, block: int = BLOCK) -> DataFrame:
    """``then`` after ``first``: the images of ``first`` are cut where intervals of ``then`` start, and parts that go on are joined again.

    There are at most as many intervals as in both together, and one for each block edge; no position is expanded.
    """
    cut = refined(first, "image", then, ["start", "image"], ["start", "image"], block)
    start, image = F.col("start") + F.col("_from") - F.col("image"), F.col("_hit.image") + F.col("_from") - F.col("_hit.start")
    return merged(cut.select(KEY, start.alias("start"), F.col("_size").alias("length"), image.alias("image")), (), block)


def squares(runs: DataFrame, k: int, block: int = BLOCK):
    """The powers of ``runs`` for the bits of k that are set, lowest first; each square is written, so plans do not grow with k."""
    square = runs.select(*MAP)
    while k:
        if k & 1:
            yield square
        k >>= 1
        if k:
            square = written(compose(square, square, block))


def power(runs: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Interval table of ``runs`` applied k times; k = 0 gives the identity."""
    out = merged(runs.select(KEY, "start", "length", F.col("start").alias("image")), (), block)
    for n, square in enumerate(squares(runs, k, block)):
        out = compose(out, square, block) if n else square
    return out


def permutation_power(perm: DataFrame, k: int) -> DataFrame:
    """perm(seq_id, i, pi) of ``perm`` applied k times."""
    return expand(power(written(decompose(perm)), k))


def mapped(points: DataFrame, runs: DataFrame, at: str = "idx", block: int = BLOCK) -> DataFrame:
    """``points`` with ``at`` moved on once by an interval table."""
    found = as_of(points, at, runs, {"start": "_start", "image": "_image"}, block)
    return found.withColumn(at, F.col("_image") + F.col(at) - F.col("_start")).drop("_start", "_image")
