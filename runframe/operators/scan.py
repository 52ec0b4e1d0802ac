"""Ordered scans over one or many sequences, in blocks.

A window over a whole sequence would be one task's work. Here a sequence is cut into blocks of its order
column, and windows run inside the blocks. What a block needs of the one before is brought to it by the row itself
(lagged), by cutting intervals at the edges of blocks (clipped, as_of, refined), or, for sums, from one row a block. Nothing is
written: scans are plans, and callers write where they read a result several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY

#: Values of the order column in one block.
BLOCK = 1 << 17


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block))


def exclusive_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, Column | int], block: int = BLOCK) -> DataFrame:
    """``df`` with the sums (name -> value) over the rows before, by ``order`` (a number, unique within ``keys``)."""
    rows = _blocked(df, order, block)
    valued = rows.withColumns({f"_v_{out}": (v if isinstance(v, Column) else F.lit(v)).cast("long") for out, v in values.items()})
    own = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    totals = valued.groupBy(*keys, "_block").agg(*(F.sum(f"_v_{out}").alias(f"_t_{out}") for out in values))
    base = totals.select(*keys, "_block", *(zero(F.sum(f"_t_{out}").over(before)).alias(f"_b_{out}") for out in values))
    found = valued.select(*valued.columns, *(zero(F.sum(f"_v_{out}").over(own)).alias(f"_o_{out}") for out in values)).join(base, [*keys, "_block"])
    return found.select(*df.columns, *((F.col(f"_b_{out}") + F.col(f"_o_{out}")).alias(out) for out in values))


def exclusive_sum(df: DataFrame, keys: list[str], order: str, value: Column | int, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, by ``order`` (a number, unique within ``keys``)."""
    return exclusive_sums(df, keys, order, {out: value}, block)


def dense_rank(df: DataFrame, keys: list[str], order: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with each row's place from 0 by ``order`` within ``keys``."""
    return exclusive_sum(df, keys, order, 1, out, block)


def last_known(df: DataFrame, keys: list[str], order: str, tie: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the last non-null ``value`` up to each row, by (``order``, ``tie``) within ``keys``."""
    rows = _blocked(df, order, block)
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_block").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy(*keys, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(order, tie))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    base = ends.select(*keys, "_block", before.alias("_base"))
    return rows.withColumn("_own", own).join(base, [*keys, "_block"]).withColumn(out, F.coalesce("_own", "_base")).select(*df.columns, out)


def neighbour(df: DataFrame, keys: list[str], order: str, step: int, columns: dict[str, str], wrap: bool = False) -> DataFrame:
    """``df`` with columns (name -> new name) of the row ``step`` places on, by the dense ``order`` from 0.

    Beyond the ends they are null, or those of the other end with ``wrap``: an equi-join, so no window at all.
    """
    there = df.select(*keys, (F.col(order) - step).alias(order), *(F.col(c).alias(n) for c, n in columns.items()))
    if wrap:
        size = df.groupBy(*keys).agg((F.max(order) + 1).alias("_wrap"))
        there = there.join(size, keys).withColumn(order, F.pmod(F.col(order), F.col("_wrap"))).drop("_wrap")
    return df.join(there, [*keys, order], "left").select(*df.columns, *columns.values())


def islands(df: DataFrame, order: str, columns: list[str], starts: Column, number: str, sums: dict[str, Column], firsts: dict[str, str], block: int = BLOCK) -> DataFrame:
    """One row (seq_id, ``number``, …) for each maximal run of rows of the dense ``order`` from 0, numbered from 0.

    ``starts`` says where a run starts, in terms of a row's ``columns`` and of ``_before``, a struct of those of the row before (null
    at the start). A run has the ``sums`` over its rows and the ``firsts`` (name -> column) of its first row. The last row of a block goes to
    the next one too; runs are summed inside blocks, and only what is left of them is numbered and joined over the edges.
    """
    edge = F.col(order) % block == block - 1
    rows = df.withColumn("_over", F.explode(F.when(edge, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("_block", F.floor(F.col(order) / block) + F.col("_over"))
    inside = Window.partitionBy(KEY, "_block").orderBy(order)
    rows = rows.withColumn("_before", F.lag(F.struct(*columns)).over(inside)).withColumn("_new", F.when(F.col("_over") == 0, starts.cast("int")).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).where("_over = 0")
    parts = rows.groupBy(KEY, "_block", "_run").agg(F.min(order).alias("_at"), *(F.sum(v).cast("long").alias(n) for n, v in sums.items()), *(F.min_by(c, order).alias(n) for n, c in firsts.items()))
    before = F.sum("_runs").over(Window.partitionBy(KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.groupBy(KEY, "_block").agg(F.max("_run").alias("_runs")).select(KEY, "_block", F.coalesce(before, F.lit(0)).alias("_base"))
    named = parts.join(base, [KEY, "_block"]).withColumn(number, F.col("_base") + F.col("_run") - 1)
    return named.groupBy(KEY, number).agg(*(F.sum(n).cast("long").alias(n) for n in sums), *(F.min_by(n, "_at").alias(n) for n in firsts))


def clipped(intervals: DataFrame, at: str, length: str, block: int | Column = BLOCK) -> DataFrame:
    """``intervals`` (from ``at``, ``length`` long) with _block, _from and _size: a row for each block that one reaches into."""
    block = block if isinstance(block, Column) else F.lit(block)
    rows = intervals.where(F.col(length) > 0)
    first, last = F.floor(F.col(at) / block), F.floor((F.col(at) + F.col(length) - 1) / block)
    rows = rows.withColumn("_block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col(at), F.col("_block") * block)
    return rows.withColumn("_from", start).withColumn("_size", F.least(F.col(at) + F.col(length), (F.col("_block") + 1) * block) - F.col("_from"))


def as_of(points: DataFrame, at: str, intervals: DataFrame, found: dict[str, str], block: int = BLOCK) -> DataFrame:
    """``points`` with columns (name -> new name) of the interval (seq_id, start, length, …) that covers ``at``; outside all they are null.

    Intervals are cut at block edges, so that one window inside each block finds all: one shuffle of both tables.
    """
    mark = F.struct(*found, (F.col("_from") + F.col("_size")).alias("_end"))
    marks = clipped(intervals.select(KEY, "start", "length", *(c for c in found if c not in ("start", "length"))), "start", "length", block)
    marks = marks.select(KEY, "_block", F.col("_from").alias("_v"), F.lit(0).alias("_kind"), mark.alias("_mark"))
    asked = points.select(KEY, F.floor(F.col(at) / block).alias("_block"), F.col(at).alias("_v"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    known = F.last("_mark", ignorenulls=True).over(Window.partitionBy(KEY, "_block").orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    rows = marks.unionByName(asked, allowMissingColumns=True).withColumn("_found", known).where("_kind = 1")
    inside = F.col("_v") < F.col("_found._end")
    return rows.select("_row.*", *(F.when(inside, F.col(f"_found.{c}")).alias(n) for c, n in found.items()))


def refined(ranges: DataFrame, at: str, intervals: DataFrame, carried: list[str], found: list[str], block: int = BLOCK) -> DataFrame:
    """``ranges`` (from ``at``, ``length`` long, disjoint) cut where ``intervals`` start: (seq_id, _from, _size, ``carried`` of the range, _hit).

    _hit is a struct of the interval's ``found``; parts that no interval covers are left out. Both are cut at block edges, and one
    window inside each block lays them over each other.
    """
    mine = clipped(ranges, at, "length", block).select(KEY, "_block", "_from", F.lit(0).alias("_kind"), F.struct(*carried, (F.col("_from") + F.col("_size")).alias("_end")).alias("_a"))
    other = clipped(intervals, "start", "length", block).select(KEY, "_block", "_from", F.lit(1).alias("_kind"), F.struct(*found, (F.col("_from") + F.col("_size")).alias("_end")).alias("_b"))
    rows = mine.unionByName(other, allowMissingColumns=True)
    inside = Window.partitionBy(KEY, "_block").orderBy("_from", "_kind")
    sofar = inside.rowsBetween(Window.unboundedPreceding, 0)  # of two rows that start at one place the second sees both, and the first goes
    rows = rows.withColumns({"_a": F.last("_a", ignorenulls=True).over(sofar), "_b": F.last("_b", ignorenulls=True).over(sofar), "_next": F.lead("_from").over(inside)})
    end = F.least("_a._end", "_b._end", "_next")  # least passes over a null _next
    rows = rows.where((F.col("_next").isNull() | (F.col("_next") > F.col("_from"))) & (F.col("_a._end") > F.col("_from")) & (F.col("_b._end") > F.col("_from")))
    return rows.select(KEY, "_from", (end - F.col("_from")).alias("_size"), *(F.col(f"_a.{c}").alias(c) for c in carried), F.col("_b").alias("_hit"))
