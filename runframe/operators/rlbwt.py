"""Run-length Burrows-Wheeler transforms and their LF and FL mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabets import alphabet
from ..model import KEY, UNSPLIT, USUAL, SplitParams
from ..scratch import written
from .movetable import move_table
from .runs import lengths_to_starts
from .scan import exclusive_sum, exclusive_sums, islands


def run_length_encode(bwt: DataFrame) -> DataFrame:
    """rlbwt(seq_id, run, ch, length) of bwt(seq_id, i, ch)."""
    new = F.col("_before").isNull() | ~F.col("ch").eqNullSafe(F.col("_before.ch"))
    return islands(bwt.select(KEY, "i", "ch"), "i", ["ch"], new, "run", {"length": F.lit(1)}, {"ch": "ch"}).select(KEY, "run", "ch", "length")


def expand_symbols(rlbwt: DataFrame) -> DataFrame:
    """bwt(seq_id, i, ch) of runs; extra columns stay."""
    rows = lengths_to_starts(rlbwt.withColumnRenamed("run", "interval")).withColumn("_k", F.explode(F.expr("sequence(0L, length - 1)")))
    return rows.withColumn("i", F.col("start") + F.col("_k")).select(KEY, "i", "ch", *(c for c in rlbwt.columns if c not in (KEY, "run", "ch", "length")))


def char_counts(rlbwt: DataFrame) -> DataFrame:
    """(seq_id, ch, heads, cnt, max_length, before, heads_before): per symbol, and the sums over smaller symbols."""
    counts = rlbwt.groupBy(KEY, "ch").agg(F.count("*").alias("heads"), F.sum("length").cast("long").alias("cnt"), F.max("length").alias("max_length"))
    smaller = Window.partitionBy(KEY).orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)  # one row a symbol
    return counts.withColumns({"before": F.coalesce(F.sum("cnt").over(smaller), F.lit(0)).cast("long"), "heads_before": F.coalesce(F.sum("heads").over(smaller), F.lit(0)).cast("long")})


def lf_runs(rlbwt: DataFrame) -> DataFrame:
    """Interval rows of LF: each run's start, image and image_rank, in the runs' own order."""
    ranked = exclusive_sums(rlbwt, [KEY, "ch"], "run", {"head_rank": F.col("length"), "_place": 1}).join(char_counts(rlbwt).select(KEY, "ch", "before", "heads_before"), [KEY, "ch"])
    rows = ranked.select(KEY, F.col("run").alias("interval"), "ch", "length", "head_rank", (F.col("before") + F.col("head_rank")).alias("image"), (F.col("heads_before") + F.col("_place")).alias("image_rank"), *(c for c in rlbwt.columns if c not in (KEY, "run", "ch", "length")))
    return lengths_to_starts(rows)


def fl_runs(rlbwt: DataFrame) -> DataFrame:
    """Interval rows of FL: the runs by (symbol, run); a run's start is its LF image, and its image its start."""
    rows = lf_runs(rlbwt)
    names = {"interval": "image_rank", "start": "image", "image": "start", "image_rank": "interval"}
    return rows.drop("head_rank").select(*(F.col(names.get(c, c)).alias(c) for c in rows.drop("head_rank").columns))


def lf_move(rlbwt: DataFrame, params: SplitParams | None = None, codes: bool = False) -> DataFrame:
    """Move table of LF, with symbols; payload columns of ``rlbwt`` go along and keep it from being split by default.

    With ``codes``, the table also has each symbol's dense code.
    """
    return _mapped(lf_runs(rlbwt).drop("head_rank"), rlbwt, params, codes)


def fl_move(rlbwt: DataFrame, params: SplitParams | None = None, codes: bool = False) -> DataFrame:
    """Move table of FL, with symbols, and their dense codes with ``codes``."""
    return _mapped(fl_runs(rlbwt), rlbwt, params, codes)


def _mapped(runs: DataFrame, rlbwt: DataFrame, params: SplitParams | None, codes: bool) -> DataFrame:
    plain = not set(rlbwt.columns) - {KEY, "run", "ch", "length"}
    move = move_table(written(runs), params or (USUAL if plain else UNSPLIT))
    return move.join(alphabet(rlbwt, "length").select(KEY, "ch", "code"), [KEY, "ch"]) if codes else move


def lf(bwt: DataFrame) -> DataFrame:
    """perm(seq_id, i, pi) with ch: LF of each position; a permutation of any symbol sequence."""
    counts = char_counts(bwt.select(KEY, "ch", F.lit(1).cast("long").alias("length"))).select(KEY, "ch", "before")
    ranked = exclusive_sum(bwt.select(KEY, "i", "ch"), [KEY, "ch"], "i", 1, "_rank").join(counts, [KEY, "ch"])
    return ranked.select(KEY, "i", (F.col("before") + F.col("_rank")).alias("pi"), "ch")


def fl(bwt: DataFrame) -> DataFrame:
    """perm(seq_id, i, pi) with ch: FL of each position, and the symbol that its suffix begins with."""
    return lf(bwt).select(KEY, F.col("pi").alias("i"), F.col("i").alias("pi"), "ch")
