"""The φ and φ⁻¹ permutations of a run-length BWT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY, SplitParams
from ..scratch import written
from .contract import ENOUGH, end_distances
from .movetable import move_table
from .navigate import distances
from .rlbwt import lf, lf_runs
from .scan import dense_rank, neighbour


def with_suffixes(bwt: DataFrame) -> DataFrame:
    """(seq_id, i, ch, sa): the suffix of each row is its number of LF steps from the end mark's row.

    The BWT must be of one text with one end mark, so that LF has a single cycle.
    """
    return distances(lf(bwt)).select(KEY, "i", "ch", F.col("dist").alias("sa"))


def check_bwt(bwt: DataFrame) -> DataFrame:
    """``bwt`` itself, if the smallest symbol of each sequence occurs once; ValueError otherwise."""
    least = bwt.groupBy(KEY, "ch").agg(F.count("*").alias("n")).groupBy(KEY).agg(F.min_by("n", "ch").alias("n"))
    if not least.where("n != 1").isEmpty():
        raise ValueError("no unique end mark")
    return bwt


def phi_runs(suffixes: DataFrame) -> DataFrame:
    """Interval rows of φ from (seq_id, i, ch, sa): a run's head suffix is a start, the suffix before it the image."""
    return _edges(suffixes, -1)


def phi_inv_runs(suffixes: DataFrame) -> DataFrame:
    """Interval rows of φ⁻¹: a run's tail suffix is a start, the suffix after it the image."""
    return _edges(suffixes, 1)


def _edges(suffixes: DataFrame, side: int) -> DataFrame:
    rows = neighbour(suffixes.select(KEY, "i", "ch", "sa"), [KEY], "i", side, {"ch": "_ch", "sa": "image"}, wrap=True)
    size = suffixes.groupBy(KEY).agg(F.count("*").alias("domain"))
    edge = F.col("i") == (F.lit(0) if side < 0 else F.col("domain") - 1)
    cut = rows.join(size, KEY).where(edge | (F.col("ch") != F.col("_ch"))).select(KEY, F.col("sa").alias("start"), "image", "domain")
    return _lengths(cut)


def _lengths(starts: DataFrame) -> DataFrame:
    cut = neighbour(written(dense_rank(starts, [KEY], "start", "interval")), [KEY], "interval", 1, {"start": "_next"})
    return cut.select(KEY, "interval", "start", (F.coalesce("_next", "domain") - F.col("start")).alias("length"), "image")


def check_runs(rlbwt: DataFrame) -> DataFrame:
    """``rlbwt`` itself, if the smallest symbol of each sequence occurs once; ValueError otherwise."""
    least = rlbwt.groupBy(KEY, "ch").agg(F.sum("length").alias("n")).groupBy(KEY).agg(F.min_by("n", "ch").alias("n"))
    if not least.where("n != 1").isEmpty():
        raise ValueError("no unique end mark")
    return rlbwt


def edge_suffixes(rlbwt: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(seq_id, run, head, tail, domain): the suffixes of each run's first and last row, from the runs alone.

    LF's interval table is contracted to at most ``enough`` positions a run, and only those are ranked; no table
    has a row for each symbol.
    """
    lf = written(lf_runs(check_runs(rlbwt)).select(KEY, "interval", "start", "length", "image"))
    found = written(end_distances(lf, enough=enough))
    size = lf.groupBy(KEY).agg(F.sum("length").cast("long").alias("domain"))
    last = F.col("start") + F.col("length") - 1
    rows = lf.select(KEY, F.col("interval").alias("run"), F.col("start").alias("i"), last.alias("_last")).join(found.withColumnRenamed("dist", "head"), [KEY, "i"])
    rows = rows.select(KEY, "run", "head", F.col("_last").alias("i")).join(found.withColumnRenamed("dist", "tail"), [KEY, "i"])
    return rows.join(size, KEY).select(KEY, "run", "head", "tail", "domain")


def phi_runs_of(rlbwt: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Interval rows of φ from runs alone: a run's first suffix is a start, the last one of the run before its image."""
    return _placed(edge_suffixes(rlbwt, enough), "head", "tail", -1)


def phi_inv_runs_of(rlbwt: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Interval rows of φ⁻¹ from runs alone: a run's last suffix is a start, the first one of the run after its image."""
    return _placed(edge_suffixes(rlbwt, enough), "tail", "head", 1)


def _placed(edges: DataFrame, start: str, image: str, side: int) -> DataFrame:
    edges = written(edges)
    rows = neighbour(edges, [KEY], "run", side, {image: "image"}, wrap=True).select(KEY, F.col(start).alias("start"), "image", "domain")
    return _lengths(rows)


def phi_move(rlbwt: DataFrame, params: SplitParams | None = None, enough: int = ENOUGH) -> DataFrame:
    """Move table of φ from runs alone."""
    return move_table(phi_runs_of(rlbwt, enough), params)


def phi_inv_move(rlbwt: DataFrame, params: SplitParams | None = None, enough: int = ENOUGH) -> DataFrame:
    """Move table of φ⁻¹ from runs alone."""
    return move_table(phi_inv_runs_of(rlbwt, enough), params)
