"""Alphabets: dense codes of symbols, in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY
from .scalars import nucleotide_code

#: A byte alphabet may use all values but one.
MOST_SYMBOLS = 255


def alphabet(symbols: DataFrame, weight: str | None = None) -> DataFrame:
    """(seq_id, ch, code, cnt) of the symbols in (seq_id, ch[, weight]); ValueError if one has too many."""
    counts = symbols.groupBy(KEY, "ch").agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("cnt"))
    coded = counts.withColumn("code", (F.row_number().over(Window.partitionBy(KEY).orderBy("ch")) - 1).cast("long"))
    if not coded.where(F.col("code") >= MOST_SYMBOLS).isEmpty():
        raise ValueError(f"more than {MOST_SYMBOLS} symbols")
    return coded.select(KEY, "ch", "code", "cnt")


def map_sequence(sequence: DataFrame, codes: DataFrame) -> DataFrame:
    """The sequence with the code of each symbol; the alphabet is small, and Spark broadcasts it if it may."""
    return sequence.join(codes.select(KEY, "ch", "code"), [KEY, "ch"])


def unmap_sequence(coded: DataFrame, codes: DataFrame) -> DataFrame:
    """The sequence with the symbol of each code."""
    return coded.join(codes.select(KEY, "code", "ch"), [KEY, "code"])


def check_nucleotides(sequence: DataFrame) -> DataFrame:
    """The sequence itself; ValueError if a symbol is no nucleotide."""
    if not sequence.where(nucleotide_code(F.col("ch")).isNull()).isEmpty():
        raise ValueError("a symbol is no nucleotide")
    return sequence
