"""Scalar functions over BIGINT and symbol columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nucleotide alphabet in code order (end mark, separator, bases, any) and complements.
NUCLEOTIDES = (chr(0), chr(1), "A", "C", "G", "T", "N")
COMPLEMENT = ("ACGT", "TGCA")


def bit_width(value: Column) -> Column:
    """Bits of a non-negative number; 1 for 0."""
    return F.length(F.bin(value)).cast("long")


def div_up(a: Column, b: Column) -> Column:
    """a / b rounded up, for non-negative a and positive b."""
    return F.call_function("div", a.cast("long"), b.cast("long")) + (a % b > 0).cast("long")


def pow2(bits: Column) -> Column:
    """2 to the power of ``bits``, which is 63 at most; the last one is the sign bit alone."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))


def all_ones(bits: Column) -> Column:
    """Largest number of so many bits, 64 at most: those of 64 are all ones, as a signed number -1."""
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - bits).cast("int"))
    return F.when(bits > 0, ones).otherwise(F.lit(0).cast("long"))


def mask(bits: Column, shift: Column) -> Column:
    """``bits`` ones above ``shift`` zeros."""
    return F.call_function("shiftleft", all_ones(bits), shift.cast("int"))


def bytes_to_bits(n: Column) -> Column:
    return n * 8


def bits_to_bytes(n: Column) -> Column:
    return div_up(n, F.lit(8))


def complement(symbol: Column) -> Column:
    """Complement of a nucleotide; other symbols stay."""
    return F.translate(F.upper(symbol), *COMPLEMENT)


def nucleotide_code(symbol: Column) -> Column:
    """Code of a nucleotide, in either case; null for any other symbol."""
    found = F.array_position(F.array(*map(F.lit, NUCLEOTIDES)), F.upper(symbol))
    return F.when(found > 0, found - 1).cast("long")


def nucleotide_symbol(code: Column) -> Column:
    """Symbol of a code, in upper case."""
    return F.element_at(F.array(*map(F.lit, NUCLEOTIDES)), (code + 1).cast("int"))
