"""Suffix arrays and BWTs of texts, and texts and suffix arrays back from a BWT."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY, TERMINATOR
from ..scratch import written
from .navigate import distances
from .rlbwt import fl, lf
from .scan import exclusive_sum, neighbour

#: Symbols of a text that are exploded in one row, and of one row of a recovered text.
PART, CHUNK = 1 << 16, 1 << 16


def suffix_sort(texts: DataFrame) -> DataFrame:
    """bwt(seq_id, i, ch) with sa, of short (seq_id, text): suffixes are sorted as strings; the end mark is added."""
    marked = texts.select(KEY, F.concat("text", F.lit(TERMINATOR)).alias("text"))
    rows = marked.withColumn("sa", F.explode(F.expr("sequence(0L, length(text) - 1L)")))
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.expr("substring(text, sa + 1)")))  # one text's suffixes
    before = F.expr("substring(text, if(sa = 0, length(text), sa), 1)")
    return rows.select(KEY, (place - 1).cast("long").alias("i"), before.alias("ch"), "sa")


def symbols_of(texts: DataFrame, part: int = PART, after: int = 0) -> DataFrame:
    """(seq_id, sa, ch, code) of (seq_id, text) with its end mark, and code1, code2, … of ``after`` symbols behind (0 beyond the end).

    Texts are cut into parts before they are exploded, so that a long one is the work of many tasks. Null texts are empty.
    """
    marked = texts.select(KEY, F.concat(F.coalesce("text", F.lit("")), F.lit(TERMINATOR)).alias("text"))
    parts = marked.withColumn("_part", F.explode(F.expr(f"sequence(0L, (length(text) - 1) div {part})")))
    cut = parts.select(KEY, "_part", F.expr(f"substring(text, int(_part * {part} + 1), {part + after})").alias("_text")).repartition(KEY, "_part")
    rows = cut.select(KEY, "_part", "_text", F.posexplode(F.split("_text", "")).alias("_at", "ch")).where(f"ch != '' and _at < {part}")
    return rows.select(KEY, (F.col("_part") * part + F.col("_at")).alias("sa"), "ch", F.ascii("ch").cast("long").alias("code"), *(F.ascii(F.substring("_text", F.col("_at") + 1 + k, F.lit(1))).cast("long").alias(f"code{k}") for k in range(1, after + 1)))


def suffix_array(texts: DataFrame) -> DataFrame:
    """(seq_id, i, sa) of long texts by prefix doubling over the suffixes that are still open.

    A rank is how many suffixes are smaller by the symbols seen so far: 3 at first, then twice as many each round. A suffix whose rank no
    other has is done, and only keeps being looked up; open ones are told apart within their rank by the rank as many
    symbols on, whose counts are summed in blocks, so no task gets a whole rank or text. Rounds are as many as
    the bits of the longest repeated substring, and each is written.
    """
    bits = 21  # of a code point
    codes = symbols_of(texts, after=2)
    packed = sum((F.col(c) * (1 << bits * k) for k, c in ((1, "code1"), (0, "code2"))), F.col("code") * (1 << 2 * bits))
    first = codes.select(KEY, "sa", packed.alias("key"))
    counts = written(first.groupBy(KEY, "key").agg(F.count("*").alias("n")))
    ranks = exclusive_sum(counts, [KEY], "key", F.col("n"), "rank", block=1 << 2 * bits)
    state = written(first.join(ranks, [KEY, "key"]).select(KEY, "sa", "rank", "n"))
    done, open_, reach = [state.where("n = 1").select(KEY, "sa", "rank")], state.where("n > 1").select(KEY, "sa", "rank"), 3
    while not open_.isEmpty():
        known = open_
        for part in done:
            known = known.unionByName(part)
        ahead = known.select(KEY, (F.col("sa") - reach).alias("sa"), F.col("rank").alias("_far"))
        told = written(open_.join(ahead, [KEY, "sa"], "left").select(KEY, "sa", "rank", F.coalesce("_far", F.lit(-1).cast("long")).alias("_far")))
        counts = told.groupBy(KEY, "rank", "_far").agg(F.count("*").alias("n"))
        smaller = exclusive_sum(counts, [KEY, "rank"], "_far", F.col("n"), "_less", block=1 << 16)
        moved = told.join(smaller, [KEY, "rank", "_far"]).select(KEY, "sa", (F.col("rank") + F.col("_less")).alias("rank"), "n")
        state = written(moved)
        done, open_, reach = [*done, state.where("n = 1").select(KEY, "sa", "rank")], state.where("n > 1").select(KEY, "sa", "rank"), 2 * reach
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(KEY, F.col("rank").alias("i"), "sa")


def bwt_of(texts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """bwt(seq_id, i, ch) with sa, of (seq_id, i, sa): the symbol before each suffix."""
    before = neighbour(symbols_of(texts).select(KEY, "sa", "ch"), [KEY], "sa", -1, {"ch": "_ch"}, wrap=True)
    return suffixes.join(before.select(KEY, "sa", F.col("_ch").alias("ch")), [KEY, "sa"]).select(KEY, "i", "ch", "sa")


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(seq_id, part, text) of (seq_id, at, ch), at from 0: texts in numbered chunks of ``size`` symbols, so none is a single value."""
    cut = rows.groupBy(KEY, F.floor(F.col("at") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "ch"))).alias("s"))
    return cut.select(KEY, "part", F.array_join(F.transform("s", lambda x: x["ch"]), "").alias("text"))


def _joined(parts: DataFrame) -> DataFrame:
    """(seq_id, text) of chunks: a text is its own group, as a string is one value."""
    return parts.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("s")).select(KEY, F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"))


def chunks_by_lf(bwt: DataFrame, size: int = CHUNK) -> DataFrame:
    """(seq_id, part, text) without the end mark, from the distances along LF; an empty text gives no row."""
    return chunks(distances(lf(bwt)).where("dist > 0").select(KEY, (F.col("dist") - 1).alias("at"), "ch"), size)


def chunks_by_fl(bwt: DataFrame, size: int = CHUNK) -> DataFrame:
    """(seq_id, part, text) without the end mark, from the distances along FL, which run the other way."""
    sizes = bwt.groupBy(KEY).agg(F.count("*").alias("_n"))
    return chunks(distances(fl(bwt)).where("i > 0").join(sizes, KEY).select(KEY, (F.col("_n") - 2 - F.col("dist")).alias("at"), "ch"), size)


def text_by_lf(bwt: DataFrame) -> DataFrame:
    """(seq_id, text) of chunks_by_lf."""
    return _joined(chunks_by_lf(bwt))


def text_by_fl(bwt: DataFrame) -> DataFrame:
    """(seq_id, text) of chunks_by_fl."""
    return _joined(chunks_by_fl(bwt))


def suffix_array_by_phi(phi: DataFrame) -> DataFrame:
    """(seq_id, i, sa) of perm φ: steps down to the last suffix, which has rank 0."""
    sizes = phi.groupBy(KEY).agg(F.count("*").alias("_n"))
    rows = distances(phi.join(sizes, KEY), F.col("_n") - 1)
    return rows.select(KEY, ((F.col("dist") + 1) % F.col("_n")).alias("i"), F.col("i").alias("sa"))


def suffix_array_by_phi_inv(phi_inv: DataFrame) -> DataFrame:
    """(seq_id, i, sa) of perm φ⁻¹: steps up to the last suffix."""
    sizes = phi_inv.groupBy(KEY).agg(F.count("*").alias("_n"))
    rows = distances(phi_inv.join(sizes, KEY), F.col("_n") - 1)
    return rows.select(KEY, (F.col("_n") - 1 - F.col("dist")).alias("i"), F.col("i").alias("sa"))
