"""Navigation: sets of cursors over a move table. A cursor is (seq_id, interval, off); other columns go along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY
from ..scratch import written
from . import lookup, powers
from .scan import as_of, neighbour


def first(move: DataFrame) -> DataFrame:
    """The first position of each sequence, with idx."""
    zero = F.lit(0).cast("long")
    return move.groupBy(KEY).agg(F.min("interval").alias("interval")).select(KEY, "interval", zero.alias("off"), zero.alias("idx"))


def last(move: DataFrame) -> DataFrame:
    """The last position of each sequence, with idx."""
    ends = move.groupBy(KEY).agg(F.max(F.struct("interval", "start", "length")).alias("e"))
    return ends.select(KEY, "e.interval", (F.col("e.length") - 1).alias("off"), (F.col("e.start") + F.col("e.length") - 1).alias("idx"))


def locate(points: DataFrame, move: DataFrame, at: str = "idx", strategy: str | None = None) -> DataFrame:
    """``points`` with interval and off of the index in ``at``.

    ``strategy`` is "scan" (one ordered pass over points and intervals), "search" (a binary search in the starts, sent to all tasks
    or, if their count says that they are too many, to the points of their block) or None: a search if they can be sent.
    """
    rest = points.drop("interval", "off")
    if strategy != "scan" and lookup.fits(move):
        return lookup.searched(rest, move, at)
    if strategy == "search":
        return lookup.searched_in_blocks(rest, move, at)
    found = as_of(rest, at, move, {"interval": "interval", "start": "_start"})
    return found.withColumn("off", F.col(at) - F.col("_start")).drop("_start")


def with_idx(cursors: DataFrame, move: DataFrame) -> DataFrame:
    """``cursors`` with their absolute idx."""
    rest = cursors.drop("idx")
    return rest.join(move.select(KEY, "interval", "start"), [KEY, "interval"]).withColumn("idx", F.col("start") + F.col("off")).select(*rest.columns, "idx")


def step(cursors: DataFrame, move: DataFrame, strategy: str | None = None) -> DataFrame:
    """``cursors`` moved on by the permutation, with the new idx: a join for the image, then locate."""
    rest = cursors.drop("idx")
    there = rest.join(move.select(KEY, "interval", "image"), [KEY, "interval"]).withColumn("idx", F.col("image") + F.col("off")).drop("image")
    return locate(there, move, strategy=strategy).select(*rest.columns, "idx")


def step_k(cursors: DataFrame, move: DataFrame, k: int) -> DataFrame:
    """``cursors`` moved on k times: they take a step by the table's power for each bit of k, and powers stay interval tables."""
    out = with_idx(cursors, move)
    for square in powers.squares(move, k):
        out = powers.mapped(out, square)
    return locate(out, move).select(*cursors.drop("idx").columns, "idx")


def up(cursors: DataFrame, move: DataFrame) -> DataFrame:
    """The last offset of the interval before; before the first comes the last."""
    before = neighbour(move.select(KEY, "interval", "length"), [KEY], "interval", -1, {"interval": "_to", "length": "_size"}, wrap=True)
    moved = cursors.join(before.select(KEY, "interval", "_to", "_size"), [KEY, "interval"])
    return moved.withColumns({"interval": F.col("_to"), "off": F.col("_size") - 1}).select(*cursors.columns)


def down(cursors: DataFrame, move: DataFrame) -> DataFrame:
    """The first offset of the interval after; after the last comes the first."""
    after = neighbour(move.select(KEY, "interval"), [KEY], "interval", 1, {"interval": "_to"}, wrap=True)
    moved = cursors.join(after, [KEY, "interval"])
    return moved.withColumns({"interval": F.col("_to"), "off": F.lit(0).cast("long")}).select(*cursors.columns)


def same_position(a: Column, b: Column) -> Column:
    """Whether two cursor structs are at the same place; idx does not count."""
    return (a["interval"] == b["interval"]) & (a["off"] == b["off"])


def _reached(perm: DataFrame, end: Column, weight: Column) -> tuple[list[DataFrame], DataFrame]:
    """Parts of (…, _next, dist) of the rows that reach the element whose next is ``end``, and the rows that do not.

    Each round doubles the reach of the open rows and writes them alone, so its lineage is one round. There are
    as many rounds as the longest sequence has bits, which is enough for any cycle.
    """
    rounds = (perm.groupBy(KEY).count().agg(F.max("count")).first()[0] or 0).bit_length()
    last_one = F.col("pi") == end
    state = written(perm.withColumns({"_next": F.when(~last_one, F.col("pi")), "dist": F.when(last_one, weight - 1).otherwise(weight).cast("long")}))
    done, rest = [state.where("_next is null")], state.where("_next is not null")
    for _ in range(rounds):
        ahead = rest
        for part in done:
            ahead = ahead.unionByName(part)
        ahead = ahead.select(KEY, F.col("i").alias("_next"), F.col("_next").alias("_far"), F.col("dist").alias("_more"))
        state = rest.join(ahead, [KEY, "_next"]).select(*perm.columns, F.col("_far").alias("_next"), (F.col("dist") + F.col("_more")).alias("dist"))
        state = written(state)
        done, rest = [*done, state.where("_next is null")], state.where("_next is not null")
        if rest.isEmpty():
            break
    return done, rest


def distances(perm: DataFrame, end: Column | None = None, whole: bool = True, weight: Column | None = None) -> DataFrame:
    """(seq_id, i, dist): steps from i to the element whose next is ``end`` (0), by pointer doubling. Extra columns of ``perm`` stay.

    With ``weight``, a step counts for as many, but for one in the last.

    Elements of other cycles never get there: a ValueError, or with ``whole`` false they are left out.
    """
    done, rest = _reached(perm, F.lit(0) if end is None else end, F.lit(1) if weight is None else weight)
    if whole and not rest.isEmpty():
        raise ValueError("the permutation has more than one cycle")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.drop("_next")


def cycle_order(perm: DataFrame) -> DataFrame:
    """(seq_id, step, i): the positions in the order in which as many steps from 0 as there are elements meet them.

    Where 0 lies on a cycle of fewer elements, that cycle is repeated.
    """
    sizes = perm.groupBy(KEY).agg(F.count("*").alias("_n"))
    met = distances(perm.select(KEY, "i", "pi"), whole=False)
    cycles = met.groupBy(KEY).agg(F.count("*").alias("_size"))
    rows = met.join(sizes.join(cycles, KEY), KEY).where("dist < _size")
    return rows.select(KEY, F.explode(F.expr("sequence(_size - 1 - dist, _n - 1, _size)")).alias("step"), "i")


def is_single_cycle(perm: DataFrame) -> DataFrame:
    """(seq_id, ok): whether stepping from 0 meets every element."""
    met = distances(perm.select(KEY, "i", "pi"), whole=False).groupBy(KEY).agg(F.count("*").alias("_met"))
    sizes = perm.groupBy(KEY).agg(F.count("*").alias("_n"))
    return sizes.join(met, KEY, "left").select(KEY, (F.col("_n") == F.coalesce("_met", F.lit(0))).alias("ok"))
