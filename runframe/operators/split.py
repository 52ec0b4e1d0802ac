"""Splitting of long intervals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bit_width
from ..model import KEY, UNSPLIT, SplitParams
from .scan import exclusive_sum

Columns = Callable[[Column, Column, Column, Column], dict[str, Column]]


@dataclass(frozen=True)
class Vectorised:
    """A payload in Python: a function of four Arrow arrays (interval, its length, chunk's offset, chunk's length) to the arrays of ``schema``, in its order."""

    function: Callable[[pa.Array, pa.Array, pa.Array, pa.Array], list[pa.Array]]
    schema: str


Payload = Columns | Vectorised


def caps(runs: DataFrame, factor: float) -> DataFrame:
    """(seq_id, cap): the mean length times ``factor``, rounded up to all ones in binary."""
    if factor <= 0:
        raise ValueError("the capping factor must be positive")
    mean = F.ceil(F.sum("length") / F.count("*") * F.lit(float(factor))).cast("long")
    return runs.groupBy(KEY).agg((F.pow(F.lit(2.0), bit_width(mean)).cast("long") - 1).alias("cap"))


def cut_longer(runs: DataFrame, longest: int | DataFrame, payload: Payload | None = None) -> DataFrame:
    """Intervals of at most ``longest`` (a number, or (seq_id, cap)): each run in chunks, the rest last, renumbered in order.

    Payload columns go to every chunk, unless ``payload`` (of the run's interval and length, the
    chunk's offset in it and its length) gives new ones. Starts and images move with the chunks.
    """
    rows = runs.withColumn("cap", F.lit(longest).cast("long")) if isinstance(longest, int) else runs.join(longest, KEY)
    pieces = rows.withColumn("_pieces", F.floor((F.greatest("length", F.lit(1)) - 1) / F.col("cap")) + 1)
    pieces = exclusive_sum(pieces, [KEY], "interval", F.col("_pieces"), "_first").withColumn("_k", F.explode(F.expr("sequence(0L, _pieces - 1)")))
    at = F.col("_k") * F.col("cap")
    size = F.least(F.col("length") - at, F.col("cap"))
    if isinstance(payload, Vectorised):
        return _in_python(runs, pieces, at, size, payload)
    fresh = payload(F.col("interval"), F.col("length"), at, size) if payload else {}
    moved = {"start": F.col("start") + at, "image": F.col("image") + at, "interval": F.col("_first") + F.col("_k"), "length": size}
    names = [c for c in runs.columns if c not in fresh and c != "image_rank"]
    return pieces.select(*((moved[c] if c in moved else F.col(c)).alias(c) for c in names), *(v.alias(c) for c, v in fresh.items()))


def _in_python(runs: DataFrame, pieces: DataFrame, at: Column, size: Column, payload: Vectorised) -> DataFrame:
    """The chunks with the columns that ``payload`` gives for whole batches of them."""
    moved = {"start": F.col("start") + at, "image": F.col("image") + at, "interval": F.col("_first") + F.col("_k"), "length": size}
    new = payload.schema.split(",")
    fresh = [field.split()[0] for field in new]
    names = [c for c in runs.columns if c not in fresh and c != "image_rank"]
    rows = pieces.select(*((moved[c] if c in moved else F.col(c)).alias(c) for c in names), F.col("interval").alias("_a"), F.col("length").alias("_b"), at.alias("_c"), size.alias("_d"))

    def add(batches):
        for batch in batches:
            own = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, *payload.function(*(batch.column(c) for c in ("_a", "_b", "_c", "_d")))], [*names, *fresh])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    return rows.mapInArrow(add, f"{kept}, {payload.schema}")


def cap_by_mean(runs: DataFrame, factor: float, payload: Payload | None = None) -> DataFrame:
    """Intervals of at most the cap of ``factor``."""
    return cut_longer(runs, caps(runs, factor), payload)


def balanced(runs: DataFrame, factor: int) -> DataFrame:
    """The runs as they are: the balancing factor is accepted, and no interval is split for it."""
    return runs


def split_runs(runs: DataFrame, params: SplitParams = UNSPLIT, payload: Payload | None = None) -> DataFrame:
    """Length capping, then balancing, as far as ``params`` asks for them."""
    if params.length_capping is not None:
        runs = cap_by_mean(runs, params.length_capping, payload)
    if params.balancing is not None:
        runs = balanced(runs, params.balancing)
    return runs
