"""Search for the nearest interval with a given payload value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY
from .scan import last_known


def _nearest(cursors: DataFrame, move: DataFrame, column: str, value: str, ahead: bool) -> DataFrame:
    sign = -1 if ahead else 1
    wanted = move.select(KEY, F.col(column).alias(value), (F.col("interval") * sign).alias("_v"), F.lit(0).alias("_kind"), F.struct("interval", "length").alias("_mark"), F.lit(None).cast(cursors.schema).alias("_row"))
    asked = cursors.select(KEY, value, (F.col("interval") * sign).alias("_v"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<interval:bigint,length:bigint>").alias("_mark"), F.struct(*cursors.columns).alias("_row"))
    found = last_known(wanted.unionByName(asked), [KEY, value], "_v", "_kind", "_mark", "_found").where("_kind = 1").select("_row.*", "_found")
    end = F.lit(0).cast("long") if ahead else F.col("_found.length") - 1
    off = F.when(F.col("_found.interval") == F.col("interval"), F.col("off")).otherwise(end)
    return found.withColumns({"found_interval": F.col("_found.interval"), "found_off": F.when(F.col("_found").isNotNull(), off)}).drop("_found")


def pred(cursors: DataFrame, move: DataFrame, column: str, value: str = "value") -> DataFrame:
    """``cursors`` with found_interval and found_off: the cursor itself if its interval's ``column`` has the
    cursor's ``value``, else the last offset of the nearest earlier interval that has it, else null.

    One scan in each (sequence, value) answers all cursors.
    """
    return _nearest(cursors, move, column, value, False)


def succ(cursors: DataFrame, move: DataFrame, column: str, value: str = "value") -> DataFrame:
    """As pred, with the first offset of the nearest later interval, up to the last interval."""
    return _nearest(cursors, move, column, value, True)
