"""Lookup of positions by binary search in the starts of intervals, where those are few enough to be sent to every task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY
from .scan import BLOCK, clipped

#: Most bytes of intervals (sequence, number, start and length, four longs) that are sent.
MOST_BYTES = 32 << 20


def fits(move: DataFrame, most: int = MOST_BYTES) -> bool:
    """Whether the intervals of ``move`` are at most ``most`` bytes, by their count; counting ends where there are too many."""
    return move.select(KEY).limit(most // 32 + 1).count() <= most // 32


def searched(points: DataFrame, move: DataFrame, at: str) -> DataFrame:
    """``points`` with interval and off, found in the sorted (seq_id, start) of all intervals. Points outside have nulls.

    ValueError if the number of sequences times the longest domain passes 2**62. The intervals come to the driver and go to all tasks, so callers check with fits.
    """
    found = move.where("length > 0").select(*(F.col(c).cast("long") for c in (KEY, "start", "length", "interval"))).toArrow().sort_by([(KEY, "ascending"), ("start", "ascending")])
    columns = [found.column(c).combine_chunks().to_numpy(zero_copy_only=False) if found.num_rows else np.zeros(0, np.int64) for c in (KEY, "start", "length", "interval")]
    shared = points.sparkSession.sparkContext.broadcast(columns)

    def search(batches):
        keys, starts, lengths, intervals = shared.value
        ids, first = np.unique(keys, return_index=True)
        span = int((starts + lengths).max()) + 1 if len(starts) else 1
        if len(ids) * span >= 1 << 62:
            raise ValueError("positions and sequences are too many for one number")
        places = np.repeat(np.arange(len(ids)), np.diff(np.append(first, len(keys)))) * span + starts
        for batch in batches:
            own, spots = (batch.column(c).cast(pa.int64()) for c in (KEY, at))
            known = own.is_valid().to_numpy(zero_copy_only=False) & spots.is_valid().to_numpy(zero_copy_only=False)
            own, spots = own.fill_null(0).to_numpy(), spots.fill_null(0).to_numpy()
            k = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            known &= (spots >= 0) & (spots < span) & (ids[k] == own if len(ids) else False)
            hit = np.where(known, np.searchsorted(places, k * span + np.where(known, spots, 0), side="right") - 1, -1)
            hit[hit >= 0] = np.where(keys[hit[hit >= 0]] == own[hit >= 0], hit[hit >= 0], -1) if len(keys) else -1
            inside = hit >= 0
            inside[inside] = spots[inside] < starts[hit[inside]] + lengths[hit[inside]]
            interval, off = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            interval[inside], off[inside] = intervals[hit[inside]], spots[inside] - starts[hit[inside]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(interval, mask=~inside), pa.array(off, mask=~inside)], [*batch.schema.names, "interval", "off"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(search, f"{schema}, interval long, off long")


def searched_in_blocks(points: DataFrame, move: DataFrame, at: str, block: int = BLOCK) -> DataFrame:
    """As searched, where the intervals are too many to be sent: they are cut at block edges, and go to the points of their block.

    A task reads its blocks one after the other, intervals first, and holds the intervals of one block and the rows of one batch.
    """
    mark = F.struct("interval", "start", (F.col("_from") + F.col("_size")).alias("_end"))
    marks = clipped(move.select(KEY, "start", "length", "interval"), "start", "length", block).select(F.col(KEY).alias("_key"), "_block", F.col("_from").alias("_v"), F.lit(0).alias("_kind"), mark.alias("_mark"))
    asked = points.select(F.col(KEY).cast("long").alias("_key"), F.floor(F.col(at) / block).alias("_block"), F.col(at).cast("long").alias("_v"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    rows = marks.unionByName(asked, allowMissingColumns=True).repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_kind", "_v")
    names = points.columns

    def search(batches):
        held = None  # of the last block so far: its key and number, and where intervals start and end, their starts and numbers
        for batch in batches:
            known = np.logical_and(*(batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("_key", "_v")))
            key, part, v, kind = (batch.column(c).fill_null(0).to_numpy() for c in ("_key", "_block", "_v", "_kind"))
            new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (known[1:] != known[:-1]))
            group = np.cumsum(new) - 1
            own = kind == 0
            found = batch.column("_mark").filter(pa.array(own))
            given = [group[own], v[own], *(found.field(c).to_numpy(zero_copy_only=False) for c in ("_end", "start", "interval"))]
            if held and held[0] == (key[0], part[0]) and known[0]:
                given = [np.concatenate([a, b]) for a, b in zip([np.zeros(len(held[1]), np.int64), *held[1:]], given, strict=True)]
            groups, begins, ends, starts, intervals = given
            last = groups == group[-1]
            held = ((key[-1], part[-1]), begins[last], ends[last], starts[last], intervals[last])
            ask = ~own
            local = lambda places, parts: places - parts * block
            first = part[np.flatnonzero(new)]  # the block of each group
            spots, of = v[ask], group[ask]
            hit = np.searchsorted(groups * block + local(begins, first[groups]), of * block + local(spots, part[ask]), side="right") - 1
            inside = known[ask] & (hit >= 0)
            inside[inside] = (groups[hit[inside]] == of[inside]) & (spots[inside] < ends[hit[inside]])
            interval, off = np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64)
            interval[inside], off[inside] = intervals[hit[inside]], spots[inside] - starts[hit[inside]]
            row = batch.column("_row").filter(pa.array(ask))
            yield pa.RecordBatch.from_arrays([*(row.field(c) for c in names), pa.array(interval, mask=~inside), pa.array(off, mask=~inside)], [*names, "interval", "off"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return rows.mapInArrow(search, f"{schema}, interval long, off long")
