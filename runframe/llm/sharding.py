"""Sharding: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 24
#: Atomic groups are ranges of the text's hash, so equal texts are in one; so many groups come to the driver at most.
GROUP_BITS = 14
#: Rows of a group that one window sorts; larger groups are numbered in several parts.
PART_ROWS = 20_000


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Least capacity with which ``shards`` contiguous runs hold the ordered ``sizes``: binary search with a greedy check."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0

    def fits(capacity: int) -> bool:
        used = 0
        for _ in range(shards):
            at = np.searchsorted(ends, used + capacity, side="right")
            if at == len(ends):
                return True
            used = int(ends[at - 1]) if at else 0
        return False

    low, high = max(-(-total // shards), int(sizes.max()) if len(sizes) else 0), total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each ordered group: no shard above the smallest capacity.

    That capacity may be set by one large group; the cuts then stay as near to equal shares of the
    rest as the capacity lets them.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    capacity = smallest_capacity(sizes, shards)
    least = np.empty(shards + 1, np.int64)  # least[k]: the first group from which k shards hold the rest
    least[0] = len(sizes)
    for k in range(1, shards + 1):
        least[k] = np.searchsorted(ends, ends[least[k - 1]] - capacity, side="left")
    shard, at = np.empty(len(sizes), np.int64), 0
    for i in range(shards):
        left = shards - i
        most = np.searchsorted(ends, ends[at] + capacity, side="right") - 1
        target = ends[at] + (ends[-1] - ends[at]) / left
        to = np.searchsorted(ends, target)
        to -= to > at and target - ends[to - 1] < ends[min(to, len(sizes))] - target
        to = int(min(max(to, least[left - 1], at), most))
        shard[at:to] = i
        at = to
    return shard


def shard(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of every row, by the law ``bytes``.

    A row's size is its text's UTF-8 bytes (null: none) plus 8. Atomic groups are ordered ranges of
    the text's hash: equal texts (null counts as empty) share a group and so a shard. Repeated rows each
    get a slot of their own; slots run from 0 in each shard, by group and id. Extra columns go; an empty
    table gives no row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.shiftrightunsigned(F.xxhash64(text), 64 - GROUP_BITS).cast("int")
    rows = written(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), hashed.alias("_group")))
    groups = rows.groupBy("_group").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("_group").toPandas()  # at most 2**GROUP_BITS rows
    groups["_shard"] = cuts(groups["size"].to_numpy(np.int64), shards)
    groups["_parts"] = -(-groups["n"] // PART_ROWS)
    plan = docs.sparkSession.createDataFrame([(int(g), int(s), int(p)) for g, s, p in zip(groups["_group"], groups["_shard"], groups["_parts"], strict=True)], "_group int, shard int, _parts long")
    placed = rows.join(F.broadcast(plan), "_group").withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("_parts")))
    counts = placed.groupBy("shard", "_group", "_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_group", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_group", "_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_group", "_part").orderBy("doc_id", "text_crc32")) - 1
    return placed.join(counts, ["_group", "_part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + own).alias("slot"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))
