"""Ranks along a permutation of one cycle, in run space: parts of the domain are left out by first returns until it is about as large as the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY
from ..scratch import written
from .navigate import distances
from .powers import merged
from .scan import BLOCK, clipped, refined

#: Positions for each run of the permutation with which leaving out ends.
ENOUGH = 32
PIECE = [KEY, "start", "length", "image", "weight", "forced"]


def _pieces(runs: DataFrame) -> DataFrame:
    """The intervals as pieces: first and last position alone (forced: never left out), and what lies between."""
    sizes = runs.groupBy(KEY).agg(F.count("*").alias("_runs"))
    edge = F.array_distinct(F.array(F.lit(0).cast("long"), F.col("length") - 1))
    moved = lambda at, size, forced: (
        F.struct((F.col("start") + at).alias("start"), size.alias("length"), (F.col("image") + at).alias("image"), F.lit(forced).alias("forced"))
    )
    one = F.lit(1).cast("long")
    ends = F.transform(edge, lambda at: moved(at, one, True))
    rest = F.when(F.col("length") > 2, F.array(moved(one, F.col("length") - 2, False))).otherwise(F.filter(ends, lambda _: F.lit(False)))
    rows = runs.where("length > 0").select(KEY, F.explode(F.concat(ends, rest)).alias("p")).select(KEY, "p.*")
    return rows.withColumn("weight", F.lit(1).cast("long")).join(sizes, KEY).select(*PIECE, "_runs")


def _through(cut: DataFrame) -> DataFrame:
    """Pieces that land in a piece to be left out, moved on by it, and by it again while they land in it.

    Only positions that the piece's own image does not cover are entered from elsewhere, so of a shift by d, a range of at most d
    enters: its parts take one of two numbers of steps, up to a border.
    """
    p, size, w = F.col("_hit.start"), F.col("_hit.length"), F.col("_hit.weight")
    d, v, m = F.col("_hit.image") - F.col("_hit.start"), F.col("_from"), F.col("_size")
    div = lambda a, b: F.floor(a / b).cast("long")
    steps = F.when(F.abs(d) >= size, 1).when(d > 0, div(p + size - v + d - 1, d)).otherwise(div(v - p, -d) + 1)
    border = F.when(F.abs(d) >= size, v + m).when(d > 0, p + size - (F.col("_k") - 1) * d).otherwise(p - F.col("_k") * d)
    rows = cut.withColumn("_k", steps.cast("long")).withColumn("_border", F.least(v + m, border))
    part = lambda at, upto, k: F.struct((F.col("start") + at - F.col("image")).alias("start"), (upto - at).alias("length"), (at + k * d).alias("image"), (F.col("weight") + k * w).alias("weight"))
    later = F.col("_k") + F.when(d > 0, -1).otherwise(1)
    parts = F.array(part(v, F.col("_border"), F.col("_k")), part(F.col("_border"), v + m, later))
    return rows.select(KEY, F.explode(parts).alias("p"), "forced").select(KEY, "p.*", "forced").where("length > 0").select(*PIECE)


def contracted(runs: DataFrame, block: int = BLOCK, enough: int = ENOUGH) -> DataFrame:
    """(seq_id, start, length, image, weight): a part of the domain with both ends of every interval, and its first returns.

    A piece goes on to ``image`` in ``weight`` steps. In each level those pieces are left out whose hash is above those of
    all that they land in and that land in them; what landed in them goes on by them, at once to pieces that stay. Sequences with at most ``enough``
    positions a run are left as they are. Tables have in the order of the runs' rows, however large the domain; there are in the
    order of log(domain / runs) levels, each of one pass over pieces and images.
    """
    state, level = written(_pieces(runs)), 0
    while True:
        sizes = state.groupBy(KEY).agg(F.sum("length").alias("_left"), F.max("_runs").alias("_runs"))
        sizes = sizes.withColumns({"_open": F.col("_left") > F.col("_runs") * enough, "_width": F.greatest(F.lit(1), F.floor(F.col("_left") / F.col("_runs") / 2)).cast("long")})
        sizes = written(sizes)
        if sizes.where("_open").isEmpty():
            return state.select(*PIECE[:-1])
        even = clipped(state.drop("_runs").join(sizes, KEY), "start", "length", F.col("_width"))
        coin = F.when(F.col("_open") & ~F.col("forced"), F.xxhash64(KEY, "_from", F.lit(level)))
        table = written(even.select(KEY, F.col("_from").alias("start"), F.col("_size").alias("length"), (F.col("image") + F.col("_from") - F.col("start")).alias("image"), "weight", "forced", coin.alias("coin")))
        cut = written(refined(table, "image", table, ["start", "image", "weight", "forced", "coin"], ["start", "length", "image", "weight", "coin"], block))
        other = F.col("_hit.start") != F.col("start")
        ways = F.array(F.struct("start", F.col("coin").alias("own"), F.when(other, F.col("_hit.coin")).alias("near")), F.struct(F.col("_hit.start").alias("start"), F.col("_hit.coin").alias("own"), F.when(other, F.col("coin")).alias("near")))
        met = cut.select(KEY, F.explode(ways).alias("w")).select(KEY, "w.*").where("own is not null")
        out = met.groupBy(KEY, "start").agg(F.max("own").alias("own"), F.max("near").alias("near")).where("near is null or own > near").select(KEY, F.col("start").alias("_out"))
        left = cut.join(out, (cut[KEY] == out[KEY]) & (cut["start"] == out["_out"]), "left_anti").withColumn("_at", F.col("_hit.start"))
        gone = out.withColumnRenamed(KEY, "_key")
        met = left.join(gone, (F.col(KEY) == F.col("_key")) & (F.col("_at") == F.col("_out")), "left")
        stays = met.where("_out is null").select(KEY, (F.col("start") + F.col("_from") - F.col("image")).alias("start"), F.col("_size").alias("length"), F.col("_from").alias("image"), "weight", "forced")
        whole = stays.unionByName(_through(met.where("_out is not null")))
        state, level = written(merged(whole, ("weight", "forced"), block).join(sizes.select(KEY, "_runs"), KEY)), level + 1


def end_distances(runs: DataFrame, block: int = BLOCK, enough: int = ENOUGH) -> DataFrame:
    """(seq_id, i, dist) of the first and last position of each interval: steps to the element whose next is 0.

    Needs a permutation of a single cycle for each sequence; ValueError otherwise.
    """
    small = contracted(runs, block, enough).withColumn("_k", F.explode(F.expr("sequence(0L, length - 1)")))
    elements = small.select(KEY, (F.col("start") + F.col("_k")).alias("i"), (F.col("image") + F.col("_k")).alias("pi"), "weight")
    found = distances(elements, weight=F.col("weight")).select(KEY, "i", "dist")
    ends = runs.select(KEY, F.explode(F.array_distinct(F.array(F.col("start"), F.col("start") + F.col("length") - 1))).alias("i"))
    return ends.join(found, [KEY, "i"])
