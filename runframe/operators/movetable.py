"""Move tables: for each interval, where its image lands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bit_width, bits_to_bytes
from ..model import USUAL, KEY, UNSPLIT, SplitParams
from ..scratch import written
from .runs import encode, lengths_to_starts
from .scan import as_of
from .split import Payload, split_runs

BASE = ("interval", "start", "length", "image", "image_rank", "pointer", "off")


def with_pointers(runs: DataFrame) -> DataFrame:
    """``runs`` with pointer and off: the interval in which each image lies, and how far into it."""
    found = as_of(runs, "image", runs, {"interval": "_interval", "start": "_start"})
    return found.withColumns({"pointer": F.col("_interval"), "off": F.col("image") - F.col("_start")}).drop("_interval", "_start")


def move_table(runs: DataFrame, params: SplitParams | None = None, domain: DataFrame | None = None, payload: Payload | None = None) -> DataFrame:
    """move(seq_id, interval, start, length, image, pointer, off, payload…) of any description of runs.

    Without ``params``, runs with payload columns are not split, and others are by default.
    """
    runs = encode(runs, domain, ranks=False)
    extra = [c for c in runs.columns if c not in (KEY, *BASE)]
    params = params or (UNSPLIT if extra else USUAL)
    return with_pointers(written(split_runs(runs, params, payload)) if params.length_capping is not None else runs)


def attach_payload(move: DataFrame, payload: DataFrame) -> DataFrame:
    """``move`` with the payload rows (seq_id, interval, …) of exactly its intervals; ValueError otherwise."""
    own, given = (x.groupBy(KEY, "interval").agg(F.count("*").alias(n)) for x, n in ((move, "_own"), (payload, "_given")))
    if not own.join(given, [KEY, "interval"], "full").where("_own is null or _given is null or _given != 1").isEmpty():
        raise ValueError("the payload must have one row for each interval after splitting")
    return move.join(payload, [KEY, "interval"])


def widths(move: DataFrame) -> DataFrame:
    """Bits of each column of the table, by sequence: primary (relative and absolute), pointer, offset, symbol and payload columns.

    A symbol has as many bits as the largest code of those that occur.
    """
    extra = [c for c in move.columns if c not in (KEY, "code", *BASE) and dict(move.dtypes)[c] in ("bigint", "int")]
    top = {"w_length": F.max("length"), "w_start": F.sum("length") - 1, "w_pointer": F.max("interval"), "w_off": F.max("length")}
    if "ch" in move.columns:
        top["w_ch"] = F.count_distinct("ch") - 1
    return move.groupBy(KEY).agg(*(bit_width(v.cast("long")).alias(k) for k, v in top.items()), *(bit_width(F.max(c).cast("long")).alias(f"w_{c}") for c in extra))


def table_bits(move: DataFrame, absolute: bool = False) -> DataFrame:
    """(seq_id, bits, bytes) of the packed table."""
    sized = widths(move).join(move.groupBy(KEY).agg(F.count("*").alias("rows")), KEY)
    columns = [c for c in sized.columns if c.startswith("w_") and c != ("w_length" if absolute else "w_start")]
    total = sum((F.col(c) for c in columns), F.lit(0)) * F.col("rows")
    return sized.select(KEY, total.alias("bits"), bits_to_bytes(total).alias("bytes"))


def stats(runs: DataFrame, move: DataFrame) -> DataFrame:
    """(seq_id, runs, intervals, domain, max_length, n_over_r): before and after splitting."""
    after = move.groupBy(KEY).agg(F.count("*").alias("intervals"), F.sum("length").cast("long").alias("domain"), F.max("length").alias("max_length"))
    before = runs.groupBy(KEY).agg(F.count("*").alias("runs"))
    return before.join(after, KEY).withColumn("n_over_r", F.col("domain") / F.col("runs"))


def violations(move: DataFrame) -> DataFrame:
    """Rows of a given table that break it.

    Interval ids must be 0 to r - 1, each once, lengths positive, starts and images tile the domain, and pointers hit their
    images. Nulls in any of these columns, and in the key, break a row; other rows of a sequence with a broken row may be named too.
    """
    given = move.select(*(F.col(c).cast("long").alias(c) for c in (KEY, "interval", "start", "length", "image", "pointer", "off")))
    keyed = given.withColumn("_row", F.xxhash64(*given.columns))
    sizes = keyed.groupBy(F.col(KEY).alias("_k1")).agg(F.count("*").alias("_n"))
    repeats = keyed.groupBy(F.col(KEY).alias("_k2"), F.col("interval").alias("_id")).agg(F.count("*").alias("_same"))
    ids = keyed.join(sizes, F.col(KEY).eqNullSafe(F.col("_k1"))).join(repeats, F.col(KEY).eqNullSafe(F.col("_k2")) & F.col("interval").eqNullSafe(F.col("_id")))
    bad_id = F.coalesce((F.col("_same") > 1) | (F.col("interval") < 0) | (F.col("interval") >= F.col("_n")) | (F.col("length") <= 0), F.lit(True)) | F.col(KEY).isNull()
    sound = written(ids.withColumn("_bad", bad_id).drop("_k1", "_k2", "_id", "_n", "_same"))
    usable = sound.where("not _bad").select(KEY, "interval", "length", "image")
    placed = lengths_to_starts(usable, "_start").select(KEY, "interval", "length", F.col("_start").alias("start"), "image")
    tiles = lengths_to_starts(usable.where("image is not null").select(KEY, F.col("image").alias("interval"), "length"), "_image").select(KEY, F.col("interval").alias("image"), "_image").distinct()
    again = as_of(placed, "image", placed, {"interval": "_pointer", "start": "_from"}).join(tiles, [KEY, "image"], "left")
    again = again.select(KEY, "interval", F.col("start").alias("_start"), "_image", "_pointer", (F.col("image") - F.col("_from")).alias("_off"))
    joined = sound.join(again, [KEY, "interval"], "left")
    same = F.lit(True)
    for own, wanted in (("start", "_start"), ("image", "_image"), ("pointer", "_pointer"), ("off", "_off")):
        same &= F.coalesce(F.col(own) == F.col(wanted), F.lit(False))
    broken = joined.where(F.col("_bad") | ~same).select("_row").distinct()
    own = move.withColumn("_row", F.xxhash64(*(F.col(c).cast("long") for c in given.columns)))
    return own.join(broken, "_row").select(*move.columns)


def checked(move: DataFrame) -> DataFrame:
    """A table made elsewhere, if it holds together; ValueError otherwise."""
    if not violations(move).isEmpty():
        raise ValueError("not a move table")
    return move
