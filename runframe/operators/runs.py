"""Run decomposition of permutations and the encodings that describe them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY
from .scan import dense_rank, exclusive_sum, islands, neighbour


def decompose(perm: DataFrame) -> DataFrame:
    """runs(seq_id, interval, start, length, image) of perm(seq_id, i, pi): a run ends where pi does not go on by one.

    That the input is a permutation is not checked; see is_permutation.
    """
    new = F.col("_before").isNull() | (F.col("pi") != F.col("_before.pi") + 1)
    found = islands(perm.select(KEY, "i", "pi"), "i", ["pi"], new, "interval", {"length": F.lit(1)}, {"start": "i", "image": "pi"})
    return found.select(KEY, "interval", "start", "length", "image")


def expand(runs: DataFrame) -> DataFrame:
    """perm(seq_id, i, pi) of interval rows."""
    rows = runs.where("length > 0").select(KEY, "start", "image", F.explode(F.expr("sequence(0L, length - 1)")).alias("k"))
    return rows.select(KEY, (F.col("start") + F.col("k")).alias("i"), (F.col("image") + F.col("k")).alias("pi"))


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(KEY, F.col("pi").alias("i"), F.col("i").alias("pi"))


def starts_to_lengths(runs: DataFrame, domain: DataFrame) -> DataFrame:
    """``runs`` (seq_id, interval, start) with lengths; the last run ends at domain(seq_id, domain)."""
    ahead = neighbour(runs, [KEY], "interval", 1, {"start": "_next"}).join(domain, KEY)
    return ahead.withColumn("length", F.coalesce("_next", "domain") - F.col("start")).select(*runs.columns, "length")


def lengths_to_starts(runs: DataFrame, out: str = "start") -> DataFrame:
    """``runs`` (seq_id, interval, length) with starts."""
    return exclusive_sum(runs, [KEY], "interval", F.col("length"), out)


def domain_and_longest(runs: DataFrame) -> DataFrame:
    """(seq_id, domain, max_length)."""
    return runs.groupBy(KEY).agg(F.sum("length").cast("long").alias("domain"), F.max("length").alias("max_length"))


def with_image_rank(runs: DataFrame) -> DataFrame:
    """``runs`` with image_rank: each interval's place by image."""
    return dense_rank(runs, [KEY], "image", "image_rank")


def images_from_ranks(runs: DataFrame) -> DataFrame:
    """``runs`` (…, length, image_rank) with image: images tile the domain in the order of their ranks."""
    return exclusive_sum(runs, [KEY], "image_rank", F.col("length"), "image")


def ranks_from_inverse(visits: DataFrame) -> DataFrame:
    """(seq_id, interval, image_rank) of (seq_id, rank, interval): the interval with the rank-th image."""
    return visits.select(KEY, "interval", F.col("rank").alias("image_rank"))


def encode(runs: DataFrame, domain: DataFrame | None = None, ranks: bool = True, longest: DataFrame | None = None) -> DataFrame:
    """Interval rows from any of their descriptions: length or start, and image or image_rank.

    With ``longest`` (seq_id, max_length), a ValueError is raised if a sequence's longest interval is another, or the sequence is missing. Starts need domain(seq_id, domain). All forms of the same permutation give equal rows
    (seq_id, interval, start, length, image, image_rank); further columns stay. Without ``ranks``, image_rank is left out.
    """
    if "length" not in runs.columns:
        if domain is None:
            raise ValueError("starts need a domain")
        runs = starts_to_lengths(runs, domain)
    if "start" not in runs.columns:
        runs = lengths_to_starts(runs)
    if "image" not in runs.columns:
        runs = images_from_ranks(runs)
    if not ranks:
        runs = runs.drop("image_rank")
    elif "image_rank" not in runs.columns:
        runs = with_image_rank(runs)
    if longest is not None:
        own = runs.groupBy(KEY).agg(F.max("length").alias("_own"))
        if not own.join(longest, KEY, "full").where("not (_own <=> max_length)").isEmpty():
            raise ValueError("the longest interval is not as given")
    first = [KEY, "interval", "start", "length", "image", *["image_rank"] * ranks]
    return runs.select(*first, *(c for c in runs.columns if c not in first))


def is_permutation(perm: DataFrame) -> DataFrame:
    """(seq_id, ok): whether i and pi each are 0 to n - 1."""
    whole = lambda c: (F.min(c) == 0) & (F.max(c) == F.count("*") - 1) & (F.count_distinct(c) == F.count("*"))
    return perm.groupBy(KEY).agg((whole("i") & whole("pi")).alias("ok"))
