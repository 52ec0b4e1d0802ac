"""Permutations, symbol sequences and texts that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEY
from ..operators.rlbwt import char_counts, run_length_encode
from ..operators.scan import dense_rank, exclusive_sum
from ..scratch import written

#: Neighbouring events that share a symbol in the sequence of long runs.
STRIDE = 50


def _zero():
    return F.lit(0).cast("long").alias(KEY)


def orders_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perm: an order's place by key, and by status and key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(_zero(), "o_orderkey", F.col("o_orderstatus").alias("ch"))
    ranked = exclusive_sum(dense_rank(orders, [KEY], "o_orderkey", "i"), [KEY, "ch"], "o_orderkey", 1, "own")
    before = char_counts(orders.select(KEY, "ch", F.lit(1).cast("long").alias("length"))).select(KEY, "ch", "before")
    return written(ranked.join(before, [KEY, "ch"]).select(KEY, "i", (F.col("before") + F.col("own")).alias("pi")))


def event_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bwt: event types by event id."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(_zero(), F.col("event_id").alias("i"), F.col("event_type").alias("ch"))


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bwt with long runs: each event has the type of the first of its STRIDE events."""
    events = event_symbols(spark, sf_dir)
    firsts = events.where(F.col("i") % STRIDE == 0).select(F.col("i").alias("first"), "ch")
    return events.select(KEY, "i", (F.floor(F.col("i") / STRIDE) * STRIDE).alias("first")).join(firsts, "first").select(KEY, "i", "ch")


def with_users(runs: DataFrame, spark: SparkSession, sf_dir: str, symbols: DataFrame) -> DataFrame:
    """``runs`` (seq_id, run, ch, length) with val1 and val2, the smallest and largest user of their events."""
    from ..operators.runs import lengths_to_starts

    placed = lengths_to_starts(runs.withColumnRenamed("run", "interval")).withColumn("i", F.explode(F.expr("sequence(start, start + length - 1)")))
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("i"), "user_id")
    found = placed.join(users, "i").groupBy(KEY, "interval").agg(F.min("user_id").alias("val1"), F.max("user_id").alias("val2"))
    return runs.join(found.withColumnRenamed("interval", "run"), [KEY, "run"])


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(run_length_encode(event_symbols(spark, sf_dir)))


def block_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(run_length_encode(event_blocks(spark, sf_dir)))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, text): whole part names, one text a part."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias(KEY), F.col("p_name").alias("text"))


def benchmark_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, text): whole benchmark texts."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias(KEY), "text")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, text): whole texts of all documents, whatever their length."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias(KEY), F.coalesce("text", F.lit("")).alias("text"))
