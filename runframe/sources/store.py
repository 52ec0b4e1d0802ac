"""Stored tables: Parquet, sorted by sequence and interval, beside one row about them and one row about each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEY, VERSION, SplitParams

#: Folder name of a stored move table, and rows of one of its files.
EXTENSION, FILE_ROWS = ".move", 1 << 20


def _folder(path: str) -> str:
    return path if path.endswith(EXTENSION) else path + EXTENSION


def save(table: DataFrame, path: str, params: SplitParams | None = None, runs: DataFrame | None = None, file_rows: int = FILE_ROWS) -> str:
    """Write a table and what is known of it: version, splitting, rows, domain (sum of lengths, or rows without them) and runs before splitting.

    ``runs`` are the interval rows before splitting; without them the table's own count. Rows are clustered in files of at most
    ``file_rows``, and the first and last (sequence, interval) of each file are kept, so that readers open only what they need.
    """
    path = _folder(path)
    order = [c for c in (KEY, "interval", "run", "i") if c in table.columns]
    table.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", file_rows).mode("overwrite").parquet(f"{path}/table")
    stored = table.sparkSession.read.parquet(f"{path}/table")
    capping, balancing = (params.length_capping, params.balancing) if params else (None, None)
    domain = F.sum("length") if "length" in table.columns else F.count("*")
    sizes = stored.agg(F.count("*").alias("rows"), F.coalesce(domain, F.lit(0)).cast("long").alias("domain"))
    before = runs.agg(F.count("*").alias("runs")) if runs is not None else sizes.select(F.col("rows").alias("runs"))
    about = sizes.join(before).select("rows", "runs", "domain", F.lit(VERSION).alias("version"), F.lit(capping).cast("double").alias("length_capping"), F.lit(balancing).cast("long").alias("balancing"))
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    place = F.struct(F.col(KEY).alias(KEY), F.col(order[1]).alias("at"))
    stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")
    return path


def about(spark: SparkSession, path: str) -> DataFrame:
    """The row about a stored table: rows, runs, domain, version, length_capping, balancing."""
    return spark.read.parquet(f"{_folder(path)}/about")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, SplitParams]:
    """(table, split parameters); ValueError for another version."""
    row = about(spark, path).first()
    if row["version"] != VERSION:
        raise ValueError(f"version {row['version']}, not {VERSION}")
    return spark.read.parquet(f"{_folder(path)}/table"), SplitParams(row["length_capping"], row["balancing"])


def load_at(spark: SparkSession, path: str, cursors: DataFrame) -> DataFrame:
    """The rows of a stored table in which ``cursors`` (seq_id, interval) lie: only files whose range holds one are read.

    The names of those files come to the driver, at most as many as the table has.
    """
    table, _ = load(spark, path)
    wanted = cursors.select(KEY, "interval").distinct()
    place = F.struct(F.col(KEY).alias(KEY), F.col("interval").alias("at"))
    files = spark.read.parquet(f"{_folder(path)}/files")
    hit = files.join(wanted.withColumn("_place", place), (F.col("_place") >= F.col("first")) & (F.col("_place") <= F.col("last")), "left_semi")
    names = [r["file"] for r in hit.select("file").collect()]
    found = spark.read.schema(table.schema).parquet(*[f"{_folder(path)}/table/{n}" for n in names]) if names else table.limit(0)
    return found.join(wanted, [KEY, "interval"], "left_semi")
