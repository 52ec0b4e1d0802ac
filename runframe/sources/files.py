"""Files of bytes and of little-endian 32-bit numbers, in byte ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import KEY

#: Bytes of one partition, and bytes that become rows at once.
RANGE, CHUNK = 8 << 20, 1 << 20


class Range(InputPartition):
    """Bytes of a file from ``start`` to ``end``."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__(0)
        self.path, self.start, self.end = path, start, end


def _opened(path: str):
    """(file system, path in it), for a URI of any file system that Arrow knows or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path)


class RangeReader(DataSourceReader):
    """Numbers of ``width`` bytes of all files of a folder (but for hidden ones), or of one file; a partition is a byte range."""

    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("width", 1))
        self.range = max(1, int(options.get("range", RANGE)) // self.width) * self.width

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = _opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.is_file and f.base_name[0] not in "._")
        for name, size in files:
            if size % self.width:
                raise ValueError(f"{name} has {size} bytes, no multiple of {self.width}")
        return [Range(name, at, min(at + self.range, size)) for name, size in files for at in range(0, size, self.range)]

    def read(self, partition: Range):
        system = _opened(self.path)[0]
        with system.open_input_file(partition.path) as file:
            file.seek(partition.start)
            for at in range(partition.start, partition.end, CHUNK):
                data = file.read(min(CHUNK, partition.end - at))
                values = np.frombuffer(data, "u1" if self.width == 1 else f"<u{self.width}").astype(np.int64)
                first = at // self.width
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(values), pa.string()), pa.array(np.arange(first, first + len(values))), pa.array(values)], ["path", "i", "value"])


class NumberFiles(DataSource):
    """``spark.read.format("runframe_numbers")`` with the options path, width (1 or 4) and range."""

    @classmethod
    def name(cls) -> str:
        return "runframe_numbers"

    def schema(self) -> str:
        return "path string, i long, value long"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def read_numbers(spark: SparkSession, path: str, width: int = 1, size: int = RANGE) -> DataFrame:
    """(path, i, value) of the numbers of ``width`` bytes in the files under ``path``, each cut into ranges of ``size`` bytes.

    The file system must be one that Arrow opens on the executors. Empty files have no rows; ValueError for a file with a broken number.
    """
    spark.dataSource.register(NumberFiles)
    return spark.read.format("runframe_numbers").option("width", str(width)).option("range", str(size)).option("path", path).load()


def read_symbols(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(seq_id, i, ch) with path: the bytes of files as symbols; seq_id is a hash of the path."""
    return read_numbers(spark, path, 1, size).select(F.xxhash64("path").alias(KEY), "i", F.char("value").alias("ch"), "path")


def read_suffix_array(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(seq_id, i, sa) with path: the 32-bit numbers of files."""
    return read_numbers(spark, path, 4, size).select(F.xxhash64("path").alias(KEY), "i", F.col("value").alias("sa"), "path")
