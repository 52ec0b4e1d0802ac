"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runframe.llm import jaccard, langid, lines, mixing, packing
from runframe.llm.common import table, written

STAGES = [
    ("language ID", langid.reject),
    ("line dedup", lines.dedup_stage),
    ("n-gram Jaccard join", jaccard.keep_one_stage),
    ("mixing sources to target weights", mixing.mix_stage),
    ("packing", packing.pack_stage),
]

#: The learnt model of the first stage and the tokens of the last have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the corpus."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
