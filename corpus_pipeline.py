"""From raw documents to packed training sequences, a stage at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubewright.llm.common import discard, materialize, ship, small_batches
from cubewright.llm.decontaminate import stage_decontaminate
from cubewright.llm.langid import stage_language
from cubewright.llm.packing import stage_packing
from cubewright.llm.partenum import stage_near_duplicates
from cubewright.llm.substring import stage_substrings


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


#: Each takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("language", _shipped(stage_language)),
    ("near_duplicates", _shipped(stage_near_duplicates)),
    ("substrings", _shipped(stage_substrings)),
    ("decontaminate", _shipped(stage_decontaminate)),
    ("packing", _shipped(stage_packing)),
]

#: SQL can't express the stages; tests hold each stage against a plain version, on given and on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's result is written as Parquet and read again by the next."""
    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done, at = at, materialize(stage(spark, at, sf_dir), f"pipeline-{name}")
        discard(done)
    return STAGES[-1][1](spark, at, sf_dir)
