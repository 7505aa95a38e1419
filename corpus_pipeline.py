"""A corpus pipeline of five stages, each one operator over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import pipeline

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", pipeline.quality_stage),
    ("n-gram Jaccard join", pipeline.near_copy_stage),
    ("secret scans", pipeline.secret_stage),
    ("mixing sources to target weights", pipeline.mix_stage),
    ("BPE encoding and decoding", pipeline.encode_stage),
]
#: No SQL: the stages train models, join sets and encode tokens. tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; what a stage keeps is written once and read by the next."""
    return pipeline.run(STAGES, spark, sf_dir)
