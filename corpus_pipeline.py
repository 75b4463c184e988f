"""A corpus pipeline of five stages: language, near copies, secrets, mixture and packing.

Each stage takes (spark, docs, sf_dir), with docs read from Parquet, and works on all its predecessor kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bagminhash, common, langid, mixing, packing, secrets

STAGES = [
    ("language", langid.stage),
    ("near_dedup", bagminhash.stage),
    ("secrets", secrets.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Models, signatures and packing are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None
