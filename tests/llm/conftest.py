"""Small tables with awkward rows: nulls in every column, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l", "")]


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    base = prose(1)
    rows = [
        (1, base, "en", "a", len(base)),
        (1, base, "en", "a", len(base)),
        (2, base, "en", "b", len(base)),
        (3, None, "en", "a", None),
        (4, "", None, "a", 0),
        (5, " \n\t", "fr", None, 3),
        (None, prose(2), "fr", "b", 1),
        (None, None, None, None, None),
        (6, prose(3, 40_000), "de", "b", 1),
        (7, "token = AbC123xYz9876 \U0001f600 é", "en", "a", 5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def saved(tmp_path):
    """Writes tables into a folder that stands for sf_dir."""

    def put(**tables: DataFrame) -> str:
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet", mode="overwrite")
        return str(tmp_path)

    return put
