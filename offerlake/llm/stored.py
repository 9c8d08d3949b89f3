"""Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from offerlake.session import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the session's checkpoint folder, and read again."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a number of its own for every row, written so that the numbers stay."""
    return stored(df.withColumn(column, F.monotonically_increasing_id()), "numbered")
