"""Tables that are written once and read again, where a plan would compute them several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; under the warehouse only where that is unset (one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{base.rstrip('/')}/wordwave-{uuid.uuid4().hex}"


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` from a table that is written now, in folders by a column if asked: later plans read it instead of computing it again."""
    path = folder(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
