"""Tables and intermediate results of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.workspace import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared work folder and read back: lost executors cannot lose it."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> int:
    """The number of partitions that shuffles of this session use."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
