"""The append-only ledger: attempts, run events and job events as parquet tables.

Rows are only ever added; current states are derived (see ``operators.runs``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.columns import format_epoch
from ..functions.progress import error_tail


def conform(df: DataFrame, schema: StructType, fill: dict | None = None) -> DataFrame:
    """Columns of ``schema`` in order; absent ones filled or NULL."""
    fill = fill or {}
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(fill.get(f.name))).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def append_history(attempts: DataFrame, location: str) -> None:
    """Append finished attempts, partitioned by the month they completed in.

    The rebalance step gives every month files of a good size: small months share
    a task, a month with most of the rows is split over several.
    """
    rows = conform(attempts, schemas.HISTORY, {
        "source_codec": "", "backend": "", "preset": "", "duration_ms": 0, "error_msg": "", "output_path": "",
    })
    rows = rows.withColumns({
        "error_msg": error_tail(F.col("error_msg")),
        "completed_month": format_epoch(F.col("completed_at"), "yyyy-MM"),
    })
    balanced = rows.hint("rebalance", "completed_month")
    balanced.write.mode("append").partitionBy("completed_month").parquet(location)


def read_history(spark: SparkSession, location: str) -> DataFrame:
    schema = schemas.with_field(schemas.HISTORY, "completed_month", schemas.TEXT)
    return spark.read.schema(schema).parquet(location)


def history_months(spark: SparkSession, location: str) -> list[str]:
    """The months of the stored history, newest first, by the names of its folders; no data is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [entry.getPath().getName() for entry in found]
    return sorted((n.partition("=")[2] for n in names if n.startswith("completed_month=")), reverse=True)


def append_job_events(events: DataFrame, location: str, batch_id: int | None = None) -> None:
    """Append job events; a streaming batch replaces its own folder when it is repeated."""
    _append(conform(events, schemas.JOB_EVENTS), location, batch_id)


def append_run_events(events: DataFrame, location: str, batch_id: int | None = None) -> None:
    _append(conform(events, schemas.RUN_EVENTS), location, batch_id)


def _append(rows: DataFrame, location: str, batch_id: int | None) -> None:
    if batch_id is None:
        rows.write.mode("append").parquet(f"{location}/batch_id=-1")
    else:
        rows.write.mode("overwrite").parquet(f"{location}/batch_id={batch_id}")


def read_job_events(spark: SparkSession, location: str) -> DataFrame:
    return _read(spark, location, schemas.JOB_EVENTS)


def read_run_events(spark: SparkSession, location: str) -> DataFrame:
    return _read(spark, location, schemas.RUN_EVENTS)


def _read(spark: SparkSession, location: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schemas.with_field(schema, "batch_id")).parquet(location).drop("batch_id")
