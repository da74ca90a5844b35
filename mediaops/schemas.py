"""Schemas of the tables the operators exchange.

Times are unix seconds (BIGINT) in stored tables. NULL attributes mean the probe
failed; ``''`` and 0 mean it succeeded and found no such stream.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

TEXT, BIG, INT, REAL, FLAG = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType()
TEXTS = ArrayType(TEXT)


def table(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


def with_field(schema: StructType, name: str, kind: DataType = BIG) -> StructType:
    """A copy of the schema with one more column."""
    return StructType([*schema.fields, StructField(name, kind)])


INVENTORY = table(
    path=TEXT, rel_path=TEXT, ext=TEXT, size=BIG, mtime=BIG, mode=INT, links=BIG, is_symlink=FLAG,
)

PROBE_TEXT = table(path=TEXT, text=TEXT)

CONDITION = table(field=TEXT, op=TEXT, value=TEXT)
CONDITIONS = ArrayType(CONDITION)
RULES = ArrayType(table(when=CONDITIONS, do=table(cmd=TEXT, args=TEXTS)))

PROGRAMS = table(
    id=TEXT, name=TEXT, schedule=TEXT, src=TEXT, ext=TEXT, rules_json=TEXT, created_at=BIG, updated_at=BIG,
)

HISTORY = table(
    source_path=TEXT, source_mtime=BIG, source_size=BIG, source_codec=TEXT, output_path=TEXT, output_size=BIG,
    target_codec=TEXT, encoder=TEXT, backend=TEXT, crf=INT, preset=TEXT, duration_ms=BIG, elapsed_ms=BIG,
    status=TEXT, error_msg=TEXT, completed_at=BIG,
)

RUN_EVENTS = table(
    run_id=TEXT, name=TEXT, run_kind=TEXT, event=TEXT, total=BIG, ok=BIG, failed=BIG, skipped=BIG, at=BIG,
)

JOB_EVENTS = table(run_id=TEXT, source_path=TEXT, status=TEXT, pct=REAL, speed=TEXT, ts=BIG, seq=BIG)

PROFILES = table(
    name=TEXT, description=TEXT, codec=TEXT, crf=INT, preset=TEXT, audio_codec=TEXT, audio_bitrate=TEXT,
    container=TEXT, subs=TEXT, extra_args=TEXTS,
)
