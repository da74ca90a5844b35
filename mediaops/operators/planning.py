"""What is left to do in a library, and why the rest is skipped or blocked."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, paths
from ..functions.columns import as_column, is_true
from .joins import mark_present


@dataclass(frozen=True)
class PlanSettings:
    """Settings of a run. Each may be a value or a Column over the inventory rows.

    With Columns one plan serves many jobs at once. Tests that no setting can
    make relevant are left out of the plan altogether.
    """

    codec: str | Column = "h265"
    inplace: bool | Column = False
    force: bool | Column = False
    suffix: str | Column = ".out"
    output_dir: str | Column = ""
    container: str | Column = ""
    skip_source_codecs: list[str] | Column = field(default_factory=list)
    skip_hardlinked: bool | Column = False
    allow_hdr_loss: bool | Column = False
    crf: int | Column = 23

    def column(self, name: str) -> Column:
        return as_column(getattr(self, name))

    @classmethod
    def from_columns(cls, df: DataFrame) -> PlanSettings:
        """Settings taken from the columns of the same names, defaults for the others."""
        return cls(**{f.name: F.col(f.name) for f in fields(cls) if f.name in df.columns})


def with_output_path(inventory: DataFrame, settings: PlanSettings) -> DataFrame:
    """Add ``output_path``, the final destination of each file."""
    return inventory.withColumn("output_path", paths.output_path(
        F.col("path"), F.col("rel_path"),
        inplace=settings.column("inplace"), output_dir=settings.column("output_dir"),
        suffix=settings.column("suffix"), container=settings.column("container"),
    ))


def plan(inventory: DataFrame, settings: PlanSettings, *, history: DataFrame | None = None,
         listing: DataFrame | None = None, present: Column | None = None) -> DataFrame:
    """Add ``output_path``, ``decision`` (todo, skipped, blocked) and ``reason``.

    ``inventory`` carries the attribute columns (NULL after a failed probe).
    ``listing`` is every existing path, not filtered by extension; ``history`` the
    stored attempts. Where the rows themselves know whether their output exists (alongside) or they are done (in place),
    ``present`` says so and neither is needed. No row is dropped: callers filter ``decision = 'todo'``.

    Alongside the source, files are skipped for own_output, output_exists (not
    when forced) and source_denylist. In place, force keeps everything; otherwise
    hardlinked, history_done, already_target and source_denylist apply. Dolby
    Vision sources are blocked last in both modes unless that loss is accepted.
    """
    inplace, force = settings.column("inplace"), settings.column("force")
    planned = with_output_path(inventory, settings)

    exists = done = F.lit(False) if present is None else is_true(present)
    if listing is not None and settings.inplace is not True and settings.force is not True:
        planned = mark_present(planned, listing.select("path"), {"path": F.col("output_path")}, "_exists")
        exists = F.col("_exists")
    if history is not None and settings.inplace is not False and settings.force is not True:
        finished = history.filter(F.col("status") == "done").select("source_path", "source_mtime")
        planned = mark_present(
            planned, finished, {"source_path": F.col("path"), "source_mtime": F.col("mtime")}, "_done"
        )
        done = F.col("_done")

    codec = F.col("video_codec")
    target = codecs.codec_name(settings.column("codec"))
    denied = is_true(codecs.is_denied_codec(codec, settings.skip_source_codecs))
    skip_alongside = (
        F.when(paths.is_own_output(F.col("path"), settings.column("suffix")), F.lit("own_output"))
        .when(exists & ~force, F.lit("output_exists"))
        .when(denied, F.lit("source_denylist"))
    )
    skip_inplace = (
        F.when(force, F.lit(None).cast("string"))
        .when(settings.column("skip_hardlinked") & (F.col("links") > 1), F.lit("hardlinked"))
        .when(done, F.lit("history_done"))
        .when(is_true((target != "") & (codec == target)), F.lit("already_target"))
        .when(denied, F.lit("source_denylist"))
    )
    blocked = ~settings.column("allow_hdr_loss") & is_true(F.col("dolby_vision"))
    return (
        planned.withColumn("_skip", F.when(inplace, skip_inplace).otherwise(skip_alongside))
        .withColumns({
            "decision": F.when(F.col("_skip").isNotNull(), F.lit("skipped"))
            .when(blocked, F.lit("blocked")).otherwise(F.lit("todo")),
            "reason": F.coalesce("_skip", F.when(blocked, F.lit("dolby_vision"))),
        })
        .drop("_skip", "_exists", "_done")
    )


def plan_summary(planned: DataFrame) -> DataFrame:
    """Files per decision and reason."""
    return planned.groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("files"))


def plan_listing(planned: DataFrame, settings: PlanSettings) -> DataFrame:
    """The dry run: source, destination, working file and main settings of what would be done."""
    return planned.filter(F.col("decision") == "todo").select(
        F.col("path").alias("src"),
        F.col("output_path").alias("dst"),
        paths.transient_path(F.col("output_path"), F.col("path")).alias("working"),
        settings.column("codec").alias("codec"),
        settings.column("crf").cast("int").alias("crf"),
    )


def orphan_artifacts(listing: DataFrame, extensions: list[str]) -> DataFrame:
    """Working files that interrupted encodes left behind; symlinks are not counted."""
    wanted = sorted({e.lower().lstrip(".") for e in extensions})
    found = listing.filter(
        paths.bare_ext(F.col("path")).isin(wanted) & paths.stem(F.col("path")).endswith(paths.TRANSIENT_MARK)
    )
    return found.filter(~F.col("is_symlink")) if "is_symlink" in listing.columns else found
