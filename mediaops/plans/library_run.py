"""A library run: from an inventory to the commands for an encoder, in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import codec_name
from ..operators.attributes import attach_attrs
from ..operators.capability import decode_route, resolve_codec, resolve_encoder
from ..operators.joins import lookup_join
from ..operators.planning import PlanSettings, plan
from ..operators.work_orders import work_orders
from ..sources.inventory import bare_extensions

DECIDING_ATTRS = ["probe_ok", "video_codec", "profile", "pix_fmt", "surface_depth", "dolby_vision"]


def resolve_jobs(settings: DataFrame, capability: DataFrame, platform: str = "linux") -> DataFrame:
    """Settings of each job (with its ``host``) with codec, encoder and 10-bit ability settled."""
    chosen = resolve_codec(settings, capability, platform=platform, key="job_id")
    chosen = chosen.withColumn("codec", F.col("resolved_codec")).drop("resolved_codec")
    chosen = resolve_encoder(chosen, capability, platform=platform, key="job_id")
    ten_bit = capability.filter("main10").select(
        "host", F.concat_ws("_", codec_name(F.col("codec")), "backend").alias("encoder"), F.lit(True).alias("main10")
    ).distinct()
    return lookup_join(chosen, ten_bit, ["host", "encoder"], spread_by=["job_id"])


def library_run(inventory: DataFrame, attrs: DataFrame, settings: DataFrame, capability: DataFrame,
                verdicts: DataFrame, *, history: DataFrame | None = None, listing: DataFrame | None = None,
                platform: str = "linux") -> DataFrame:
    """Plan every file under the settings of its job and attach the command of each one to do.

    ``inventory`` names each file's ``job_id``; ``settings`` is the output of
    ``resolve_settings`` with the ``host`` of each job. The codec a host can encode
    in hardware is settled before planning, so that the already-in-target test
    looks for what would really be produced. Files whose ``ext`` is not among those of their job are not part of the run.
    """
    jobs = resolve_jobs(settings, capability, platform)
    # Files and settings both have an audio_codec and a profile. Of the files only what the
    # decisions need is taken, of the settings all but the name of their profile.
    jobs = jobs.drop("profile", "profile_known")
    known = attach_attrs(inventory, attrs.select("path", *DECIDING_ATTRS))
    if "ext" in jobs.columns:
        # Spelled once per job, not once per file.
        jobs = jobs.withColumn("_exts", bare_extensions(F.col("ext"))).drop("ext")
    files = lookup_join(known, jobs, ["job_id"], spread_by=["path"], how="inner")
    if "_exts" in files.columns:
        files = (files.filter(F.array_contains("_exts", F.lower("ext"))) if "ext" in inventory.columns else files).drop("_exts")
    planned = plan(files, PlanSettings.from_columns(files), history=history, listing=listing)
    routed = decode_route(planned, verdicts)
    ready = routed.withColumns({
        "encoder": F.col("route_encoder"), "backend": F.col("route_backend"), "preset": F.col("route_preset"),
    }).drop("route_encoder", "route_backend", "route_preset")
    orders = work_orders(ready)
    return orders.withColumn("args", F.when(F.col("decision") == "todo", F.col("args")))
