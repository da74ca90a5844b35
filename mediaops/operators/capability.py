"""Choosing encoders, codecs and decode routes from evidence tables.

Evidence is first reduced to one row per host (or shape) with a fixed set of
flags. The keys and flags are few and known, so the reduction is a partial
aggregation and what remains is a lookup table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from .joins import lookup_join

SHAPE = ["backend", "codec", "profile", "pix_fmt"]


def _working_flags(capability: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with a flag for each backend: does it work?"""
    return capability.groupBy(*keys).agg(*[
        F.max((F.col("backend") == b) & F.col("works")).alias(f"_{b}") for b in codecs.BACKENDS
    ])


def resolve_encoder(requests: DataFrame, capability: DataFrame, *, platform: str = "linux",
                    key: str = "request_id") -> DataFrame:
    """Add ``encoder`` and ``backend`` (``''`` = software) to each request.

    ``requests`` has ``host``, ``codec`` and ``hwaccel``; ``capability`` has one row
    per (host, codec, backend) tested. ``auto`` takes the platform's most preferred
    working backend, a named backend only itself; software otherwise.
    """
    flags = _working_flags(
        capability.withColumn("_base", codecs.codec_name(F.col("codec"))), ["host", "_base"]
    )
    known = requests.withColumn("_base", codecs.codec_name(F.col("codec")))
    joined = lookup_join(known, flags, ["host", "_base"], spread_by=[key])
    mode = F.lower("hwaccel")
    auto = F.coalesce(*[F.when(F.col(f"_{b}"), F.lit(b)) for b in codecs.BACKEND_PRIORITY[platform]])
    named = F.coalesce(*[F.when((mode == b) & F.col(f"_{b}"), F.lit(b)) for b in codecs.BACKENDS])
    backend = F.when(mode.isin(codecs.SOFTWARE_MODES), F.lit("")).when(mode == "auto", auto).otherwise(named)
    chosen = joined.withColumn("backend", F.coalesce(backend, F.lit("")))
    encoder = F.when(F.col("backend") != "", codecs.hardware_encoder(F.col("codec"), F.col("backend")))
    return chosen.select(
        *requests.columns,
        F.coalesce(encoder, codecs.software_encoder(F.col("codec"))).alias("encoder"),
        "backend",
    )


def resolve_codec(requests: DataFrame, capability: DataFrame, *, platform: str = "linux",
                  key: str = "request_id") -> DataFrame:
    """Add ``resolved_codec``: under ``auto`` the first codec, from the requested one
    down the chain, for which the host has a working hardware encoder."""
    usable = F.col("works") & F.col("backend").isin(codecs.BACKEND_PRIORITY[platform])
    flags = capability.groupBy("host").agg(*[
        F.max((codecs.codec_name(F.col("codec")) == c) & usable).alias(f"_has_{c}") for c in codecs.CODEC_CHAIN
    ])
    joined = lookup_join(requests, flags, ["host"], spread_by=[key])
    base = codecs.codec_name(F.col("codec"))
    picked = None
    for ix, start in enumerate(codecs.CODEC_CHAIN):
        rest = F.coalesce(*[F.when(F.col(f"_has_{c}"), F.lit(c)) for c in codecs.CODEC_CHAIN[ix:]], F.col("codec"))
        picked = F.when(base == start, rest) if picked is None else picked.when(base == start, rest)
    resolved = F.when(F.lower("hwaccel") == "auto", picked.otherwise(F.col("codec"))).otherwise(F.col("codec"))
    return joined.select(*requests.columns, resolved.alias("resolved_codec"))


def distinct_shapes(files: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Work list for decode probing: one sample path and the file count per shape.

    Only shapes whose answer would be used: the backend decodes, hardware decoding is not switched off, the
    pipeline carries the format (10 bits only where the encoder takes them), and no verdict is known yet.
    """
    depth = F.col("surface_depth")
    asked = (
        F.col("probe_ok") & (F.col("pix_fmt") != "") & F.col("backend").isin(codecs.DECODE_BACKENDS)
        & (F.lower(F.coalesce("hwdecode", F.lit(""))) != "off")
        & ((depth == 8) | ((depth == 10) & F.coalesce("main10", F.lit(False))))
    )
    shapes = (
        files.filter(asked).groupBy("backend", F.col("video_codec").alias("codec"), "profile", "pix_fmt")
        .agg(F.min("path").alias("sample_path"), F.count(F.lit(1)).alias("files"))
    )
    return shapes if verdicts is None else shapes.join(verdicts.filter("verdict IS NOT NULL"), SHAPE, "left_anti")


def shape_verdict(evidence: DataFrame) -> DataFrame:
    """Can a backend decode a shape? True, false, or NULL for unknown.

    The latest decisive row counts: a completed positive or negative, or an
    eviction, which forgets what was known. Timeouts and cancellations say
    nothing. Backends that only encode never decode.
    """
    decisive = evidence.filter(F.col("outcome").isin("positive", "negative", "evict"))
    # As a number the outcome fits a hash aggregation, which a text does not.
    code = F.when(F.col("outcome") == "positive", 1).when(F.col("outcome") == "negative", 0).otherwise(-1)
    latest = decisive.groupBy(*SHAPE).agg(F.max_by(code, "seq").alias("_outcome"))
    verdict = (
        F.when(~F.col("backend").isin(codecs.DECODE_BACKENDS), F.lit(False))
        .when(F.col("_outcome") >= 0, F.col("_outcome") == 1)
    )
    return latest.select(*SHAPE, verdict.alias("verdict"))


def encoder_verdict(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Known-good encoders: a success is kept for good, a failure proves nothing."""
    return evidence.filter(F.col("outcome") == "positive").select(*keys).distinct().withColumn("works", F.lit(True))


def retry_evictions(attempts: DataFrame) -> DataFrame:
    """Evidence rows that forget a shape whose hardware decode failed while running."""
    failed = attempts.filter(earns_retry())
    return failed.select(
        F.col("decode_backend").alias("backend"), "codec", "profile", "pix_fmt", "seq", F.lit("evict").alias("outcome")
    )


def earns_retry() -> Column:
    """A hardware-decoding attempt that the encoder itself failed, in a run not cancelled."""
    return (
        (F.col("status") == "failed") & (F.col("error_kind") == "exec")
        & (F.col("decode_backend") != "") & ~F.col("cancelled")
    )


def decode_route(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Settle how each file is decoded and encoded.

    ``files`` has the resolved ``codec``, ``encoder``, ``backend``, ``preset``,
    ``hwdecode`` and ``main10`` (can the encoder take 10 bits?) next to the
    attributes. Shapes the device cannot carry faithfully go to software as a
    whole, with a preset the software encoder offers. Adds ``route_encoder``,
    ``route_backend``, ``decode_backend``, ``source_bit_depth`` and ``route_preset``.
    """
    shapes = verdicts.select(
        "backend", F.col("codec").alias("video_codec"), "profile", "pix_fmt", F.col("verdict").alias("_verdict")
    )
    joined = lookup_join(files, shapes, ["backend", "video_codec", "profile", "pix_fmt"], spread_by=["path"])
    known = (F.col("backend") != "") & F.col("probe_ok") & (F.coalesce("pix_fmt", F.lit("")) != "")
    depth = F.col("surface_depth")
    software = known & ((depth == 0) | ((depth == 10) & ~F.coalesce("main10", F.lit(False))))
    routed = joined.withColumns({"_known": known, "_software": software})
    hardware = F.col("_known") & ~F.col("_software")
    decodes = hardware & (F.lower("hwdecode") != "off") & F.coalesce("_verdict", F.lit(False))
    own = codecs.software_encoder(F.col("codec"))
    return routed.select(
        *files.columns,
        F.when(F.col("_software"), own).otherwise(F.col("encoder")).alias("route_encoder"),
        F.when(F.col("_software"), F.lit("")).otherwise(F.col("backend")).alias("route_backend"),
        F.when(decodes, F.col("backend")).otherwise(F.lit("")).alias("decode_backend"),
        F.when(hardware, depth).otherwise(F.lit(0)).alias("source_bit_depth"),
        F.when(F.col("_software"), codecs.valid_preset(F.lit(""), own, F.col("preset")))
        .otherwise(F.col("preset")).alias("route_preset"),
    )


def resource_profile(df: DataFrame) -> DataFrame:
    """Add where decoding runs (``decode_hw``, ``decode_label``) and ``warn`` when
    software decoding would load the processor next to a hardware encoder."""
    hardware = (
        (F.col("backend") != "") & (F.lower("hwdecode") != "off") & F.col("backend").isin(codecs.DECODE_BACKENDS)
    )
    threads = F.col("decode_threads")
    unit = F.when(threads == 1, F.lit("thread")).otherwise(F.lit("threads"))
    label = (
        F.when(F.col("decode_hw"), F.concat(F.lit("hw: "), F.col("backend"), F.lit(" (per-file, may fall back)")))
        .when(threads > 0, F.concat(F.lit("software (capped at "), threads.cast("string"), F.lit(" "), unit, F.lit(")")))
        .otherwise(F.lit("software (uncapped)"))
    )
    return df.withColumn("decode_hw", hardware).withColumns({
        "warn": (F.col("backend") != "") & ~F.col("decode_hw"),
        "decode_label": label,
    })
