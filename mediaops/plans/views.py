"""The derived tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, probe
from . import tables as t


class Views:
    """Derived tables over one folder of sample tables, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return t.table(self.spark, self.sf_dir, name)

    def library(self) -> DataFrame:
        return t.select(self.table("orders"), t.LIBRARY)

    def probe_text(self) -> DataFrame:
        return t.select(self.library(), t.PROBE_TEXT)

    def listing(self) -> DataFrame:
        """Every existing path: the library and some finished outputs."""
        library = self.library()
        outputs = library.filter("file_id % 29 = 0").select(
            F.expr("regexp_replace(path, '\\\\.[^./]*$', '') || '.out.' || regexp_extract(path, '([^./]*)$', 1)").alias("path")
        )
        return library.select("path").unionByName(outputs)

    def transcodes(self) -> DataFrame:
        joined = self.table("lineitem").join(self.library(), F.col("l_orderkey") == F.col("file_id"))
        return t.select(joined, t.TRANSCODES)

    def runs(self) -> DataFrame:
        return t.select(self.table("customer"), t.RUNS)

    def jobs(self) -> DataFrame:
        both = t.select(self.table("orders"), [*t.LIBRARY, ("o_orderpriority", "o_orderpriority")])
        return t.select(both, t.JOBS)

    def progress(self) -> DataFrame:
        return t.select(self.table("events"), t.PROGRESS)

    def evidence(self) -> DataFrame:
        return t.select(self.table("events"), t.EVIDENCE)

    def programs(self) -> DataFrame:
        return t.select(self.table("customer"), t.PROGRAMS)

    def region_programs(self) -> DataFrame:
        return t.select(self.table("region"), t.REGION_PROGRAMS)

    def draft_programs(self) -> DataFrame:
        return t.select(self.table("part"), t.DRAFT_PROGRAMS)

    def rule_lines(self) -> DataFrame:
        return t.select(self.table("orders"), t.RULE_LINES)

    def scripts(self) -> DataFrame:
        return t.select(self.table("customer"), t.SCRIPTS)

    def user_profiles(self) -> DataFrame:
        return _with_extra_args(t.select(self.table("supplier"), t.USER_PROFILES))

    def job_specs(self) -> DataFrame:
        return _with_lists(t.select(self.table("orders"), t.JOB_SPECS), extra_text="extra_args", ext_text="ext", skip_text="skip_source_codecs")

    def env_layer(self) -> DataFrame:
        return t.select(self.table("customer"), t.ENV_LAYER)

    def config_layer(self) -> DataFrame:
        return _with_lists(t.select(self.table("nation"), t.CONFIG_LAYER), ext_text="ext", skip_text="skip_source_codecs")

    def capability(self) -> DataFrame:
        """What was tested on each host (supplier): every codec on every backend."""
        tested = self.table("supplier").selectExpr(
            "s_suppkey AS host", "posexplode(array('av1', 'hevc', 'h264')) AS (codec_ix, codec)"
        ).selectExpr(
            "*", "posexplode(array('nvenc', 'qsv', 'vaapi', 'amf', 'videotoolbox')) AS (backend_ix, backend)"
        )
        return tested.selectExpr(
            "host", "codec", "backend",
            "(host * 7 + codec_ix * 3 + backend_ix * 5) % 6 = 0 AS works", "(host + codec_ix + backend_ix) % 3 = 0 AS main10",
        )

    def host_jobs(self) -> DataFrame:
        jobs = _with_lists(t.select(self.table("supplier"), t.HOST_JOBS), ext_text="ext", skip_text="skip_source_codecs")
        return jobs.withColumn("extra_args", F.array().cast("array<string>"))

    def requests(self) -> DataFrame:
        return t.select(self.table("lineitem"), t.REQUESTS)

    def routed(self) -> DataFrame:
        files = _with_extra_args(t.select(self.library(), t.ROUTED))
        encoder = F.when(F.col("backend") == "", codecs.software_encoder(F.col("codec"))).otherwise(
            codecs.hardware_encoder(F.col("codec"), F.col("backend"))
        )
        return files.withColumns({"encoder": encoder, "surface_depth": probe.surface_depth(F.col("pix_fmt"))})


def _with_extra_args(df: DataFrame) -> DataFrame:
    return _with_lists(df, extra_text="extra_args")


def _with_lists(df: DataFrame, **names: str) -> DataFrame:
    """The words of text columns as lists under other names: NULL stays NULL, '' is an empty list."""
    words = {name: F.filter(F.split(text, " "), lambda w: w != "") for text, name in names.items()}
    return df.withColumns(words).drop(*names)
