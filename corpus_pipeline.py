"""From raw documents to token ids: quality, near copies, secrets, mixing and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediaops.llm import stages
from mediaops.llm.work import keep, table

#: (name, function): each takes (spark, docs, sf_dir), and its result is written and read as the next one's docs.
STAGES = [
    ("quality_rules", stages.quality),
    ("jaccard_join", stages.one_of_each),
    ("secrets", stages.without_secrets),
    ("source_mix", stages.mixed),
    ("pieces", stages.tokens),
]

#: SQL can express neither the models of the secret scan nor the tokenizer; a brute-force version tests the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of what is left of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
