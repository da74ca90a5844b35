"""The stages of the corpus pipeline: documents in, documents out, and token ids at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, pieces, quality_rules, secrets, source_mix
from .queries import tokenizer_path
from .work import table


def _measured(documents: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return documents.withColumn("n_chars", F.length("text").cast("long")).select(*documents.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines that their host repeats too often go from the others."""
    return _measured(quality_rules.quality_filter(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links the one of the smallest id stays, of repeated rows one; rows without id stay."""
    classes = jaccard_join.jaccard_classes(docs)
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    models = secrets.default_models(spark, secrets.ordinary_strings(table(spark, sf_dir, "benchmark")))
    return _measured(secrets.redact(docs, models))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document in whole copies, dealt so that each source gives about its words of the mix; rows without id take part."""
    return source_mix.mixed_documents(docs, seed=0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded_sha256) of every document."""
    encoded = pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
