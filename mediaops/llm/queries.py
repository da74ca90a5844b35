"""The queries of the corpus operators over the sample tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (jaccard_join, lexical_search, main_text, minhash, personal_data, pieces, quality_rules, repeats, secrets, source_mix, token_files,
               vector_search, whitening)
from .sql import oracle_sql  # noqa: F401
from .work import table, work_dir

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is, on this machine as on the executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = secrets.default_models(spark, secrets.ordinary_strings(table(spark, sf_dir, "benchmark")))
    return secrets.digest(table(spark, sf_dir, "documents"), models)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, path)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(vector_search.usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("id"), vector_search.quantized(F.col("embedding")).alias("vector"))
    return vector_search.top_k(rows, rows.where("id % 50 = 0"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), passage_words=51)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_classes(table(spark, sf_dir, "documents"), width=4)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_secrets, op2_personal_data, op3_repeats, op4_jaccard_join, op5_token_files, op6_main_text, op7_quality_rules,
    op8_source_mix, op9_pieces, op10_vector_search, op11_whitening, op12_lexical_search, op13_minhash)}
