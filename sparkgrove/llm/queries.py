"""The registered queries of the operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkgrove.llm import exact_dedup, langid, mixing, pieces, ppm, repetition, secrets, simhash, toxicity, url_filter
from sparkgrove.tables import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(spark, table(spark, sf_dir, "documents"), width=3, radius=2)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(spark, table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(spark, table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(spark, table(spark, sf_dir, "documents"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(spark, table(spark, sf_dir, "documents"))


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(spark, table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.lsm_dedup(spark, table(spark, sf_dir, "documents"), keep="largest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_language": op4_language,
    "op5_url_filter": op5_url_filter,
    "op6_secrets": op6_secrets,
    "op7_ppm": op7_ppm,
    "op8_repetition": op8_repetition,
    "op9_pieces": op9_pieces,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLES: dict[str, str] = {"op3_mixing": mixing.SQL, "op6_secrets": secrets.SQL, "op10_exact_dedup": exact_dedup.SQL}
