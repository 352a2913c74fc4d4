"""The operators as queries over the test tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.columns import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from newsloom.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_repeated_phrases")
def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.phrases import repeat_digest

    return repeat_digest(table(spark, sf_dir, "documents"))


@query("op10_benchmark_matches")
def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _mixing_sql() -> str:
    from newsloom.llm.mixing import MIX_SQL

    return MIX_SQL.format(docs="documents")


@query("op3_mixing", sql=_mixing_sql())
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


@query("op7_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _fingerprint_sql() -> str:
    from newsloom.llm.fingerprint import fingerprint_sql

    return fingerprint_sql("documents")


@query("op1_fingerprints", sql=_fingerprint_sql())
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query("op2_near_copies")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.near_copies import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


@query("op8_language_model")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.lm import scores

    return scores(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_main_texts")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.pages import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


@query("op11_ball_hashing")
def ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.balls import near_fingerprints

    return near_fingerprints(table(spark, sf_dir, "documents"))


def _divergence_sql() -> str:
    from newsloom.llm.divergence import divergence_sql

    return divergence_sql("documents")


@query("op12_source_divergence", sql=_divergence_sql())
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.divergence import divergences

    return divergences(table(spark, sf_dir, "documents"))


def _resampling_sql() -> str:
    from newsloom.llm.resampling import resampling_sql

    return resampling_sql("documents", "benchmark")


@query("op13_resampling", sql=_resampling_sql())
def resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.resampling import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
