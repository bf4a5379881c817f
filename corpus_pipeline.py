"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, decontaminate, jaccard, langid, suffix_dedup
from pagewright.llm.common import saved
from pagewright.llm.queries import vocabulary

#: Texts with a smaller share of letters in one language than this are rejected.
LEAST_LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly in one known language; texts without a letter and mixtures go."""
    model = langid.fit(docs, F.lit(True))
    found = langid.predict(docs, model, lang_pred="__lang", score="__share")
    return found.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__share") >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies."""
    return jaccard.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that an earlier document has; n_chars follows."""
    return suffix_dedup.remove_repeats(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and token_ids of each document that is left."""
    encoded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), vocabulary(), ids="token_ids")
    return encoded.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
