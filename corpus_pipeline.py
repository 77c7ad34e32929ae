"""The corpus pipeline: language ID, near-duplicate removal, repeated-passage removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes every stage's rows to the shared scratch folder and reads them again,
so that a stage depends on files and not on the plans before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfabric.llm import lang_id, ngram_join, packing, source_mixing, substring_dedup
from wayfabric.scratch import materialize

#: Documents whose best language holds a smaller share of their words are rejected.
LEAST_LANGUAGE_SHARE = 0.5
#: Share of all tokens that the mix keeps; no document is repeated.
MIX_BUDGET, MIX_EPOCHS = 0.9, 1
MIX_WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; the model learns from the languages of the rows given."""
    model = lang_id.learn(lang_id.train_rows(docs))
    return lang_id.keep_identified(docs, model, LEAST_LANGUAGE_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard 0.8 or more)."""
    return ngram_join.keep_one_per_group(docs, 5, 80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that start anywhere else; those of which nothing is left go."""
    cut = substring_dedup.cut_texts(docs)
    left = cut.where(F.col("text").isNull() | (F.trim("text") != "") | (F.col("n_chars") == 0))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights of the domain, language and source tree."""
    levels = {"domain": source_mixing.source_domain(), "lang": F.col("lang"), "source": F.col("source")}
    out = source_mixing.mix(docs, levels, MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS)
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packed", packed),
]

#: SQL cannot express the stages; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
