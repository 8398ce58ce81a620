"""A training-corpus pipeline over `documents`: language, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, language, packing, pii, simhash
from waymark.llm.common import materialise, table
from waymark.llm.queries import tokenizer_path

#: A text is rejected if its best language is not more probable than chance by this share of what is left above chance, or if it has no letter.
ABOVE_CHANCE = 0.02


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; the network learns from their own labels, and lang itself stays as it is.

    What counts is the score above chance, so that few and many languages are treated alike. A null text is in no language; repeated rows
    are judged one by one.
    """
    columns, net = docs.columns, language.learn(docs)
    chance = 1 / max(2, len(net.languages))
    least = chance + ABOVE_CHANCE * (1 - chance)
    judged = language.identify(docs, net)
    return judged.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= least)).select(*columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id from each group of linked fingerprints."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than four fifths of the shingles of each benchmark item; null texts hold none, repeated rows are judged one by one."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets and n_chars counted again."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; a null text is an empty one, repeated rows are packed one by one."""
    return packing.pack(docs, tokenizer_path(), with_ids=False).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("benchmark", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Fingerprints, trained models and tokens are beyond SQL; tests compare the result with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the result of each stage before it is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
