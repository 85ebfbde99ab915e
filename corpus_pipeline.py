"""Documents to token files: quality, near duplicates, decontamination, mixture, ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and read again as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agentlens.llm.common import table, without, written
from agentlens.llm.decontaminate import clean
from agentlens.llm.mixing import mixed
from agentlens.llm.near_dedup import near_dedup
from agentlens.llm.quality import accepted
from agentlens.llm.token_files import token_files


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, judged where they are read."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8); null ids stay."""
    return without(docs, near_dedup(docs, per_100=80).filter("NOT kept").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture has them: no source more than four times, as many words as before."""
    return mixed(docs, repeat_limit=4.0)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what the token files hold."""
    return token_files(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: Classifier, MinHash, tokenizer and edit distance are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
