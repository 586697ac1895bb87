"""The corpus pipeline: stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import staged, table
from codeloom.llm.decontamination import decontaminate
from codeloom.llm.language import identify, train
from codeloom.llm.mixing import take_whole
from codeloom.llm.ngram_join import first_of_groups
from codeloom.llm.token_output import write_tokens

LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told go: no letters, or no language is likelier than all others."""
    found = identify(docs, train(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return first_of_groups(docs)


def no_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more stand in benchmark windows go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take go."""
    return take_whole(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents, read back: id, first token, tokens, checksum of the ids."""
    rows = write_tokens(docs).read(spark)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_each_group),
    ("decontamination", no_benchmark_text),
    ("mixing", mixed_sources),
    ("token files", token_files),
]
#: Near duplicates need unbounded rounds and token ids a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else staged(docs, f"pipeline-{k}"), sf_dir)
    return docs
