"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import table
from codeloom.llm.conversation_repair import op11_conversation_repair
from codeloom.llm.decontamination import contamination
from codeloom.llm.embedding_dedup import op1_embedding_dedup
from codeloom.llm.importance import op13_importance_resample
from codeloom.llm.language import op6_language_id
from codeloom.llm.line_dedup import op10_line_dedup
from codeloom.llm.mixing import op7_mix_sources
from codeloom.llm.ngram_join import op4_ngram_join
from codeloom.llm.packing import op12_vector_best_fit
from codeloom.llm.sharding import op5_shuffle_shards
from codeloom.llm.token_counts import op3_section_tokens
from codeloom.llm.token_output import op2_token_files
from codeloom.llm.url_filter import SITE_RULES, judge


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    site = F.col("matched").isin([r.name for r in SITE_RULES])
    return pages.select("page_id", "host", "path", F.when(site, F.col("matched")).alias("rule"), "verdict")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_token_files": op2_token_files,
    "op3_section_tokens": op3_section_tokens,
    "op4_ngram_join": op4_ngram_join,
    "op5_shuffle_shards": op5_shuffle_shards,
    "op6_language_id": op6_language_id,
    "op7_mix_sources": op7_mix_sources,
    "op8_url_rules": op8_url_rules,
    "op9_decontaminate": op9_decontaminate,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_best_fit": op12_vector_best_fit,
    "op13_importance_resample": op13_importance_resample,
}
