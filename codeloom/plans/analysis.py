"""The whole analysis of a corpus, from raw files to reports and points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom import constants as K
from codeloom import schemas
from codeloom.functions import vectors
from codeloom.operators import inference, report, search
from codeloom.operators.chunking import chunk_files
from codeloom.operators.functions import explode_top_functions, profile_modules
from codeloom.operators.ranking import cap_files
from codeloom.session import measured_stage, stage
from codeloom.sources import tables
from codeloom.sources.caches import CacheTable, open_cache
from codeloom.sources.corpus import scan_files
from codeloom.sources.reports import write_groups, write_reports


@dataclass(frozen=True)
class Analysis:
    """Written results of a run; ``rejects`` holds inputs a model never answered.

    ``metrics`` tells rows and characters of the stages, observed as they were written.
    """

    modules: DataFrame
    chunks: DataFrame
    points: DataFrame
    prompts: DataFrame
    reports: DataFrame
    groups: DataFrame
    rejects: DataFrame
    metrics: dict[str, dict[str, int]]


def describe_modules(
    modules: DataFrame, summary_cache: DataFrame | CacheTable, model: str, folder: str, make_describer=None
) -> tuple[DataFrame, inference.Inferred]:
    """Replace the bodies of all top functions by their descriptions.

    A function is keyed by its hash for the lookup and by its file for the way back;
    each file has twelve at most.
    """
    hashed = inference.with_method_hash(explode_top_functions(modules))
    functions = stage(hashed, f"{folder}/functions")
    found = inference.describe_cached(
        functions, summary_cache, model, folder, make_describer
    )
    described = inference.put_back(functions.drop("body_short"), found.entries)
    entry = F.struct(
        "rank", "name", "signature", "start_line", "loc", "cyclomatic", "description",
        F.lit(K.FUNCTION_CONFIDENCE).alias("confidence"),
    )
    tops = described.groupBy("repo", "path").agg(F.sort_array(F.collect_list(entry)).alias("t"))
    listed = F.transform("t", lambda x: x.dropFields("rank"))
    none = F.array().cast(f"array<{schemas.TOP_FUNCTION}>")
    joined = modules.drop("top_functions").join(tops, ["repo", "path"], "left")
    return joined.withColumn("top_functions", F.coalesce(listed, none)).drop("t"), found


def retrieve(
    points: DataFrame,
    make_embedder: Callable,
    folder: str,
    query: str = K.ANALYSIS_QUERY,
    k: int = K.TOP_K,
) -> DataFrame:
    """Contexts of each repository for one query text: its k nearest chunks.

    A task keeps k rows per repository before the shuffle. The few hits are written and
    counted, so that texts are fetched for them without a shuffle of all points.
    """
    (vector,) = make_embedder()([query])
    wanted = F.array(*[F.lit(float(x)) for x in vector])
    fits = search.checked_points(points, len(vector))[0]
    scored = fits.select("repo", "id", vectors.cosine(F.col("vector"), wanted).alias("score"))
    order = Window.partitionBy("repo").orderBy(F.desc_nulls_last("score"), "id")
    hits = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = stage(hits.withColumnRenamed("repo", "query_id"), f"{folder}/hits")
    return search.contexts(search.with_payload(named, points, n_hits=named.count()))


def analyse(
    files: DataFrame,
    folder: str,
    make_embedder: Callable = inference.hashing_embedder,
    embed_model: str = "hashing",
    dim: int = 32,
    make_describer: Callable | None = None,
    chat_model: str = "heuristic",
    cache_folder: str | None = None,
    max_files: int = 0,
) -> Analysis:
    """Scan, profile, describe, chunk, embed, store, retrieve and report.

    ``files`` is a landed table. Each stage with more than one consumer is written under
    ``folder`` and read back, so a lost executor costs one stage at most. Caches live
    under ``cache_folder`` and make a second run call the models for new content only.
    """
    spark = files.sparkSession
    caches = cache_folder or f"{folder}/caches"
    docs = cap_files(scan_files(files), max_files)

    profiled, module_totals = measured_stage(
        profile_modules(docs), f"{folder}/profiled", functions=F.sum("num_functions"), lines=F.sum("total_lines")
    )
    summaries = open_cache(spark, caches, chat_model, "summary")
    described, told = describe_modules(profiled, summaries, chat_model, folder, make_describer)
    modules = stage(described, f"{folder}/modules")

    chunks, chunk_totals = measured_stage(
        chunk_files(docs), f"{folder}/chunks", chars=F.sum(F.length("text"))
    )
    requests = chunks.select(F.col("chunk_sha").alias("sha"), "text")
    held = open_cache(spark, caches, embed_model, "vector", dim)
    embedded = inference.embed_cached(
        requests, held, make_embedder, embed_model, folder, dim
    )
    points = tables.upsert_points(
        spark, f"{folder}/points", tables.make_points(chunks, embedded.entries), dim,
        landed=files,
    )

    contexts = report.prompt_contexts(retrieve(points, make_embedder, folder))
    prompts = report.build_prompts(report.prompt_evidence(modules), contexts)
    reports = stage(report.assemble_reports(modules), f"{folder}/report_rows")
    groups = stage(report.modules_by_role(modules), f"{folder}/group_rows")
    write_reports(reports, f"{folder}/reports")
    write_groups(groups, f"{folder}/groups")
    return Analysis(
        modules, chunks, points, prompts, reports, groups,
        embedded.rejects.unionByName(told.rejects),
        {"modules": module_totals, "chunks": chunk_totals},
    )
