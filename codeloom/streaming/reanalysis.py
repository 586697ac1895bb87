"""Re-analysis as files land: the batch operators driven by Structured Streaming.

Profiles and chunks are local to a row, so they run on a stream unchanged. Storing points
needs the caches and the points table, which a micro-batch reads and extends.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom import schemas
from codeloom.operators import inference
from codeloom.operators.chunking import chunk_files
from codeloom.operators.functions import profile_modules
from codeloom.operators.ranking import single_files
from codeloom.session import stage
from codeloom.sources import tables
from codeloom.sources.caches import open_cache
from codeloom.sources.corpus import scan_files


def landing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files ``(repo, path, content)`` and when they ``landed`` in a Parquet folder.

    A file whose content is null was deleted.
    """
    landed = F.col("_metadata.file_modification_time").alias("landed")
    return spark.readStream.schema(schemas.FILES).parquet(folder).select("*", landed)


def stream_profiles(files: DataFrame) -> DataFrame:
    """Module profile of every file that lands; no state is kept."""
    return profile_modules(scan_files(files.select("repo", "path", "content")))


def index_batch(
    files: DataFrame, folder: str, make_embedder: Callable, model: str, dim: int
) -> DataFrame:
    """Chunk, embed and upsert one micro-batch; returns the points table after it.

    All points of a landed file are replaced; of several landings in one batch the latest
    counts. Vectors are keyed by content, so a batch that is replayed after a failure
    changes nothing.
    """
    run = f"{folder}/batches/{uuid.uuid4().hex}"
    latest = single_files(files, "landed" if "landed" in files.columns else None)
    kept = latest.select("repo", "path", "content")
    chunks = stage(chunk_files(scan_files(kept)), f"{run}/chunks")
    held = open_cache(files.sparkSession, f"{folder}/caches", model, "vector", dim)
    requests = chunks.select(F.col("chunk_sha").alias("sha"), "text")
    found = inference.embed_cached(requests, held, make_embedder, model, run, dim)
    points = tables.upsert_points(
        files.sparkSession, f"{folder}/points", tables.make_points(chunks, found.entries), dim,
        landed=files,
    )
    return points


def start_indexing(
    files: DataFrame,
    folder: str,
    make_embedder: Callable = inference.hashing_embedder,
    model: str = "hashing",
    dim: int = 32,
) -> StreamingQuery:
    """Index all files that have landed so far and stop; run again for later ones."""

    def each(batch: DataFrame, _: int) -> None:
        index_batch(batch, folder, make_embedder, model, dim)

    writer = files.writeStream.foreachBatch(each).trigger(availableNow=True)
    return writer.option("checkpointLocation", f"{folder}/progress").start()
