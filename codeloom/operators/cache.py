"""Cache tables keyed by content hash: lookup, misses and merge.

``model`` is part of every key, so results of one model never answer for another. Tables
of ``sources.caches`` hold checked and unique entries of one model; ``valid_vectors`` and
``valid_summaries`` make such entries of any frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import BROADCAST_KEYS, HOT_ROWS, skew_join
from codeloom.session import few, run_folder, stage


def valid_vectors(cache: DataFrame, model: str, dim: int | None = None) -> DataFrame:
    """Usable entries ``(sha, vector)`` of one model; damaged ones count as absent."""
    entries = cache.where((F.col("model") == model) & F.col("vector").isNotNull())
    entries = entries.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    if dim is not None:
        entries = entries.where(F.size("vector") == dim)
    return entries.groupBy("sha").agg(F.first("vector").alias("vector"))


def valid_summaries(cache: DataFrame, model: str) -> DataFrame:
    entries = cache.where((F.col("model") == model) & F.col("summary").isNotNull())
    return entries.groupBy("sha").agg(F.min("summary").alias("summary"))


def distinct_requests(df: DataFrame, sha: str = "sha") -> DataFrame:
    """One row per content hash; copies are merged before the shuffle."""
    return df.dropDuplicates([sha])


def lookup(
    df: DataFrame, entries: DataFrame, spread_by: list[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Keep every row and add the cached value of its ``sha``, or null."""
    return skew_join(df, entries, ["sha"], "left", spread_by, hot_rows)


def misses(df: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per hash the cache does not hold.

    Hashes are compared first, without the texts. If few are missing, a text that is a hit
    never moves; else copies of a text are merged where they are, and one of a task moves.
    Rows without a hash ask for nothing.
    """
    asked = df.where(F.col("sha").isNotNull())
    missing = asked.select("sha").distinct().join(entries.select("sha"), "sha", "left_anti")
    listed = stage(missing, run_folder(df.sparkSession, "missing"))
    if few(listed, BROADCAST_KEYS):
        return distinct_requests(asked.join(F.broadcast(listed), "sha", "left_semi"))
    return distinct_requests(asked).join(listed, "sha", "left_semi")


def merge(hits: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached and freshly computed entries together."""
    return hits.unionByName(fresh)
