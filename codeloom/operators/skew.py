"""Equi-joins that survive a hot key.

A text that is copied across a third of the corpus has one hash; a report may cite
one file in a third of its claims. Hashing such a key puts those rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import few, run_folder, stage

HOT_ROWS = 1_000_000
BROADCAST_KEYS = 500_000
NULL_SHARES = 4096  # over which rows with a null key are dealt
_SALT = "_salt"
_SALTS = "_salts"


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys held by more than ``hot_rows`` rows, and into how many shares to split them.

    Partial counts are merged before the shuffle. There are at most rows / ``hot_rows``
    such keys. Null is a key here.
    """
    return hot_of(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, hot_rows)


def hot_of(counts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``hot_keys`` of rows that are counted by key already, as ``n``."""
    hot = counts.where(F.col("n") > hot_rows)
    return hot.select(*keys, F.ceil(F.col("n") / hot_rows).cast("int").alias(_SALTS))


def keep_listed(
    df: DataFrame, keys: DataFrame, on: Sequence[str], limit: int = BROADCAST_KEYS
) -> DataFrame:
    """Rows of a wide ``df`` whose key is among ``keys``.

    The number of keys is checked: up to ``limit`` they are broadcast and the wide rows
    are filtered where they are; beyond it both sides are shuffled.
    """
    listed = keys.select(*on).distinct()
    return df.join(F.broadcast(listed) if few(listed, limit) else listed, list(on), "left_semi")


def keep_if_few(
    df: DataFrame, keys: DataFrame, on: Sequence[str], limit: int = BROADCAST_KEYS
) -> DataFrame:
    """``keep_listed`` where the keys can be broadcast, else all rows of ``df``."""
    listed = keys.select(*on).distinct()
    return df.join(F.broadcast(listed), list(on), "left_semi") if few(listed, limit) else df


def written_hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The hot keys of ``df``, counted once and written; None where there are none."""
    spark = df.sparkSession
    hot = stage(hot_keys(df, keys, hot_rows), run_folder(spark, "hot"))
    return hot if hot.head(1) else None


def broadcast_few(df: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if few(df, limit) else df


def dealt(df: DataFrame, hot: DataFrame, keys: Sequence[str], spread_by: Sequence[str], salt: str = _SALT) -> DataFrame:
    """Add the share of each row: by the hash of ``spread_by`` for hot keys, 0 for others.

    A row with a null key matches nothing, so it may go to any share.
    """
    hashed = F.xxhash64(*spread_by)
    unnamed = reduce(or_, (F.col(k).isNull() for k in keys))
    share = F.when(unnamed, F.pmod(hashed, F.lit(NULL_SHARES))).when(F.col(_SALTS).isNull(), 0)
    joined = df.join(hot, list(keys), "left")
    return joined.withColumn(salt, share.otherwise(F.pmod(hashed, F.col(_SALTS))).cast("int")).drop(_SALTS)


def repeated(df: DataFrame, hot: DataFrame, keys: Sequence[str], salt: str = _SALT) -> DataFrame:
    """Repeat the rows of a hot key, once per share; other rows have share 0."""
    shares = F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)
    return df.join(hot, list(keys), "left").withColumn(salt, F.explode(shares)).drop(_SALTS)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join many ``left`` rows to a ``right`` side with one row per key.

    Keys are counted first, on narrow rows. Without hot ones this is a plain join. Otherwise
    the rows of a hot key are dealt over shares by the hash of ``spread_by`` and the matching
    right row is repeated, once per share; rows with a null key are dealt too.
    """
    if how not in ("left", "inner"):
        raise ValueError("only left and inner joins repeat the right side safely")
    hot = written_hot_keys(left, keys, hot_rows)
    if hot is None:
        return left.join(right, list(keys), how)
    hot = broadcast_few(hot)
    shares = dealt(left, hot, keys, spread_by or left.columns)
    return shares.join(repeated(right, hot, keys), [*keys, _SALT], how).drop(_SALT)
