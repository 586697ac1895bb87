"""Cache tables clustered by content hash: one external bucketed table per model.

Entries are checked and made unique when they are written, so a read neither groups nor
filters by neighbours, and a join on the hash moves the other side only. The files are
plain Parquet; a table definition over them is made anew in every session.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
VECTOR, SUMMARY = "array<float>", "string"


@dataclass(frozen=True)
class CacheTable:
    """Entries ``(sha, value)`` of one model; ``value`` is named ``vector`` or ``summary``."""

    spark: SparkSession
    name: str
    value: str
    buckets: int
    dim: int | None

    def entries(self) -> DataFrame:
        """All entries, one per hash."""
        return self.spark.table(self.name)

    def usable(self, value: Column) -> Column:
        """Whether a value may be stored: present and, for vectors, all numbers and of the dimension."""
        ok = value.isNotNull()
        if self.value == "vector":
            ok = ok & ~F.exists(value, lambda x: x.isNull() | F.isnan(x))
            if self.dim is not None:
                ok = ok & (F.size(value) == self.dim)
        return ok

    def add(self, fresh: DataFrame) -> None:
        """Store the usable rows of ``fresh`` ``(sha, value)`` whose hash is not held yet.

        Each bucket is written by one task, beside which its stored entries lie, so nothing
        stored is moved. Of rows with one hash the least value stays. A run that is
        repeated adds nothing. One writer at a time.
        """
        rows = fresh.where(F.col("sha").isNotNull() & self.usable(F.col(self.value)))
        dealt = rows.select("sha", self.value).repartition(self.buckets, "sha")
        single = dealt.groupBy("sha").agg(F.min(self.value).alias(self.value))
        new = single.join(self.entries().select("sha"), "sha", "left_anti")
        new.write.mode("append").insertInto(self.name)


def _children(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []


def open_cache(spark: SparkSession, base: str, model: str, value: str, dim: int | None = None, buckets: int = BUCKETS) -> CacheTable:
    """The cache of ``model`` under ``base``, made where there is none.

    A stored cache keeps the number of buckets it was made with, whatever ``buckets`` says.
    ``dim`` is part of the place: vectors of another dimension are another cache.
    """
    if value not in ("vector", "summary"):
        raise ValueError("a cache holds vectors or summaries")
    folder = f"{base}/{value}-{dim or 'any'}/{quote(model, safe='')}"
    held = [m[1] for name in _children(spark, folder) if (m := re.fullmatch(r"buckets-(\d+)", name))]
    number = int(held[0]) if held else buckets
    place = f"{folder}/buckets-{number}"
    name = f"cache_{hashlib.sha256(place.encode()).hexdigest()[:24]}"
    kind = VECTOR if value == "vector" else SUMMARY
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (sha STRING, {value} {kind}) USING parquet "
        f"CLUSTERED BY (sha) INTO {number} BUCKETS LOCATION '{place}'"
    )
    spark.catalog.refreshTable(name)
    return CacheTable(spark, name, value, number, dim)
