"""Written tables of points by repository and bucket of paths on any shared file system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.functions import paths
from codeloom.operators.skew import HOT_ROWS, keep_listed, skew_join

FILE = ["repo", "path"]
PART = ["repo", "bucket"]
BUCKETS = 16  # of a repository's paths; the same for a table's whole life


def _exists(spark: SparkSession, base: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def point_id() -> Column:
    """Id from the content's place, so that a repeated run replaces and never doubles."""
    parts = F.concat_ws("\0", "repo", "path", F.col("chunk_index").cast("string"))
    return F.sha2(parts.cast("binary"), 256)


def make_points(chunks: DataFrame, vectors: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Points of all chunks whose hash has a vector."""
    keyed = chunks.withColumnRenamed("chunk_sha", "sha")
    joined = skew_join(
        keyed, vectors, ["sha"], "inner", ["repo", "path", "chunk_index"], hot_rows
    )
    return joined.select(
        point_id().alias("id"), "vector", "repo", "path", "chunk_index", "text"
    )


def check_dimension(points: DataFrame, dim: int) -> DataFrame:
    """Fail the job on a vector of another length than the collection's."""
    size = F.size("vector")
    message = F.concat(F.lit(f"vector must have {dim} numbers, not "), size.cast("string"))
    return points.where(F.assert_true(size == dim, message).isNull())


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add the bucket of each row's path, by which a repository is written in parts."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))


def _stored(spark: SparkSession, base: str) -> DataFrame:
    schema = f"{schemas.POINTS}, bucket int"
    if not _exists(spark, base):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(base).where(F.col("id").isNotNull())


def read_points(spark: SparkSession, base: str) -> DataFrame:
    """The points table, empty before its first points."""
    return _stored(spark, base).drop("bucket")


def replace_files(target: DataFrame, new: DataFrame, landed: DataFrame) -> DataFrame:
    """Points of ``target`` whose file is not among the ``landed``, and all of ``new``."""
    keys = landed.select(*FILE).distinct()
    return target.join(keys, FILE, "left_anti").unionByName(new)


def upsert_points(
    spark: SparkSession, base: str, new: DataFrame, dim: int, landed: DataFrame, buckets: int = BUCKETS
) -> DataFrame:
    """Replace all points of the ``landed`` files ``(repo, path)`` by those in ``new``.

    A landed file without new points loses those it had. Only the parts (repository, bucket
    of paths) that hold landed files are read and overwritten, each in one or more files of a
    bounded size, so a few files that land in a big repository move a few of its parts.
    A row without an id stands in each part, so that one whose last point went is overwritten
    too. A batch that is run again after a failure gives the same table. ``buckets`` stays
    the same for a table.
    """
    parts = bucketed(landed.select(*FILE), buckets).select(*PART).distinct()
    held = keep_listed(_stored(spark, base), parts, PART)
    fresh = bucketed(check_dimension(new, dim), buckets)
    marks = parts.select(
        *PART, *[F.lit(None).cast(f.dataType).alias(f.name) for f in fresh.schema if f.name not in PART]
    )
    merged = replace_files(held, fresh, landed).unionByName(marks)
    writer = merged.hint("rebalance", *[F.col(c) for c in PART]).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*PART).parquet(base)
    return read_points(spark, base)


def collections(repos: DataFrame) -> DataFrame:
    """Distinct collection names of repositories."""
    return repos.select(paths.collection_name(F.col("repo")).alias("collection")).distinct()


def known_collections(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Mark which wanted collections exist already."""
    held = existing.select("collection").distinct().withColumn("known", F.lit(True))
    joined = wanted.join(held, "collection", "left")
    return joined.withColumn("known", F.coalesce("known", F.lit(False)))
