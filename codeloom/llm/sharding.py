"""Two-pass external shuffle into shards, with DataFrame operations only.

Pass one scatters records by seeded hashes into buckets of about ``BUCKET_BYTES``, one
shuffle partition each. Pass two permutes every bucket in memory (Fisher-Yates) and writes
it. The buckets in order are one random sequence, which is cut into shards of equal row
counts: a shard is a run of bucket files, and the manifest says where to cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codeloom.llm.common import fingerprint, table
from codeloom.session import run_folder

BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 64
SEED = 20240501


@dataclass(frozen=True)
class Shuffled:
    """``records``: the permuted records with ``bucket`` and ``place``; ``shards``: how many."""

    folder: str
    shards: int
    columns: tuple[str, ...]

    def read(self, spark: SparkSession) -> DataFrame:
        """The records with ``shard`` and ``slot``; each shard's slots run from 0 without a gap.

        Shards differ by at most one row. A record column named ``shard`` or ``slot`` is replaced.
        """
        rows = spark.read.parquet(self.folder)
        counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        # one row per BUCKET_BYTES of data, 16 bytes each: a millionth of the input
        ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        manifest = counts.withColumns({
            "before": F.coalesce(F.sum("n").over(ahead), F.lit(0)),
            "total": F.sum("n").over(Window.partitionBy(F.lit(1))),
        }).drop("n")
        placed = rows.join(F.broadcast(manifest), "bucket")
        # shard s holds the positions from s * total div shards up to those of s + 1
        placed = placed.withColumn("__shard", F.expr(f"((before + place + 1) * {self.shards} - 1) div total"))
        placed = placed.withColumn("__slot", F.expr(f"before + place - ((__shard * total) div {self.shards})"))
        keep = [F.col(f"record.`{c}`").alias(c) for c in self.columns if c not in ("shard", "slot")]
        return placed.select(*keep, F.col("__shard").cast("int").alias("shard"), F.col("__slot").cast("long").alias("slot"))


def bucket_count(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(LEAST_BUCKETS, -(-total_bytes // bucket_bytes))


def shuffle_records(df: DataFrame, shards: int = 16, seed: int = SEED, size: Column | None = None, folder: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> Shuffled:
    """Write ``df`` in random order; returns what reads it as ``shards`` equal shards.

    ``size`` estimates the bytes of a record (default: 64). A record's bucket comes from a
    seeded hash of its columns of atomic types and of its place in the input, so repeated rows spread like others and
    no bucket grows with a hot key. An empty table gives no rows. Any column may be null.
    """
    folder = folder or run_folder(df.sparkSession, "shards")
    total = df.agg(F.sum(size if size is not None else F.lit(64))).first()[0] or 0
    buckets = bucket_count(int(total), bucket_bytes)
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.BooleanType))]
    scattered = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"),
        fingerprint(F.lit(seed), *hashed, F.monotonically_increasing_id()).alias("draw"),
    ).withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int"))
    # a bucket is one partition in a fixed order, so its permutation follows from the seed and its number
    dealt = scattered.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "draw")
    held = dealt.groupBy("bucket").agg(F.collect_list("record").alias("records"))
    permuted = held.select("bucket", F.posexplode(F.shuffle("records", seed)).alias("place", "record"))
    permuted.write.mode("errorifexists").parquet(folder)
    return Shuffled(folder, shards, tuple(df.columns))


def op5_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    rows = shuffle_records(docs, 16, size=size).read(spark)
    return rows.select(
        "doc_id", size.cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
