"""Session helpers: tuning for local runs, shared storage and input spreading."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "codeloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and single-machine runs. Clusters bring their own."""
    shuffle = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A folder of our own is made only in local mode and only where none is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="codeloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one run's written tables."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str, compression: str | None = None) -> DataFrame:
    """Write a stage and read it back: cuts lineage and survives lost executors."""
    options = {"compression": compression} if compression else {}
    df.write.mode("errorifexists").options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def measured_stage(df: DataFrame, folder: str, **totals: Column) -> tuple[DataFrame, dict[str, int]]:
    """``stage`` with the number of rows and further ``totals``, observed as the rows are written.

    The figures cost no pass of their own.
    """
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in totals.items()])
    out = stage(observed, folder)
    return out, {name: value or 0 for name, value in seen.get.items()}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="codeloom-ship-")) / "codeloom"
    context.addPyFile(
        shutil.make_archive(str(target), "zip", str(package.parent), package.name)
    )
    _shipped.add(context.applicationId)


def few(df: DataFrame, limit: int) -> bool:
    """Whether a frame has at most ``limit`` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores.

    A large table has many splits and passes through without a shuffle; a small
    single-row-group file is dealt out so that regex work does not run in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def by_key(df: DataFrame, keys: Sequence[str], rows: int, per_task: int) -> DataFrame:
    """Rows of equal keys in one task, ``per_task`` of the ``rows`` in each on average, so that tasks need not spill.

    As few partitions as the session gives are left to it.
    """
    wanted = -(-rows // per_task)
    given = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(wanted, *keys) if wanted > given else df.repartition(*keys)


def spread_rows(df: DataFrame, rows: int) -> DataFrame:
    """``spread`` a narrow input whose rows mean much work over tasks of ``rows`` rows on average.

    Its splits follow its bytes, so that there may be few however many rows it has.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = -(-df.count() // (rows * cores)) * cores  # whole rounds of tasks
    dealt = spread(df)
    return dealt if dealt.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
