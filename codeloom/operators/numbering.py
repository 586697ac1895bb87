"""Row numbers without bringing a group, or the whole table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.skew import broadcast_few
from codeloom.session import run_folder, stage

_PART_BITS = 33  # of a row's id, below its task


def numbered(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Add ``name``: 1, 2, 3 ... in each group of ``within`` by ``order``, or over all rows without a group.

    Rows are dealt by ranges and sorted, so a group with a third of all rows lies in many
    tasks. Each row's place in its task is written; the first place of a group in a task
    and the rows of the tasks before it, one row per group and task, do the rest. Nulls come
    first and are a group of their own. Rows equal in ``order`` are numbered in any order.
    """
    spark, columns = df.sparkSession, [*within, *order]
    rows = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    rows = stage(rows.withColumn("_id", F.monotonically_increasing_id()), run_folder(spark, "numbered"))
    placed = rows.withColumn("_part", F.shiftright("_id", _PART_BITS))
    starts = placed.groupBy(*within, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_n").over(before), F.lit(0))
    keys = [F.col(c).alias(f"_{c}") for c in within]
    shifts = starts.select(*keys, F.col("_part").alias("_task"), (ahead - F.col("_first") + 1).alias("_shift"))
    shifts = broadcast_few(stage(shifts, run_folder(spark, "shifts")))
    same = [placed["_part"] == shifts["_task"], *(placed[c].eqNullSafe(shifts[f"_{c}"]) for c in within)]
    joined = placed.join(shifts, same)
    return joined.select(*df.columns, (F.col("_id") + F.col("_shift")).alias(name))
