"""Running totals over a global order without a global window."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codeloom.llm.common import over_arrow, small, staged


def part_offsets(parts: DataFrame, part: str, total: str) -> DataFrame:
    """(part, ``ahead``): totals of all parts before. A part is one task's share of the rows."""
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(part).agg(F.sum(total).alias("t"))
    return sums.select(part, F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("ahead"))


def running_totals(df: DataFrame, order: Sequence[str], value: str, within: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over earlier rows of the same ``within``.

    ``order`` begins with ``within``. Rows are dealt by ranges of ``order``, so a group with
    a third of all rows is spread over many tasks; each task adds up its rows as they
    stream by, and the totals of earlier tasks are added afterwards.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__sum", T.LongType())])

    def work(batches):
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(pc.fill_null(batch.column(value), 0).to_numpy(zero_copy_only=False), dtype=np.int64) + done
            done = int(sums[-1]) if len(sums) else done
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__part", "__sum"])

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(over_arrow(dealt, work, schema), "totals")
    offsets = part_offsets(rows, "__part", value)
    rows = rows.join(F.broadcast(offsets), "__part").withColumn("__all", F.col("ahead") + F.col("__sum") - F.coalesce(value, F.lit(0)))
    starts = rows.groupBy(within).agg(F.min("__all").alias("__start"))
    starts = starts.withColumnRenamed(within, "__within")
    rows = rows.join(small(starts), rows[within].eqNullSafe(F.col("__within")))
    return rows.select(*df.columns, (F.col("__all") - F.col("__start")).alias("before"))
