"""Importance resampling towards a target distribution of hashed n-grams.

Features of a text are its runs of 1 to ``orders`` words; each falls into one of a fixed
number of buckets by the crc32 of its bytes. A bucket's gain is the log of how much likelier
the target is to hold it than the corpus, a text's weight the mean gain of its features, and
the texts with the highest weight plus seeded Gumbel noise are drawn.

Corpus and target are counted in full: tasks return one count per bucket. N-grams of a
batch are interned in an open-addressed table, so each distinct one is given its bucket once
and its occurrences gather gains by slot. Ranks come from sorted ranges, and a row's task
and place in it split rows that are equal in all else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Words, alphanumeric, over_arrow, ranges, slices, staged, table
from codeloom.llm.gram_table import GramTable, Ranges
from codeloom.llm.totals import running_totals
from codeloom.operators.skew import keep_listed

ORDERS = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
TABLE_GRAMS = 1 << 18  # n-grams that one table holds
_SCORED = "doc_id long, n_words long, n_features long, weight long, part int, nth long"


def grams(words: Words, orders: int) -> tuple[Ranges, np.ndarray]:
    """All runs of 1 to ``orders`` words within a text, words joined by one space, and the text of each."""
    sizes = words.end - words.start
    owner = words.owner()
    if orders == 1:
        return Ranges(words.text, words.start, sizes), owner
    ends = np.cumsum(sizes + 1) - 1  # in a buffer that holds all words, each with a space behind
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    joined[ranges(ends - sizes, sizes)] = words.text[ranges(words.start, sizes)]
    last = words.first[1:][owner] if len(owner) else owner  # behind the last word of the text
    starts, lengths, texts = [], [], []
    for n in range(1, orders + 1):
        at = np.flatnonzero(np.arange(len(owner)) + n <= last)
        starts.append((ends - sizes)[at])
        lengths.append(ends[at + n - 1] - (ends - sizes)[at])
        texts.append(owner[at])
    return Ranges(joined, np.concatenate(starts), np.concatenate(lengths)), np.concatenate(texts)


def _tables(found: Ranges, texts: np.ndarray, buckets: int) -> Iterator[tuple[GramTable, np.ndarray]]:
    """Tables over stretches of n-grams, so that a very long text needs no larger table."""
    for at in range(0, len(found), TABLE_GRAMS):
        part = Ranges.__new__(Ranges)
        part.text, part.lanes = found.text, found.lanes
        part.start, part.size = found.start[at : at + TABLE_GRAMS], found.size[at : at + TABLE_GRAMS]
        yield GramTable(part, buckets), texts[at : at + TABLE_GRAMS]


def bucket_counts(texts: DataFrame, text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: a fixed number of counts at any size of input."""

    def work(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            for held, _ in _tables(*grams(Words(batch.column("text"), alphanumeric(), hashed=False), orders), buckets):
                np.add.at(counts, held.bucket, held.count)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    rows = over_arrow(texts.select(F.col(text).alias("text")), work, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the smoothed target share over the smoothed corpus share."""
    size, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + size) / ((a + 1.0) * (t + size)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", orders: int = ORDERS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, part, nth) of every row; part and nth tell its task and place there."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def work(batches):
        part, nth = TaskContext.get().partitionId(), 0
        gain = shared.value
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), alphanumeric(), hashed=False)
            size = batch.num_rows
            total, features = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for held, owner in _tables(*grams(words, orders), len(gain)):
                np.add.at(total, owner, gain[held.bucket][held.slot])
                features += np.bincount(owner, minlength=size)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(words.first).astype(np.int64)), pa.array(features), pa.array(total // np.maximum(features, 1)),
                pa.array(np.full(size, part, np.int32)), pa.array(nth + np.arange(size)),
            ], names=["doc_id", "n_words", "n_features", "weight", "part", "nth"])
            nth += size

    return over_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), work, _SCORED)


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_features, weight, score, rank``, all long.

    ``percent`` of the rows with ``least_words`` words are drawn and ranked 1, 2, 3 ...; ``rank``
    is null for others. Null and wordless texts have no features and weight 0. Ties go to the
    smaller key, null keys (hashed as empty) last; rows equal in both are ranked one after
    another. Repeated rows are rows of their own. An empty target weighs by the corpus
    alone, an empty table gives no rows. Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text, orders, buckets), bucket_counts(target, target_text, orders, buckets))
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0))).cast("long")
    scored = staged(weights(docs, gains, key, text, orders).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    draws = able.count() * percent // 100
    order = able.select("*", F.lit(0).alias("all"), F.lit(1).alias("one"), (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("unnamed"))
    ranked = running_totals(order, ["all", "down", "unnamed", "doc_id", "part", "nth"], "one", "all")
    rank = F.when(F.col("before") < draws, F.col("before") + 1).cast("long")
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words)
    return ranked.select(*columns, rank.alias("rank")).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns. A row that is not drawn stays out,
    unless its key equals that of a drawn one; rows without a key are never returned."""
    drawn = importance(docs, target, key, text, **how).where("rank is not null").select(F.col("doc_id").alias("__drawn"))
    marked = docs.withColumn("__drawn", F.col(key).cast("long"))
    return keep_listed(marked, staged(drawn, "drawn"), ["__drawn"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
