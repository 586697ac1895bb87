"""Approximate nearest neighbours over a stored index of random projections.

A table of the index cuts the space by some planes; which side of each a vector lies on is
its bucket. A query looks into the buckets that are cheapest to reach from its own, by how
near it lies to the planes between, in every table. All vectors met there are scored
exactly, so an answer may miss a neighbour but never tells a wrong score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom import constants as K
from codeloom.operators.search import TILE_SCORES, _first, checked_points
from codeloom.operators.skew import broadcast_few, dealt, repeated, written_hot_keys
from codeloom.session import ship_package

TABLES, BITS, PROBES = 8, 8, 32
MOST_BITS = 16  # every bucket of a table is ranked for each query
BROADCAST_PROBES = 50_000
BUCKET_ROWS = 100_000  # of a bucket that a task holds at once
PAIRS = 1 << 16  # whose vectors are gathered for one step of exact scores
BUCKET = ["table", "bucket"]


def planes(table: int, bits: int, dim: int) -> np.ndarray:
    """``dim`` x ``bits`` signs of one table, the same in every run."""
    def sign(bit: int, d: int) -> float:
        return 1.0 if hashlib.md5(f"{table}:{bit}:{d}".encode()).digest()[0] & 1 else -1.0

    return np.array([[sign(b, d) for b in range(bits)] for d in range(dim)])


@dataclass(frozen=True)
class Index:
    """A written index: every point once per table, files ordered by bucket."""

    folder: str
    dim: int
    tables: int
    bits: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), "float64").reshape(-1, dim)


def _projected(column: pa.Array, cuts: list[np.ndarray], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per table the distances (times a factor) from its planes, and the bucket of each vector."""
    vectors = _matrix(column, dim)
    for cut in cuts:
        sides = vectors @ cut
        yield sides, (sides > 0) @ (1 << np.arange(cut.shape[1], dtype=np.int64))


def build_index(points: DataFrame, folder: str, dim: int, tables: int = TABLES, bits: int = BITS, id_col: str = "id") -> Index:
    """Write an index of all ``points`` (id, vector) of ``dim`` numbers under ``folder``.

    More points ask for more ``bits``, so that a bucket stays small: a table has 2^bits of
    them. Points with a null number or another dimension are left out; a zero vector is kept.
    """
    if not 1 <= bits <= MOST_BITS:
        raise ValueError(f"bits must be 1 to {MOST_BITS}")
    cuts = [planes(t, bits, dim) for t in range(tables)]
    usable = checked_points(points, dim)[0].where(~F.exists("vector", lambda x: x.isNull()))
    narrow = usable.select(F.col(id_col).alias("id"), "vector")
    schema = T.StructType([*narrow.schema.fields, T.StructField("bucket", T.LongType()), T.StructField("table", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, (_, buckets) in enumerate(_projected(batch.column("vector"), cuts, dim)):
                columns = [*batch.columns, pa.array(buckets, pa.int64()), pa.array(np.full(batch.num_rows, t, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "bucket", "table"])

    ship_package(points.sparkSession)
    rows = narrow.mapInArrow(work, schema).hint("rebalance", F.col("table"), F.col("bucket"))
    rows.sortWithinPartitions(*BUCKET).write.mode("errorifexists").partitionBy("table").parquet(f"{folder}/rows")
    return Index(folder, dim, tables, bits)


def _probes(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """(query_id, wanted, table, bucket): the cheapest buckets of every query in every table."""
    cuts = [planes(t, index.bits, index.dim) for t in range(index.tables)]
    masks = np.arange(1 << index.bits, dtype=np.int64)
    flips = ((masks[:, None] >> np.arange(index.bits)) & 1).astype(float)
    number = min(probes, len(masks))
    kinds = [queries.schema[c].dataType for c in ("query_id", "vector")]
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("wanted", kinds[1]), T.StructField("table", T.IntegerType()), T.StructField("bucket", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = pa.array(np.repeat(np.arange(some.num_rows), number))
                for t, (sides, own) in enumerate(_projected(some.column("wanted"), cuts, index.dim)):
                    cheapest = np.argsort(np.abs(sides) @ flips.T, axis=1, kind="stable")[:, :number]
                    columns = [some.column("query_id").take(rows), some.column("wanted").take(rows), pa.array(np.full(len(rows), t, np.int32)), pa.array((own[:, None] ^ masks[cheapest]).ravel())]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "wanted", *BUCKET])

    ship_package(queries.sparkSession)
    narrow = queries.select("query_id", F.col("vector").alias("wanted"))
    return narrow.mapInArrow(work, schema)


def _scored(pairs: DataFrame, dim: int) -> DataFrame:
    """(query_id, id, score) with the exact cosine, null beside a zero vector."""
    names = ["query_id", "id"]
    schema = T.StructType([*[pairs.schema[c] for c in names], T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column("wanted"), dim), _matrix(batch.column("vector"), dim)
            with np.errstate(invalid="ignore", divide="ignore"):
                cosine = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(cosine, from_pandas=True)], names=[*names, "score"])

    return pairs.select(*names, "wanted", "vector").mapInArrow(work, schema)


def _exact(queries: np.ndarray, points: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (q, p); -inf where there is none."""
    out = np.empty(len(q))
    for at in range(0, len(q), PAIRS):
        part = slice(at, at + PAIRS)
        a, b = queries[q[part]], points[p[part]]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[part] = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    out[np.isnan(out)] = -np.inf
    return out


class _Bucket:
    """The points of a bucket by ascending id; asked with queries, some at a time."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int, most: int) -> None:
        self.ids, self.vectors = ids, vectors
        lengths = np.linalg.norm(vectors, axis=1)
        self.unit = vectors / np.where(lengths > 0, lengths, np.nan)[:, None]
        # rows of one id compete with each other, so more of them are kept
        self.wanted = k if len(pc.unique(ids)) == len(ids) else most
        self.tile = max(1, TILE_SCORES // max(1, len(ids)))

    def first(self, query_ids: pa.Array, queries: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """(query_id, id, score) of the first rows of every query by score, then id."""
        for at in range(0, len(queries), self.tile):
            some = queries[at : at + self.tile]
            with np.errstate(invalid="ignore"):
                near = some @ self.unit.T
            near[np.isnan(near)] = -np.inf
            bound = np.full(len(some), -np.inf)
            if near.shape[1] > self.wanted:
                place = near.shape[1] - self.wanted
                edge = np.partition(near, place, axis=1)[:, place]
                slack = 1e-9 * np.linalg.norm(some, axis=1)  # products differ from exact scores in the last digits
                told = np.isfinite(edge) & np.isfinite(slack)
                bound[told] = edge[told] - slack[told]
            q, p = np.nonzero(near >= bound[:, None])
            q, p, scores = _first(q, p, _exact(some, self.vectors, q, p), self.wanted)
            yield query_ids.slice(at).take(pa.array(q)), self.ids.take(pa.array(p)), pa.array(np.where(np.isinf(scores), np.nan, scores), from_pandas=True)


def _met(rows: DataFrame, asked: DataFrame, on: list[str], dim: int, k: int, most: int) -> DataFrame:
    """(query_id, id, score) of the first rows of every query in every bucket it asks.

    Both sides lie by bucket, points before queries. A task holds the points of one bucket
    and takes its queries as they come, a matrix product at a time; no pair is a row.
    """
    kinds = {"query_id": asked.schema["query_id"].dataType, "id": rows.schema["id"].dataType}
    schema = T.StructType([*[T.StructField(c, t) for c, t in kinds.items()], T.StructField("score", T.DoubleType())])
    points = rows.select(*on, F.lit(0).alias("kind"), "id", F.lit(None).cast(kinds["query_id"]).alias("query_id"), "vector")
    queries = asked.select(*on, F.lit(1).alias("kind"), F.lit(None).cast(kinds["id"]).alias("id"), "query_id", F.col("wanted").alias("vector"))
    names, marks = ["query_id", "id", "score"], [*on, "kind"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, bucket_of, parts_of = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in marks])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()] if batch.num_rows else []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                run, key = batch.slice(a, b - a), tuple(keys[:-1, a])
                if keys[-1, a] == 0:
                    parts = [*parts, run] if parts_of == key else [run]
                    parts_of, bucket = key, None
                elif parts_of == key:
                    if bucket is None or bucket_of != key:
                        ids = pa.concat_arrays([x.column("id") for x in parts])
                        bucket = _Bucket(ids, np.concatenate([_matrix(x.column("vector"), dim) for x in parts]), k, most)
                        bucket_of, parts = key, []
                    for columns in bucket.first(run.column("query_id"), _matrix(run.column("vector"), dim)):
                        yield pa.RecordBatch.from_arrays(list(columns), names=names)

    ship_package(rows.sparkSession)
    together = points.unionByName(queries).repartition(*on)
    return together.sortWithinPartitions(*marks, "id").mapInArrow(work, schema)


def search_index(queries: DataFrame, index: Index, k: int = K.TOP_K, probes: int = PROBES, hot_rows: int = BUCKET_ROWS) -> DataFrame:
    """Up to ``k`` hits ``(query_id, rank, id, score)`` of every query ``(query_id, vector)``.

    Few queries go to the index rows where they are; of many, both sides are shuffled by
    bucket and scored a bucket at a time. A bucket with more than ``hot_rows`` rows is dealt over shares that its
    queries are repeated for. A pair met in several tables counts once. Queries of another
    dimension or with a null number have no hits.
    """
    usable = checked_points(queries, index.dim)[0].where(~F.exists("vector", lambda x: x.isNull()))
    asked = _probes(usable, index, probes)
    rows = index.rows(queries.sparkSession)
    hinted = broadcast_few(asked, BROADCAST_PROBES)
    if hinted is asked:
        hot, on = written_hot_keys(rows, BUCKET, hot_rows), BUCKET
        if hot is not None:
            few_hot, on = broadcast_few(hot), [*BUCKET, "_salt"]
            rows, asked = dealt(rows, few_hot, BUCKET, ["id"]), repeated(asked, few_hot, BUCKET)
        scored = _met(rows, asked, on, index.dim, k, k * index.tables)
    else:
        scored = _scored(rows.join(hinted, BUCKET), index.dim)
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "id")
    # a pair comes once per table at most, so the first k pairs are among these rows
    first = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k * index.tables)
    single = first.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = single.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits ``(query_id, id)`` that were found."""
    pairs = ["query_id", "id"]
    met = exact.select(*pairs).join(found.select(*pairs, F.lit(1).alias("met")), pairs, "left")
    row = met.agg(F.count("met").alias("met"), F.count(F.lit(1)).alias("all")).first()
    return row["met"] / row["all"] if row["all"] else 1.0
