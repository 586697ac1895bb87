"""Cosine nearest neighbours over a table of points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom import constants as K
from codeloom.functions import vectors
from codeloom.session import run_folder, ship_package, stage

QUERY_BLOCK_BYTES = 32 << 20
ROUNDED = 1e-11  # scores are rounded to 12 digits, so nearer ones may tie


def checked_points(points: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Points whose vector has ``dim`` numbers, and the rejected rest."""
    fits = F.coalesce(F.size("vector") == dim, F.lit(False))
    return points.where(fits), points.where(~fits)


def score_or_null(score: Column, zero_as_null: bool) -> Column:
    return F.nullif(score, F.lit(0.0)) if zero_as_null else score


def top_k(
    points: DataFrame,
    query: Sequence[float],
    k: int = K.TOP_K,
    id_col: str = "id",
    zero_as_null: bool = False,
) -> DataFrame:
    """The ``k`` points nearest to one query vector, with their score.

    Every task keeps k rows only (TakeOrderedAndProject); there is no shuffle.
    """
    literal = F.array(*[F.lit(float(x)) for x in query])
    size = float(np.linalg.norm(np.asarray(query, dtype="float64")))
    length = vectors.norm(F.col("vector")) * size
    score = vectors.dot(F.col("vector"), literal) / F.nullif(length, F.lit(0.0))
    scored = checked_points(points, len(query))[0].withColumn("score", score)
    hits = scored.orderBy(F.desc_nulls_last("score"), id_col).limit(k)
    return hits.drop("vector").withColumn("score", score_or_null(F.col("score"), zero_as_null))


def _first(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of (query, id, score) the first k of every query by score descending, then id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    keep = place < k
    return q[keep], ids[keep], scores[keep]


class _Nearest:
    """The k best points of every query of a block, over tiles of points.

    A tile holds ``tile_scores`` scores at most. A point competes for a query if its score
    is not below the query's k-th best so far nor, where many compete, below the k-th best
    of its tile, so ties at the edge all compete and few pairs are sorted. What competes
    waits until it is as much as is held, so that the held rows are not sorted for every tile.
    """

    def __init__(self, queries: np.ndarray, k: int, tile_scores: int) -> None:
        self.queries, self.k = queries, k
        self.rows = max(1, tile_scores // max(1, len(queries)))
        self.edge = np.full(len(queries), -np.inf)
        self.q = np.zeros(0, np.int64)
        self.ids: np.ndarray | None = None
        self.scores = np.zeros(0)
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        for at in range(0, len(ids), self.rows):
            part = slice(at, at + self.rows)
            with np.errstate(invalid="ignore"):
                scores = unit[part] @ self.queries.T
            point, query = np.zeros(0, np.int64), np.zeros(0, np.int64)
            few = bool(np.isfinite(self.edge).all())  # a score that is no number is no rival then
            if few:
                hits = scores >= self.edge - ROUNDED
                few = np.count_nonzero(hits) <= 4 * self.k * len(self.queries)
            if few:
                point, query = np.nonzero(hits)
            else:
                scores[np.isnan(scores)] = -np.inf
                edge = self.edge
                if len(scores) > self.k:
                    edge = np.maximum(edge, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
                point, query = np.nonzero(scores >= edge - ROUNDED)
            if len(point):
                # equal points may differ in the last digits of a product; rounded, they tie
                self.waiting.append((query, ids[part][point], np.round(scores[point, query], 12)))
                if sum(len(w[0]) for w in self.waiting) >= self.k * len(self.queries):
                    self._flush()
        self._flush()

    def _flush(self) -> None:
        if self.waiting:
            self._merge(*[np.concatenate(x) for x in zip(*self.waiting, strict=True)])
            self.waiting = []

    def _merge(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        self.q, self.ids, self.scores = _first(np.concatenate([self.q, q]), ids, np.concatenate([self.scores, scores]), self.k)
        last = np.flatnonzero(np.concatenate((self.q[1:] != self.q[:-1], [True])))
        full = last[np.bincount(self.q, minlength=len(self.queries))[self.q[last]] >= self.k]
        self.edge[self.q[full]] = self.scores[full]


TILE_SCORES = 1 << 20


def _block_top_k(
    points: DataFrame, block: list, query_type: T.DataType, k: int, id_col: str, dim: int, tile_scores: int
) -> tuple[DataFrame, Broadcast]:
    matrix = np.array([row["vector"] for row in block], dtype="float64")
    sizes = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(sizes > 0, sizes, np.nan)[:, None]
    shared = points.sparkSession.sparkContext.broadcast(unit)
    id_type = points.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("q", T.LongType()),
            T.StructField("id", id_type),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kind = _Nearest(shared.value, k, tile_scores), None
        for batch in batches:
            kind = batch.column(0).type
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            rows = np.asarray(flat, dtype="float64").reshape(-1, dim)
            found.add(batch.column(0).to_numpy(zero_copy_only=False), rows)
        if found.ids is not None:
            columns = [pa.array(found.q, pa.int64()), pa.array(found.ids, kind), pa.array(found.scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "id", "score"])

    ship_package(points.sparkSession)
    local = points.select(F.col(id_col).alias("id"), "vector").mapInArrow(nearest, schema)
    fields = [T.StructField("q", T.LongType()), T.StructField("query_id", query_type)]
    names = points.sparkSession.createDataFrame(
        [(i, row["query_id"]) for i, row in enumerate(block)], T.StructType(fields)
    )
    return local.join(F.broadcast(names), "q").drop("q"), shared


def top_k_batch(
    points: DataFrame,
    queries: DataFrame,
    k: int = K.TOP_K,
    id_col: str = "id",
    block_bytes: int = QUERY_BLOCK_BYTES,
    tile_scores: int = TILE_SCORES,
) -> DataFrame:
    """The ``k`` nearest points of every query ``(query_id, vector)``, exactly.

    Queries are taken in blocks of a checked size. A block is broadcast and each task
    multiplies its points with it, ``tile_scores`` products at a time, and keeps k
    candidates per query, so what is shuffled is tasks x queries x k short rows, whatever
    the number of points. More queries than one block holds mean further passes, not a
    bigger broadcast; each pass is written and its broadcast given back.
    A query that is null or shorter than the longest one has no hits, as a point of
    another length is no hit.
    """
    dim = queries.select(F.max(F.size("vector"))).first()[0]
    if dim is None:
        raise ValueError("no queries")
    queries = checked_points(queries, dim)[0]
    per_block = max(1, block_bytes // (8 * dim))
    n_queries = queries.count()
    usable = checked_points(points, dim)[0]
    n_blocks = -(-n_queries // per_block)
    if n_blocks == 1:
        blocks = [queries]
    else:
        # twice as many shares as needed on average keeps every one within its bound
        share = F.pmod(F.xxhash64("query_id"), F.lit(2 * n_blocks))
        blocks = [queries.where(share == b) for b in range(2 * n_blocks)]
    query_type = queries.schema["query_id"].dataType
    found = []
    for block in blocks:
        rows = block.select("query_id", "vector").limit(4 * per_block + 1).collect()
        if len(rows) > 4 * per_block:
            raise ValueError("query ids are not unique")
        if rows:
            local, shared = _block_top_k(usable, rows, query_type, k, id_col, dim, tile_scores)
            if n_blocks > 1:
                local = stage(local, run_folder(points.sparkSession, "nearest"))
                shared.destroy()
            found.append(local)
    candidates = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.when(F.col("score") > float("-inf"), F.col("score"))
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), score.alias("score"))


BROADCAST_HITS = 500_000


def with_payload(
    hits: DataFrame, points: DataFrame, id_col: str = "id", n_hits: int | None = None
) -> DataFrame:
    """Attach ``path``, ``chunk_index`` and ``text`` to the hits.

    With a known small number of hits they are broadcast and the points stay in place.
    """
    payload = points.select(id_col, "path", "chunk_index", "text")
    if n_hits is not None and n_hits <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    return payload.join(hits, id_col)


def contexts(hits: DataFrame) -> DataFrame:
    """Hits as prompt contexts; a missing text becomes an empty one."""
    return hits.select(
        "query_id", "rank", "score", "path", "chunk_index",
        F.coalesce("text", F.lit("")).alias("document"),
    )


def mean_vectors(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean vector of all points, or of each group, from partial sums per position."""
    cells = points.select(*keys, F.posexplode("vector").alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    cell = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(*keys).agg(F.transform(cell, lambda c: c["x"]).alias("vector"))
