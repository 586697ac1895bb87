"""Embedding near-duplicates: one navigable graph per shard, every vector asks every shard.

Equal vectors are one node. Nodes are dealt into shards by hash; each shard's graph is
built in one task and written in small pieces. Queries then stream past every shard's graph, of
which a worker holds one, as 32-bit numbers if the table has them. A beam
that ends full of links is widened until it is not. Before that, a seeded audit compares
queries with brute force in all shards, draws more until enough of them have links, and
takes the least beam whose mean recall per query is high enough. Links are verified in
double precision. A task adds links up itself: it returns counts, and for connectivity a
forest of at most one edge per node, never all pairs of a dense group.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from codeloom.llm.common import over_arrow, staged, table
from codeloom.llm.components import components
from codeloom.llm.hnsw import STEP, Graph, levels_of
from codeloom.session import ship_package

LEAST_COSINE = 0.9
LEAST_SHARDS = 8
SHARD_NODES = 50_000
SHARD_BYTES = 64 << 20  # of a shard's vectors in double precision
BLOCK_NODES = 8_192
PART_NODES = 65_536  # queries a shard is moved for
PIECE_BYTES = 1 << 20  # of a shard in a row
QUERY = 2**31 - 1  # in place of a piece's number, so that queries come after all pieces
SCORES = 1 << 21  # of queries with a whole shard at a time
PAIR_NUMBERS = 1 << 21  # of the vectors of pairs that are verified at a time
BEAM = 24
WIDEST = 192  # a wider beam is the whole shard
AUDIT, RECALL = 512, 0.99
ENOUGH = 64  # queries with links that an audit needs
MOST_AUDIT = 8_192  # queries drawn at most
AUDIT_STEP = 64  # queries compared with a whole shard at a time
_FOUND = "node long, n long, root long"
_AUDITED = "dim int, node long, beam int, truth long, found long"


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Shard:
    """Nodes by falling level, with copies, vectors as given and their graph over 32-bit unit vectors.

    Units in double precision are made for the rows that are asked for only.
    """

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        self.nodes, self.copies, self.vectors = nodes, copies, vectors
        self.narrow = np.empty(vectors.shape, np.float32)
        for at in range(0, len(vectors), STEP):
            self.narrow[at : at + STEP] = _units(vectors[at : at + STEP])

    def pieces(self) -> list[bytes]:
        data = memoryview(pickle.dumps((self.nodes, self.copies, self.vectors, self.graph.layers), protocol=5))
        return [bytes(data[at : at + PIECE_BYTES]) for at in range(0, len(data), PIECE_BYTES)]

    @classmethod
    def of(cls, pieces: Iterable[bytes]) -> Shard:
        nodes, copies, vectors, layers = pickle.loads(b"".join(pieces))
        shard = cls(nodes, copies, vectors)
        shard.graph = Graph.__new__(Graph)
        shard.graph.vectors, shard.graph.layers = shard.narrow, layers
        return shard

    def sure(self, queries: np.ndarray, q: np.ndarray, k: np.ndarray, least: float) -> np.ndarray:
        """Which pairs of a query and a node are links, in double precision; a bounded number of pairs at a time."""
        step = max(1, PAIR_NUMBERS // queries.shape[1])
        parts = [np.einsum("kd,kd->k", queries[q[at : at + step]], _units(self.vectors[k[at : at + step]])) >= least for at in range(0, len(q), step)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's nodes by falling level, their vectors and graph, in rows of ``PIECE_BYTES``."""
    pdf = pdf.sort_values("node")
    nodes = pdf["node"].to_numpy()
    levels = levels_of(nodes)
    order = np.argsort(-levels, kind="stable")
    shard = Shard(nodes[order], pdf["copies"].to_numpy()[order], np.stack(pdf["vector"].to_numpy())[order])
    shard.graph = Graph(shard.narrow, levels[order])
    pieces = shard.pieces()
    return pd.DataFrame({"dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "piece": range(len(pieces)), "data": pieces}).astype({c: "int32" for c in ("dim", "shard", "piece")})


def _whole(queries: np.ndarray, shard: Shard, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of all links, by comparing with the whole shard: some queries at a time, each in one part."""
    step = max(1, SCORES // max(len(shard.nodes), 1))
    for at in range(0, len(queries), step):
        mine = queries[at : at + step]
        q, k = np.nonzero(mine.astype(np.float32) @ shard.narrow.T >= least - 1e-3)
        sure = shard.sure(mine, q, k, least)
        yield q[sure] + at, k[sure]


def _walk(queries: np.ndarray, shard: Shard, least: float, beam: int, whole: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of the links that beams find, each query's in one part; full beams are widened.

    Queries compared with the whole shard are told in ``whole``.
    """
    left = np.arange(len(queries))
    while len(left) and beam <= WIDEST and beam < len(shard.nodes):
        ids, near = shard.graph.search(queries[left].astype(np.float32), beam)
        close = (ids >= 0) & (near >= least - 1e-3)
        full = close.all(axis=1)
        q, k = np.nonzero(close & ~full[:, None])
        q, k = left[q], ids[q, k]
        sure = shard.sure(queries, q, k, least)
        yield q[sure], k[sure]
        left, beam = left[full], beam * 4
    if whole is not None:
        whole.append(left)
    for q, k in _whole(queries[left], shard, least):
        yield left[q], k


def _beams() -> list[int]:
    beams = [BEAM]
    while beams[-1] * 2 <= WIDEST:
        beams.append(beams[-1] * 2)
    return beams


def audit_shard(sample: pd.DataFrame, pieces: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of queries in a shard, and those found, by beam: a query's own node is no link,
    and queries that a beam leaves to the whole shard are no evidence for it."""
    rows = []
    if len(sample) and len(pieces):
        shard = Shard.of(pieces.sort_values("piece")["data"])
        asked, dim = sample["node"].to_numpy(), int(pieces["dim"].iloc[0])
        for at in range(0, len(asked), AUDIT_STEP):
            own = asked[at : at + AUDIT_STEP]
            mine = _units(np.stack(sample["vector"].iloc[at : at + AUDIT_STEP].to_numpy()))

            def links(parts: Iterable[tuple[np.ndarray, np.ndarray]], own: np.ndarray) -> np.ndarray:
                n = np.zeros(len(own), np.int64)
                for q, k in parts:
                    n += np.bincount(q[shard.nodes[k] != own[q]], minlength=len(own))
                return n

            truth = links(_whole(mine, shard, least), own)
            some = np.flatnonzero(truth)
            for beam in _beams() if len(some) else ():
                whole: list[np.ndarray] = []
                found = links(_walk(mine[some], shard, least, beam, whole), own[some])
                told = np.delete(np.arange(len(some)), np.concatenate(whole))
                rows.append(pd.DataFrame({"dim": dim, "node": own[some[told]], "beam": beam, "truth": truth[some[told]], "found": found[told]}))
    return pd.concat(rows) if rows else pd.DataFrame({c: [] for c in ("dim", "node", "beam", "truth", "found")}).astype("int64")


def pick_beam(seen: dict[int, tuple[int, float]], everyone: bool, last: bool) -> int | None:
    """The least beam that passes, from beam -> (queries with links, their mean recall); None asks for more queries.

    With ``everyone`` drawn, few queries with links are all there are. In the ``last`` draw
    too few are no pass: the widest beam is taken if it lost nothing seen, else the whole shard.
    """
    for beam in _beams():
        queries, recall = seen.get(beam, (0, 1.0))
        if (everyone or queries >= ENOUGH) and recall >= RECALL:
            return beam
    if not (everyone or last) and min(seen.get(beam, (0, 1.0))[0] for beam in _beams()) < ENOUGH:
        return None
    queries, recall = seen.get(_beams()[-1], (0, 1.0))
    return _beams()[-1] if queries < ENOUGH and recall >= RECALL else 2 * WIDEST


def audited_beams(nodes: DataFrame, graphs: DataFrame, shards: int, count: int, least: float) -> dict[int, int]:
    """dim -> beam. Recall is that of a query over all shards, averaged over queries; draws
    grow fourfold up to ``MOST_AUDIT`` queries or all nodes."""
    beams: dict[int, int] = {}
    open_ = sorted(r.dim for r in graphs.select("dim").distinct().collect())
    draw, parts = AUDIT, 1 << 30
    while open_:
        share = min(parts, -(-draw * parts // max(count, 1)))
        drawn = nodes.where(F.col("dim").isin(open_) & (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(parts)) < share))
        asked = drawn.select("dim", "node", "vector", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        by = ("dim", "shard")
        told = asked.groupBy(*by).cogroup(graphs.where(F.col("dim").isin(open_)).groupBy(*by)).applyInPandas(lambda a, b: audit_shard(a, b, least), _AUDITED)
        queries = told.groupBy("dim", "beam", "node").agg((F.sum("found") / F.sum("truth")).alias("recall"))
        rows = queries.groupBy("dim", "beam").agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall")).collect()
        for dim in open_:
            beam = pick_beam({r.beam: (r.n, r.recall) for r in rows if r.dim == dim}, share == parts, draw >= MOST_AUDIT)
            if beam is not None:
                beams[dim] = beam
        open_ = [d for d in open_ if d not in beams]
        draw *= 4
    return beams


class Asked:
    """A shard that blocks of queries are put to, and the forest of what they have linked so far."""

    def __init__(self, shard: Shard, least: float, beam: int) -> None:
        self.shard, self.least, self.beam = shard, least, beam
        self.label = np.arange(len(shard.nodes))

    def block(self, asked: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node, copies linked and a tree's name for each query with links."""
        nodes, label = self.shard.nodes, self.label
        total, mine = np.zeros(len(asked), np.int64), np.full(len(asked), -1, np.int64)
        for at in range(0, len(asked), STEP):
            for q, k in _walk(_units(queries[at : at + STEP]), self.shard, self.least, self.beam):
                other = nodes[k] != asked[at + q]
                q, k = q[other] + at, k[other]
                if not len(q):
                    continue
                order = np.argsort(q, kind="stable")
                q, k = q[order], k[order]
                np.add.at(total, q, self.shard.copies[k])
                starts = np.flatnonzero(np.diff(q, prepend=-1))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(q)], strict=True):
                    labels = np.unique(label[k[a:b]])
                    if len(labels) > 1:
                        label[np.isin(label, labels)] = labels[0]
                    mine[q[a]] = labels[0]
        linked = np.flatnonzero(mine >= 0)
        # the shard's node that carries the label names the tree
        return asked[linked], total[linked], nodes[label[mine[linked]]]

    def forest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that hang under others; names told before are among them if their trees have grown together."""
        touched = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.shard.nodes[touched], np.zeros(len(touched), np.int64), self.shard.nodes[self.label[touched]]


def ask_shards(batches: Iterable[pa.RecordBatch], least: float, beams: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Links between shards and their queries: copies linked per query, and a forest.

    The pieces of a shard come first, then its queries, which are not held: a worker has one
    shard and one batch.
    """
    by: tuple | None = None
    pieces: list[bytes] = []
    asked: Asked | None = None
    told = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["node", "n", "root"])
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "part")] + [batch.column("piece").to_numpy(zero_copy_only=False) == QUERY], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            *key, query = keys[a].tolist()
            if key != by:
                if asked is not None:
                    yield told(asked.forest())
                by, pieces, asked = key, [], None
            if not query:
                pieces += batch.column("data").slice(a, b - a).to_pylist()
                continue
            if pieces:
                asked, pieces = Asked(Shard.of(pieces), least, beams[key[0]]), []
            if asked is not None:
                vectors = batch.column("vector").slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                yield told(asked.block(batch.column("node").slice(a, b - a).to_numpy(), vectors))
    if asked is not None:
        yield told(asked.forest())


def deal(count: int, dim: int, cores: int) -> tuple[int, int]:
    """Into how many shards nodes are dealt, and into how many parts the queries of a shard.

    A shard is moved once for each part, so there are no more than keep the cores busy
    and parts small enough.
    """
    shards = max(LEAST_SHARDS, -(-count // SHARD_NODES), -(-count * dim * 8 // SHARD_BYTES))
    busy = min(-(-count // BLOCK_NODES), -(-4 * cores // shards))
    return shards, max(1, busy, -(-count // PART_NODES))


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """One row per row of ``df``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, zero, or hold null or non-finite components link with nothing;
    vectors of different lengths never link. Equal vectors are linked, so repeated rows
    count each other. Recall of the links is audited, not certain; without enough queries
    with links among ``MOST_AUDIT``, the widest beam is taken unaudited. None below ``least`` is
    returned. Other columns of ``df`` are not returned. An empty table gives no rows.
    """
    ship_package(df.sparkSession)
    v = F.col("vector")
    kind = "array<float>" if df.select(vector).schema[0].dataType == ArrayType(FloatType(), True) else "array<double>"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("node", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64(v.cast("array<double>"))))
    rows = staged(rows, "vectors")
    named = rows.where("node is not null")
    nodes = staged(named.groupBy("node").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "nodes")
    nodes = nodes.withColumn("dim", F.size("vector"))
    count, longest = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(0))).first()
    shards, parts = deal(count, longest, df.sparkSession.sparkContext.defaultParallelism)
    sharded = nodes.withColumn("shard", F.pmod(F.hash("node", F.lit(1)), F.lit(shards)))
    graphs = staged(sharded.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(build_shard, "dim int, shard int, piece int, data binary"), "graphs")
    beams = audited_beams(nodes, graphs, shards, count, least)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = nodes.select("dim", "node", "vector", F.pmod(F.hash("node", F.lit(2)), F.lit(parts)).alias("part"), F.lit(QUERY).alias("piece"), every(shards).alias("shard"))
    placed = graphs.select("dim", "shard", every(parts).alias("part"), "piece", "data").unionByName(asked, allowMissingColumns=True)
    dealt = placed.repartitionById(shards * parts, F.col("shard") * parts + F.col("part")).sortWithinPartitions("dim", "shard", "part", "piece")
    found = staged(over_arrow(dealt, lambda batches: ask_shards(batches, least, beams), _FOUND), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = staged(nodes.select("node", "copies", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "grouped")
    first = staged(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "firsts")
    told = staged(grouped.join(first, "root").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")
    out = rows.drop("vector").join(told, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
