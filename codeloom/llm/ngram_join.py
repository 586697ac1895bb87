"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct shingles, in one global order: rarest first by a count
sketch over all documents. Two sets with Jaccard >= t share at least l shingles among
their first n - ceil(t * n) + l, for any l. Each document chooses its own l: a longer
prefix costs postings but demands more shared shingles before a pair is verified, which
pays where the estimated number of candidates is high. Pairs are then verified on the
whole sets.

Equal sets are one node throughout. Links inside one component need no further pairs:
first every posting list links to its least node only, then the lists are joined between
nodes that are still apart. So a large group of copies costs a star, not all its pairs, and
no link between components is lost.
The components are found; links inside them are neither made nor counted.

The join itself meets on the core of a prefix only. The first token that two similar sets
share stands among the first n - ceil(2t / (1 + t) * n) + 1 of the smaller and the first
m - ceil(t * m) + 1 of the larger one, and leaves enough tokens behind it. The longer
prefixes then say how many tokens a pair shares before it is verified.

A list where more than ``CROWD`` pairs would meet is not joined: its nodes are dealt to tiles
of bounded size, and each two tiles are compared on whole sets as a product of matrices. So
rows grow with the postings; the comparisons inside a crowded list stay one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import Words, not_space, over_arrow, slices, small, staged, table
from codeloom.llm.components import components
from codeloom.operators.skew import keep_listed
from codeloom.session import ship_package

WORDS, PERCENT = 5, 80
SKETCH_BITS = 20
CHUNKS = 64
MOST_MATCHES = 8
VERIFY_COST = 20.0  # of a candidate, in postings
CROWD = 4096  # pairs of a list's sides that are still met as rows: 64 a posting at most
TILE_NODES, TILE_SHINGLES = 2048, 1 << 19  # one side of a comparison of tiles, about
TILE_COLUMNS = 1024  # shingles that one matrix product covers
_PROFILE = "doc_id long, n_shingles int, node long, text_key long, chunk int, counts binary"


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text; a shorter text is one shingle."""
    words = Words(column, not_space())
    grams = words.grams(size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            few = words.hash[a:b]
            yield np.array([xxhash.xxh3_64_intdigest(few.tobytes())], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """64 bits that stand for the set; two of 10^9 different sets collide with odds of 1 in 40."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """Per document its set size and node, and per task the shingle counts by upper bits."""

    def work(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(batch.column("text"), size))
            held = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((held >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                batch.column("text_key"), none.cast(pa.int32()), none.cast(pa.binary()),
            ], names=["doc_id", "n_shingles", "node", "text_key", "chunk", "counts"])
        none = pa.nulls(CHUNKS)
        yield pa.RecordBatch.from_arrays([
            none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()),
            pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in np.split(counts, CHUNKS)], pa.binary()),
        ], names=["doc_id", "n_shingles", "node", "text_key", "chunk", "counts"])

    return staged(over_arrow(docs, work, _PROFILE), "profiles")


def sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts: 2^20 numbers, added in two steps of bounded groups."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "counts": [total.tobytes()]})

    parts = rows.where("chunk is not null").select("chunk", "counts", F.pmod(F.spark_partition_id(), F.lit(256)).alias("lane"))
    parts = parts.groupBy("chunk", "lane").applyInPandas(lambda p: add(p), "chunk int, counts binary")
    parts = parts.groupBy("chunk").applyInPandas(lambda p: add(p), "chunk int, counts binary")
    found = {r["chunk"]: np.frombuffer(r["counts"], np.int64) for r in parts.collect()}
    return np.concatenate([found[k] for k in range(CHUNKS)]) if found else np.zeros(1 << SKETCH_BITS, np.int64)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def choose_prefix(shingles: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set and how many shared shingles it demands.

    ``counts`` are the sketch's; what exceeds ``noise`` estimates how many others hold a
    shingle. Of the candidates that share any, at most 1 / l can share l.
    """
    n = len(shingles)
    order = np.lexsort((shingles, counts))
    others = np.cumsum(np.maximum(counts[order] - noise, 0.0))
    own = least_overlap(n, percent)
    matches = np.arange(1, min(MOST_MATCHES, own) + 1)
    lengths = n - own + matches
    cost = lengths + others[lengths - 1] * (1 + VERIFY_COST / matches)
    best = int(np.argmin(cost))
    return shingles[order[: lengths[best]]], int(matches[best])


def postings(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """(token, pos, node, n, need) of all prefixes whose token stands in two nodes or more, and the list's least node."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int64))  # 8 MB at any size of input

    def work(batches):
        table_, seen = shared.value, set()
        mean = table_.mean()
        noise = max(1.0, mean + 3 * np.sqrt(mean))
        for batch in slices(batches, "text"):
            tokens, places, nodes, sizes, needs = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                if not len(s) or (node := set_key(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)  # spares copies in this task their postings
                prefix, need = choose_prefix(s, table_[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.float64), noise, percent)
                tokens.append(prefix)
                places.append(np.arange(len(prefix), dtype=np.int32))
                nodes.append(np.full(len(prefix), node, np.int64))
                sizes.append(np.full(len(prefix), len(s), np.int32))
                needs.append(np.full(len(prefix), need, np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in tokens], places, nodes, sizes, needs)], names=["token", "pos", "node", "n", "need"])

    rows = over_arrow(docs, work, "token long, pos int, node long, n int, need int")
    own = Window.partitionBy("token")
    rows = rows.withColumns({"center": F.min(F.struct("node", "n", "need")).over(own), "last": F.max("node").over(own)})
    return staged(rows.where("center.node <> last").drop("last").distinct(), "postings")


def _possible(shared: Column, n: Column, need: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether ``shared`` prefix tokens leave room for the overlap that n and m demand.

    Tokens behind a prefix number ceil(t * n) - l. The side whose prefix ends first has all
    its common tokens up to there counted.
    """
    behind = F.greatest(F.ceil(n * percent / 100) - need, F.ceil(m * percent / 100) - other)
    return (shared >= F.least(need, other)) & (shared + behind >= F.ceil((n + m) * percent / (100 + percent)))


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def star_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) between each list's least node and the others that its own lists suffice to show."""
    rows = posts.where("node <> center.node").where(_sizes_fit(F.col("n"), F.col("center.n"), percent))
    pairs = rows.groupBy(F.col("center.node").alias("a"), F.col("node").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("need").alias("l"), F.first("center.n").alias("m"), F.first("center.need").alias("k"))
    return pairs.where(_possible(F.col("c"), F.col("n"), F.col("l"), F.col("m"), F.col("k"), percent)).select("a", "b")


def live_lists(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """Posting rows with their node's root, of the lists that hold more than one root."""
    labels = staged(posts.drop("center").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    lists = labels.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    return staged(labels.join(staged(lists.where("x <> y").select("token"), "apart"), "token", "left_semi"), "live")


def meetings(live: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The smaller and the larger sides of the join.

    Its key is the token and a band of set sizes, so that only sets of compatible sizes
    meet, and only on the cores of their prefixes.
    """
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rows = live.withColumn("band", band)
    smaller = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent))
    larger = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100)
    left = rows.where(smaller).select("token", F.explode(F.array("band", F.col("band") + 1, F.col("band") + 2)).alias("band"), F.col("node").alias("a"), F.col("n").alias("n"), F.col("need").alias("l"), F.col("root").alias("ra"), F.col("pos").alias("i"))
    right = rows.where(larger).select("token", "band", F.col("node").alias("b"), F.col("n").alias("m"), F.col("need").alias("k"), F.col("root").alias("rb"), F.col("pos").alias("j"))
    return left, right


def crowded(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys at which more than ``CROWD`` pairs would meet, and into how many tiles each side is dealt."""
    sides = left.select("token", "band", F.lit(1).alias("x"), F.lit(0).alias("y"), F.col("n").alias("p"), F.lit(0).alias("q"))
    sides = sides.unionByName(right.select("token", "band", F.lit(0).alias("x"), F.lit(1).alias("y"), F.lit(0).alias("p"), F.col("m").alias("q")))
    sums = sides.groupBy("token", "band").agg(*[F.sum(c).alias(c) for c in "xypq"]).where(F.col("x") * F.col("y") > CROWD)
    tiles = lambda rows, shingles: F.ceil(F.greatest(F.col(rows) / TILE_NODES, F.col(shingles) / TILE_SHINGLES)).cast("int")
    return staged(sums.select("token", "band", tiles("x", "p").alias("lefts"), tiles("y", "q").alias("rights")), "crowded")


def remaining_pairs(left: DataFrame, right: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """All candidates between nodes of different components that meet as rows.

    A similar pair meets on its first shared token too; there, all that it shares lies from
    the token on, in both sets.
    """
    ordered = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    room = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    fits = (F.col("n") * 100 >= F.col("m") * percent) & (room * (100 + percent) >= (F.col("n") + F.col("m")) * percent)
    pairs = left.join(right, ["token", "band"]).where((F.col("ra") != F.col("rb")) & ordered & fits)
    pairs = staged(pairs.groupBy("a", "b").agg(*[F.first(x).alias(x) for x in ("n", "l", "m", "k")]), "met")
    ends = staged(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
    held = staged(live.join(ends, "node", "left_semi").groupBy("node").agg(F.collect_list("token").alias("held")), "prefixes")
    pairs = pairs.join(held.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    pairs = pairs.withColumn("c", F.size(F.array_intersect("x", "y")))
    return pairs.where(_possible(F.col("c"), F.col("n"), F.col("l"), F.col("m"), F.col("k"), percent)).select("a", "b")


def tiled(left: DataFrame, right: DataFrame, keys: DataFrame) -> DataFrame:
    """(token, band, one, two, larger, node, n, root, pos): the rows of crowded ``keys``, once for each tile they are compared with."""
    keys = small(keys)
    own = lambda node, count: F.pmod(F.xxhash64(node), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    first = left.join(keys, ["token", "band"]).select("token", "band", own("a", "lefts").alias("one"), every("rights").alias("two"), F.lit(False).alias("larger"), F.col("a").alias("node"), "n", F.col("ra").alias("root"), F.col("i").alias("pos"))
    second = right.join(keys, ["token", "band"]).select("token", "band", every("lefts").alias("one"), own("b", "rights").alias("two"), F.lit(True).alias("larger"), F.col("b").alias("node"), F.col("m").alias("n"), F.col("rb").alias("root"), F.col("j").alias("pos"))
    return first.unionByName(second)


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``x`` shares with each of ``y``, from matrix products over stretches of the shingles in both."""
    flat = [np.concatenate(x), np.concatenate(y)]
    both = np.intersect1d(*flat)
    kind = np.float32 if max(len(s) for s in (*x, *y)) < 1 << 24 else np.float64  # counts that are exact
    out = np.zeros((len(x), len(y)), kind)
    entries = []
    for sets, values in zip((x, y), flat, strict=True):
        rows, found = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.isin(values, both)
        columns, rows = np.searchsorted(both, values[found]), rows[found]
        order = np.argsort(columns, kind="stable")
        entries.append((columns[order], rows[order]))
    for at in range(0, len(both), TILE_COLUMNS):
        sides = []
        for (columns, rows), sets in zip(entries, (x, y), strict=True):
            part = slice(*np.searchsorted(columns, [at, at + TILE_COLUMNS]))
            side = np.zeros((len(sets), min(TILE_COLUMNS, len(both) - at)), kind)
            side[rows[part], columns[part] - at] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def tile_links(rows: pa.Table, percent: int) -> pa.Table:
    """The links (a, b) between a tile of smaller and one of larger sets, one for every two components."""
    larger = rows.column("larger").to_numpy()
    order = [np.flatnonzero(~larger), np.flatnonzero(larger)]
    n, root, node, pos = (rows.column(c).to_numpy() for c in ("n", "root", "node", "pos"))
    n, pos = n.astype(np.int64), pos.astype(np.int64)

    def grid(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return values[order[0]][:, None], values[order[1]][None, :]

    (x, y), (a, b), (i, j), (p, q) = grid(n), grid(node), grid(pos), grid(root)
    fits = (p != q) & ((x < y) | ((x == y) & (a < b))) & (x * 100 >= y * percent)
    fits &= np.minimum(x - i, y - j) * (100 + percent) >= (x + y) * percent
    order = [order[0][fits.any(1)], order[1][fits.any(0)]]
    fits = fits[fits.any(1)][:, fits.any(0)]
    if not fits.size:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    held = rows.column("held")
    both = shared_counts(*[[np.frombuffer(held[k].as_buffer(), np.uint64) for k in side.tolist()] for side in order])
    one, two = np.nonzero(fits)
    shared = both[one, two].astype(np.int64)
    one, two = order[0][one], order[1][two]
    similar = 100 * shared >= percent * (n[one] + n[two] - shared)
    one, two = one[similar], two[similar]
    _, first = np.unique(np.stack([np.minimum(root[one], root[two]), np.maximum(root[one], root[two])]), axis=1, return_index=True)
    return pa.table({"a": node[one[first]], "b": node[two[first]]})


def crowd_links(rows: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links between components in crowded lists: every two tiles of ``tiled`` rows are compared on whole sets."""
    ship_package(rows.sparkSession)
    wide = rows.join(held, "node")
    links = wide.groupBy("token", "band", "one", "two").applyInArrow(lambda t: tile_links(t, percent), "a long, b long")
    return staged(links.distinct(), "crowd")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links: components of the old roots, so that rows grow with roots."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        known = roots.select(F.col("node").alias(end), F.col("root").alias("r"))
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    above = staged(components(ends).select(F.col("node").alias("root"), F.col("root").alias("top")), "above")
    old = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = above.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti")
    return staged(old.unionByName(fresh), "roots")


def linked_roots(posts: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of all linked nodes: stars first, then every candidate between components, as rows or in tiles."""
    links = verified(staged(star_pairs(posts, percent), "stars"), texts, nodes, size, percent)
    roots = staged(components(links), "roots")
    live = live_lists(posts, roots)
    left, right = meetings(live, percent)
    keys = crowded(left, right)
    if not keys.head(1):
        rest = staged(remaining_pairs(left, right, live, percent), "remaining")
        return merged(roots, verified(rest, texts, nodes, size, percent)) if rest.head(1) else roots
    listed = small(keys.select("token", "band"))
    rest = staged(remaining_pairs(left.join(listed, ["token", "band"], "left_anti"), right.join(listed, ["token", "band"], "left_anti"), live, percent), "remaining")
    tiles = staged(tiled(left, right, keys), "tiles")
    held = whole_sets(ends_of(rest).unionByName(tiles.select("node")).distinct(), texts, nodes, size)
    links = similar_pairs(rest, held, percent).unionByName(crowd_links(tiles, held, percent))
    return merged(roots, links)


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def whole_sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, held): the whole set of each node of ``wanted``, as bytes."""
    keys = staged(nodes.join(wanted, "node", "left_semi").select("text_key"), "wanted")

    def sets(batches):
        seen = set()
        for batch in slices(batches, "text"):
            found = [(set_key(s), s.tobytes()) for s in shingle_sets(batch.column("text"), size) if len(s)]
            found = [x for x in dict(found).items() if x[0] not in seen]
            if len(seen) < 1_000_000:
                seen.update(node for node, _ in found)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["node", "held"])

    held = over_arrow(keep_listed(docs, keys, ["text_key"]), sets, "node long, held binary").groupBy("node").agg(F.first("held").alias("held"))
    return staged(held, "sets")


def similar_pairs(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose ``held`` sets are similar enough."""

    def similar(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(held.select(F.col("node").alias("b"), F.col("held").alias("y")), "b").join(held.select(F.col("node").alias("a"), F.col("held").alias("x")), "a")
    return staged(over_arrow(joined.select("a", "b", "x", "y"), similar, "a long, b long"), "similar")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    return similar_pairs(pairs, whole_sets(ends_of(pairs).distinct(), docs, nodes, size), percent)


def _grouped(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Per row its set size, text key, component and the component's root node (null for empty sets)."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    rows = profiles(texts, size)
    sized = rows.where("chunk is null").select("doc_id", "n_shingles", "node", "text_key")
    nodes = staged(sized.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key")), "nodes")
    posts = postings(texts, sketch(rows), size, percent)
    roots = linked_roots(posts, texts, nodes, size, percent)
    linked = staged(nodes.join(roots, "node").select("node", "root", "least"), "members")
    linked = linked.join(staged(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least"), "root").select("node", "root", "component_id")
    ids = staged(nodes.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "least").alias("component_id")), "ids")
    return sized.join(ids, "node", "left").select("doc_id", "text_key", "root", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Links: Jaccard of the sets of ``size`` lower-cased words >= ``percent`` / 100. Null and
    wordless texts have an empty set and are alone; fewer words than ``size`` are one shingle.
    ``component_id`` is the least key reachable; equal sets are linked, so repeated rows
    share it. Other columns of ``docs`` are not returned. An empty table gives no rows.
    """
    return _grouped(docs, key, text, size, percent).drop("text_key", "root")


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the least key.

    Null keys come last; of equal keys the least text hash stays, of equal rows one. Documents without words are
    in no group and all stay. All columns stay as they are.
    """
    names = docs.columns
    grouped = staged(_grouped(docs, key, text, size, percent).where("root is not null"), "grouped")
    grouped = grouped.select("root", F.xxhash64("doc_id", "text_key").alias("row"), F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_key").alias("t")).alias("rank"))
    first = staged(grouped.groupBy("root").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "firsts")
    placed = grouped.join(first, "root").select("row", "rank", "first")
    losers = staged(placed.where("rank <> first").select("row").distinct(), "losers")
    again = staged(placed.where("rank = first").groupBy("row").count().where("count > 1").select("row"), "again")
    marked = docs.withColumn("__row", F.xxhash64(F.col(key).cast("long"), F.xxhash64(text)))
    kept = marked.join(small(losers.withColumnRenamed("row", "__row"), 500_000), "__row", "left_anti")
    if again.head(1):
        repeated = small(again.withColumnRenamed("row", "__row"), 500_000)
        single = kept.join(repeated, "__row", "left_semi").groupBy("__row").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in names])).alias("held"))
        kept = kept.join(repeated, "__row", "left_anti").select(*names).unionByName(single.select("held.*"))
    return kept.select(*[F.col(f"`{c}`") for c in names])


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
