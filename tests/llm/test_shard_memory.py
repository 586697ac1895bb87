"""What a worker and a row hold of a shard of vectors, whatever the size of a group of near copies."""

import subprocess
import sys

import numpy as np
import pandas as pd

from codeloom.llm import embedding_dedup

SCRIPT = """
import resource
import numpy as np, pandas as pd
from codeloom.llm import embedding_dedup as e
rng = np.random.default_rng(0)
v = (np.ones(64) + rng.normal(size=(9_000, 64)) * 0.01).astype(np.float32)
nodes = pd.DataFrame({"dim": 64, "shard": 0, "node": np.arange(len(v)), "copies": 1, "vector": list(v)})
pieces = e.build_shard(nodes)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
asked = e.Asked(e.Shard.of(pieces["data"]), 0.9, 24)
_, links, roots = asked.block(nodes["node"].to_numpy()[:256], v[:256])
assert (links == len(v) - 1).all() and len(set(roots)) == 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_group_of_near_copies_is_no_matrix_of_pairs():
    """256 queries have 2.3 million links here: 2.4 GB of vectors, if all were held at once."""
    said = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=300, check=True)
    assert int(said.stdout) < 300


def test_rows_of_a_shard_are_small_and_make_it_again():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(6_000, 64)).astype(np.float32)
    pdf = pd.DataFrame({"dim": 64, "shard": 3, "node": rng.permutation(len(v)), "copies": 2, "vector": list(v)})
    rows = embedding_dedup.build_shard(pdf)
    assert len(rows) > 1 and rows["data"].map(len).max() <= embedding_dedup.PIECE_BYTES
    shard = embedding_dedup.Shard.of(rows["data"])
    assert shard.vectors.dtype == np.float32  # as given
    by_node = dict(zip(pdf["node"], v, strict=True))
    assert all((by_node[n] == x).all() for n, x in zip(shard.nodes, shard.vectors, strict=True))


def test_shards_are_moved_a_few_times_and_bounded_in_bytes():
    for count, dim in ((0, 0), (2_000, 64), (51_282, 64), (720_000, 64), (720_000, 1_536)):
        shards, parts = embedding_dedup.deal(count, dim, 12)
        assert count * dim * 8 / shards <= embedding_dedup.SHARD_BYTES + dim * 8 and count / shards <= embedding_dedup.SHARD_NODES
        assert parts >= 1 and count / parts <= embedding_dedup.PART_NODES
    assert embedding_dedup.deal(720_000, 64, 12) == (15, 11)


def test_queries_stream_past_pieces_of_several_shards():
    """Batches that end anywhere, two shards and a dimension without a shard in one task."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(40, 8)), 2, axis=0) + rng.normal(size=(80, 8)) * 0.001
    rows = []
    for shard in (0, 1):
        pdf = pd.DataFrame({"dim": 8, "shard": shard, "node": np.arange(shard, 80, 2), "copies": 1, "vector": list(v[shard::2])})
        data = b"".join(embedding_dedup.build_shard(pdf)["data"])
        rows += [(8, shard, 0, k, data[k * 999 : (k + 1) * 999], None, None) for k in range(-(-len(data) // 999))]
        rows += [(8, shard, 0, embedding_dedup.QUERY, None, n, v[n].tolist()) for n in range(80)]
    rows += [(9, 0, 0, embedding_dedup.QUERY, None, 100, [1.0] * 9)]
    schema = pa.schema({"dim": pa.int32(), "shard": pa.int32(), "part": pa.int32(), "piece": pa.int32(), "data": pa.binary(), "node": pa.int64(), "vector": pa.list_(pa.float64())})
    whole = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    want = None
    for size in (1, 7, len(rows)):
        out = pa.Table.from_batches([*embedding_dedup.ask_shards((whole.slice(a, size) for a in range(0, len(rows), size)), 0.9, {8: 24})]).to_pandas()
        links = out.groupby("node")["n"].sum()
        assert (links == 1).all() and sorted(links.index) == list(range(80))
        assert all({a, b} <= {n ^ 1, n} for n, a, b in zip(out["node"], out["node"], out["root"], strict=True))
        want = want if want is not None else links
        assert links.equals(want)
