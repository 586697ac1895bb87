"""Importance resampling against brute force, and its table against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from codeloom.llm import importance
from codeloom.llm.gram_table import GramTable, Ranges

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, rank string, score string, part int, bucket long"


def features(text, orders):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return w, [" ".join(w[k : k + n]) for n in range(1, orders + 1) for k in range(len(w) - n + 1)]


def brute(docs, target, orders=1, buckets=10_000, percent=10, least=20, seed=2024):
    """Rows (doc_id, n_features, weight, score, rank) by the plain rule."""
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    source, wanted = Counter(), Counter()
    for _, text in docs:
        source.update(map(bucket, features(text, orders)[1]))
    for text in target:
        wanted.update(map(bucket, features(text, orders)[1]))
    s, t = sum(source.values()), sum(wanted.values())
    out = []
    for i, text in docs:
        w, f = features(text, orders)
        gains = [math.floor(1000 * math.log((wanted[bucket(g)] + 1.0) * (s + buckets) / ((source[bucket(g)] + 1.0) * (t + buckets)))) for g in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {f.dataType.simpleString() for f in df.schema} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    assert got(importance.op13_importance_resample(spark, SMALL)) == brute(docs, target)


@pytest.mark.parametrize("orders", [1, 3])
def test_hard_rows(spark, monkeypatch, orders):
    """Nulls, empty, long and repeated rows, words beyond ASCII, clashing columns; small tables."""
    monkeypatch.setattr(importance, "TABLE_GRAMS", 50)
    draw = random.Random(3)
    vocabulary = ["a", "Be", "été", "日本語", "x" * 70, "12", "don't", "w" * 33]
    rows = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(60)))) for k in range(60)]
    rows += [(None, None), (None, "b " * 25), (None, "b " * 25), (70, ""), (71, "\x00 \n"), (72, "tail " * 3000), (5, rows[5][1]), (5, "other " * 30)]
    docs = spark.createDataFrame([(i, t, "r", "s", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    target = spark.createDataFrame([(1, "été 12 be be"), (2, None)], "item_id long, text string")
    found = importance.importance(docs, target, orders=orders, percent=50)
    assert got(found) == brute(rows, ["été 12 be be", None], orders, percent=50)
    kept = importance.resample(docs, target, orders=orders, percent=50)
    assert kept.columns == docs.columns
    drawn = {r["doc_id"] for r in found.where("rank is not null").collect()} - {None}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i in drawn)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two " * 20), (2, "two")], "doc_id long, text string")
    assert importance.importance(none, none).collect() == []
    assert got(importance.importance(some, none, percent=100)) == brute([(1, "one two " * 20), (2, "two")], [], percent=100)


def test_table_counts_and_hashes():
    draw = random.Random(1)
    sizes = [0, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 31, 32, 33, 63, 64, 65, 200]
    held = [bytes(draw.randrange(97, 100) for _ in range(draw.choice(sizes))) for _ in range(3000)]
    size = np.array([len(w) for w in held])
    found = Ranges(np.frombuffer(b"".join(held), np.uint8), np.cumsum(size) - size, size)
    assert found.xxhash64().tolist() == [xxhash.xxh64_intdigest(w) for w in held]
    counts = Counter(held)
    made = GramTable(found, 97)
    assert all(made.count[s] == counts[w] and made.bucket[s] == zlib.crc32(w) % 97 for s, w in zip(made.slot.tolist(), held, strict=True))
    assert len(set(made.slot.tolist())) == len(counts)


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all, only the bytes tell n-grams apart."""
    held = [b"a", b"b", b"a", b"", b"longer than eight", b"longer than eighT", b"longer than eight"]
    size = np.array([len(w) for w in held])
    monkeypatch.setattr(Ranges, "xxhash64", lambda self: np.zeros(len(self), np.uint64))
    made = GramTable(Ranges(np.frombuffer(b"".join(held), np.uint8), np.cumsum(size) - size, size), 10)
    assert made.count[made.slot].tolist() == [2, 1, 2, 1, 2, 1, 2]
