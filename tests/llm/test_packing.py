"""Best-fit packing: the tokenizers library, the plain rule item by item, and exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm import packing
from codeloom.llm.best_fit import Capacity, plan
from codeloom.llm.words_tokenizer import vocabulary_path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, sequence_id string, offset string, length int, ids int, part int, nth int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))


def check(rows, texts, library, capacity=Capacity()):
    """All ids, cuts, checksums and places of the pieces ``rows`` of (doc_id, text) ``texts``."""
    wanted = Counter()
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        rest = len(ids) % capacity.longest or capacity.longest
        cuts = [0, *range(rest, len(ids), capacity.longest), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= capacity.tokens and len(held) <= capacity.documents
        assert sum(n * n for _, n in held) <= capacity.attention
    return len(bins)


def test_query_round_trip(spark, library):
    texts = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    df = packing.op12_vector_best_fit(spark, SMALL)
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = df.collect()
    assert check(rows, texts, library) <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_hard_rows_under_all_constraints(spark, library, rule):
    """Nulls, empty, long and repeated rows, special tokens in texts, clashing columns, over several tasks."""
    draw = random.Random(4)
    texts = [(k, "word " * draw.randrange(90)) for k in range(80)] + [(None, None), (None, "a"), (1, ""), (2, "long " * 5000), (3, "<|endoftext|> x <|endo"), (4, " \n\t 日本語 é\x00")]
    texts += [(9, "copy of one row")] * 20
    docs = spark.createDataFrame([(i, t, "s", "o", 1, 2, 3, 4) for i, t in texts], SCHEMA).repartition(5)
    capacity = Capacity(tokens=100, documents=4, attention=6_000)
    found = packing.pack(docs, capacity=capacity, rule=rule, weights=(1, 1, 1))
    assert found.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rows = found.withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, texts, library, capacity)
    for r in packing.sequences(found).collect():
        held = sorted((x["offset"], x["length"], bytes(x["ids"])) for x in rows if x["sequence_id"] == r["sequence_id"])
        assert bytes(r["ids"]) == b"".join(x for _, _, x in held) and r["lengths"] == [n for _, n, _ in held]
        assert len(r["ids"]) == 4 * r["n_tokens"]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [Capacity(50, 50, 2500), Capacity(50, 3, 2500), Capacity(50, 50, 900), Capacity(50, 4, 1200)])
def test_plan_is_best_fit_item_by_item(rule, capacity):
    draw, weights = random.Random(5), np.array([1.0, 0.3, 0.5])
    counts = Counter(draw.randrange(1, capacity.longest + 1) for _ in range(400))
    whole, bins = capacity.vector(), []
    for length in sorted(counts.elements(), reverse=True):
        need = np.array([length, 1, length * length])
        able = [b for b in bins if (b >= need).all()]
        if not able:
            bins.append(whole.copy())
            able = bins[-1:]
        def score(b):
            return ((((b - need) / whole) ** 2) * weights).sum() if rule == "norm" else (b / whole * (need / whole) * weights).sum()
        able[int(np.argmin([score(b) for b in able]))][:] -= need
    steps, number = plan(counts, capacity, tuple(weights), rule)
    left = {k: whole.copy() for k in range(number)}
    placed = Counter()
    for s in steps:
        placed[s.length] += s.items
        for k in range(s.items):
            assert capacity.tokens - left[s.bin + k // s.each][0] == s.offset + k % s.each * s.length
            left[s.bin + k // s.each] -= np.array([s.length, 1, s.length**2])
    assert placed == counts and all((b >= 0).all() for b in left.values())
    assert sorted(map(tuple, left.values())) == sorted(map(tuple, bins))


def test_encoder_equals_the_library(library):
    encoder = packing.byte_encoder(vocabulary_path(packing.VOCABULARY))
    draw = random.Random(6)
    texts = ["", "<|endoftext|>", "It's 'LL we'll", "x" * 20_000, " " * 3000 + "q", "\r\n\r\n a", "\x85\x1c  　z"]
    texts += ["".join(draw.choice(" \n\t'stdllé日1_.<|>\x1e\x85 ​") for _ in range(50)) for _ in range(500)]
    for text in texts:
        assert encoder.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


def test_bad_arguments():
    with pytest.raises(ValueError):
        Capacity(0, 1, 1)
    with pytest.raises(ValueError):
        plan({1: 1}, Capacity(), (1, 1, 1), "best")
    with pytest.raises(ValueError):
        plan({2000: 1}, Capacity(), (1, 1, 1))
