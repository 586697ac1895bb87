"""Memory of a worker that writes token files, beside others on its executor."""

import tracemalloc

import numpy as np
import pyarrow as pa

from codeloom.llm.common import slices
from codeloom.llm.words_tokenizer import BATCH_BYTES, WordTokenizer, vocabulary_path


def test_encoding_holds_little():
    rng = np.random.default_rng(1)
    known = np.array([f"w{k}" for k in range(2_000)])
    texts = [" ".join(known[rng.integers(0, len(known), 1_000)]) for _ in range(1_200)]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    tokenizer = WordTokenizer(vocabulary_path())
    tokenizer.encode(pa.array([" ".join(known)]))
    tracemalloc.start()
    sizes = [tokenizer.encode(part.column("t"), 1)[1] for part in slices([batch], "t", BATCH_BYTES)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(s) for s in sizes) == len(texts)
    assert peak < 80 << 20, peak


def test_memo_learns_in_any_order():
    tokenizer = WordTokenizer(vocabulary_path())
    rng = np.random.default_rng(2)
    for _ in range(5):
        texts = [" ".join(f"{'abcdefgh'[k % 8]}{k}," for k in rng.integers(0, 3_000, 200)) for _ in range(5)]
        ids, sizes = tokenizer.encode(pa.array(texts))
        want = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
        assert (np.diff(tokenizer.hashes.astype(object)) > 0).all()
