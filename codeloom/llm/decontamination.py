"""Benchmark decontamination by a broadcast hash set of test n-grams.

Every benchmark item gives the hashes of its windows of ``n`` consecutive words (one
shorter window if it has fewer words). Documents are scanned where they are: the rolling
hashes of all their windows are looked up in the set, and each hit is verified on the
words themselves. No row is shuffled. Null and wordless texts have no words and no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import Words, alphanumeric, over_arrow, slices, staged

WINDOW = 13
SET_BYTES = 32 << 20  # benchmark text that one broadcast holds; more goes in further passes
HIT_SHARE = 20  # contaminated if at least one word in so many is hit
_HITS = "__hits"
DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowSet:
    """Windows of some benchmark items: hash -> [(words joined by a blank, item ids)]."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int) -> None:
        words = Words(pa.array([text for _, text in items], pa.string()), alphanumeric())
        raw = words.text.tobytes()
        exact: dict[tuple[int, bytes], set[str | None]] = {}
        for i, (item, _) in enumerate(items):
            a, b = int(words.first[i]), int(words.first[i + 1])
            size = min(n, b - a)
            for at in range(a, b - size + 1) if size else ():
                key = b" ".join(raw[words.start[k] : words.end[k]] for k in range(at, at + size))
                exact.setdefault((size, key), set()).add(item)
        self.exact = exact
        by_size: dict[int, list[bytes]] = {}
        for size, key in exact:
            by_size.setdefault(size, []).append(key)
        self.tables = {size: self._filter(size, keys) for size, keys in sorted(by_size.items())}

    @staticmethod
    def _filter(size: int, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order, and a table of their upper 20 bits that rules most windows out."""
        words = Words(pa.array([k.decode("utf-8", "replace") for k in keys], pa.string()), alphanumeric())
        hashes = np.unique(words.grams(size)[words.first[:-1]])
        seen = np.zeros(1 << 20, bool)
        seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
        return hashes, seen

    def scan(self, words: Words) -> list[tuple[int, int, frozenset[str | None]]]:
        """(first word, number of words, item ids) of each window of the set, in order."""
        owner, raw, found = words.owner(), None, []
        for size, (hashes, seen) in self.tables.items():
            grams = words.grams(size)
            at = np.flatnonzero(seen[(grams >> np.uint64(44)).astype(np.int64)])
            at = at[np.searchsorted(hashes, grams[at], "left") < np.searchsorted(hashes, grams[at], "right")]
            at = at[owner[at] == owner[at + size - 1]]
            raw = words.text.tobytes() if raw is None and len(at) else raw
            for i in at.tolist():
                key = b" ".join(raw[a:b] for a, b in zip(words.start[i : i + size].tolist(), words.end[i : i + size].tolist(), strict=True))
                if items := self.exact.get((size, key)):
                    found.append((i, size, frozenset(items)))
        return found


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of at most ``limit`` bytes (one item at least), sized before they are fetched."""
    narrow = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    size = narrow.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    parts = -(-size // limit)
    for part in range(parts):
        rows = narrow.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()
        yield [(r.i, r.t) for r in rows]


def _null_last(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` and a column ``__hits``: (first word, number of words, item ids) of every window found."""
    spark = docs.sparkSession
    schema = T.StructType([f for f in docs.schema.fields if f.name != _HITS])
    kind = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]))
    out = docs.select(*[F.col(f"`{f.name}`") for f in schema.fields]).withColumn(_HITS, F.array().cast(kind))
    arrow = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("items", pa.list_(pa.string()))]))
    for k, items in enumerate(_blocks(benchmark, item, item_text, set_bytes)):
        windows = spark.sparkContext.broadcast(WindowSet(items, n))

        def work(batches, windows=windows):
            for batch in slices(batches, text):
                words = Words(batch.column(text), alphanumeric())
                owner, hits = words.owner(), batch.column(_HITS).to_pylist()
                for at, size, ids in windows.value.scan(words):
                    doc = int(owner[at])
                    hits[doc].append({"at": at - int(words.first[doc]), "n": size, "items": sorted(ids, key=_null_last)})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, arrow)], schema=batch.schema)

        out = over_arrow(out if k == 0 else staged(out, "decontamination"), work, T.StructType([*schema.fields, T.StructField(_HITS, kind)]))
    return out


def _covered(words: Words, hits: list[list[dict]]) -> np.ndarray:
    """Words that lie in any window found."""
    edge = np.zeros(len(words.start) + 1, np.int64)
    for first, found in zip(words.first, hits, strict=False):
        for hit in found:
            edge[first + hit["at"]] += 1
            edge[first + hit["at"] + hit["n"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: key, words, words hit, items with hits, digest of the items, verdict.

    ``items_sha256`` is the digest of the item ids, sorted as strings and joined by commas;
    without items that of the empty string. Items whose id is null hit words as others do;
    together they count as one item and are left out of the digest. Repeated rows each get their row; other columns
    of ``docs`` are not returned, so their names cannot clash.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text"))

    def work(batches):
        for batch in slices(batches, "__text"):
            words = Words(batch.column("__text"), alphanumeric(), hashed=False)
            hits = batch.column(_HITS).to_pylist()
            total = np.concatenate(([0], np.cumsum(_covered(words, hits))))
            n_hit, n_words = np.diff(total[words.first]), np.diff(words.first)
            items = [sorted({i for hit in found for i in hit["items"]}, key=_null_last) for found in hits]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": n_words, "n_hit": n_hit,
                "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": [hashlib.sha256(",".join(i for i in x if i is not None).encode()).hexdigest() for x in items],
                "contaminated": (n_hit > 0) & (HIT_SHARE * n_hit >= n_words),
            })

    return over_arrow(find_hits(narrow, benchmark, "__text", **options), work, DIGEST)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", action: str = "drop", **options) -> DataFrame:
    """``docs`` without contaminated documents (``drop``) or with the words hit cut out (``cut``).

    All columns stay as they are. ``cut`` removes every maximal run of hit words together
    with what stands between them; texts without hits, null texts included, are unchanged.
    """
    if action not in ("drop", "cut"):
        raise ValueError(f"unknown action {action}")

    def work(batches):
        for batch in slices(batches, text):
            hits = batch.column(_HITS).to_pylist()
            plain = batch.select([n for n in batch.schema.names if n != _HITS])
            if not any(hits):
                yield plain
                continue
            words = Words(batch.column(text), alphanumeric(), hashed=False)
            hit = _covered(words, hits)
            if action == "drop":
                n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[words.first])
                bad = (n_hit > 0) & (HIT_SHARE * n_hit >= np.diff(words.first))
                yield plain.filter(pa.array(~bad))
                continue
            texts = batch.column(text).to_pylist()
            for i in (i for i, x in enumerate(hits) if x):
                raw, at, kept = texts[i].encode(), 0, []
                own = np.flatnonzero(hit[words.first[i] : words.first[i + 1]]) + words.first[i]
                for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                    a, b = words.start[run[0]] - words.offsets[i], words.end[run[-1]] - words.offsets[i]
                    kept.append(raw[at:a])
                    at = b
                texts[i] = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
            where = plain.schema.get_field_index(text)
            yield plain.set_column(where, plain.schema.field(where), pa.array(texts, plain.schema.field(where).type))

    found = find_hits(docs, benchmark, text, **options)
    return over_arrow(found, work, T.StructType([f for f in found.schema.fields if f.name != _HITS]))
