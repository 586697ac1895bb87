"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. The characters of every token are then joined with the
sections' intervals, both in ascending order, by binary search over all documents of a
slice at once. A token that crosses a boundary is allocated by rule. No row is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import over_arrow, slices, table
from codeloom.llm.words_tokenizer import BATCH_BYTES, vocabulary_path, worker_tokenizer

RULES = ("start", "end", "majority")
EDGE = 200  # characters of a document's head and tail
SECTIONS = "array<struct<name:string,start:int,end:int>>"
_ROWS = "doc_id long, section string, start long, end long, n_tokens long, n_crossing long"


def allocate(spans: np.ndarray, owner: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section.

    Sections of text i are ``first[i]`` to ``first[i + 1]``; they ascend and do not overlap. ``start`` and ``end`` give a
    token to the section of its first or last character, ``majority`` to the one with most of
    its characters, the earlier if equal. Tokens outside all sections are not counted.
    A token crosses if it also has characters outside its section.
    """
    tokens, crossing = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    if not len(spans) or not len(starts):
        return tokens, crossing
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stride = int(max(spans.max(), ends.max(initial=0))) + 2
    begins = text_of * stride + starts
    low, high = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)

    def holder(char: np.ndarray) -> np.ndarray:
        """The section of a character, or -1."""
        at = np.searchsorted(begins, owner * stride + char, "right") - 1
        fits = (at >= first[owner]) & (char < ends[np.maximum(at, 0)])
        return np.where(fits, at, -1)

    a, b = holder(low), holder(high - 1)
    if rule == "majority":
        best, most = a.copy(), np.where(a >= 0, np.minimum(high, ends[np.maximum(a, 0)]) - low, 0)
        width = int((high - low).max())
        for step in range(1, width):  # a token has few characters, so it meets few sections
            c = holder(np.minimum(low + step, high - 1))
            part = np.where(c >= 0, np.minimum(high, ends[np.maximum(c, 0)]) - np.maximum(low, starts[np.maximum(c, 0)]), 0)
            best, most = np.where(part > most, c, best), np.maximum(part, most)
        chosen = best
    else:
        chosen = a if rule == "start" else b
    inside = chosen >= 0
    tokens += np.bincount(chosen[inside], minlength=len(starts))
    crosses = inside & ((a != chosen) | (b != chosen))
    crossing += np.bincount(chosen[crosses], minlength=len(starts))
    return tokens, crossing


def section_tokens(docs: DataFrame, sections: Column, key: str = "doc_id", text: str = "text", rule: str = "start", vocabulary: str | None = None) -> DataFrame:
    """One row per document and section: ``doc_id, section, start, end, n_tokens, n_crossing``.

    ``sections`` gives (name, start, end) in characters, ascending and not overlapping. If they cover a
    text, their tokens add up to the document's. Null and empty texts have no tokens; null
    sections give no rows. Repeated rows give repeated rows; other columns are not returned.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.coalesce(sections, F.array()).cast(SECTIONS).alias("s"))

    def work(batches):
        tokenizer = worker_tokenizer(path, spans=True)
        for batch in slices(batches, "t", BATCH_BYTES):
            spans, sizes = tokenizer.encode_spans(batch.column("t"))
            lists = batch.column("s")
            first = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            flat = lists.flatten()
            starts, ends = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            tokens, crossing = allocate(spans, owner, first, starts, ends, rule)
            keys = batch.column("k").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first))))
            yield pa.RecordBatch.from_arrays([keys, flat.field("name"), pa.array(starts), pa.array(ends), pa.array(tokens), pa.array(crossing)], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return over_arrow(rows, work, _ROWS)


def head_body_tail(text: Column, edge: int = EDGE) -> Column:
    """Three sections that cover a text: its first and last ``edge`` characters and the rest."""
    n = F.length(text)
    a, b = F.least(n, F.lit(edge)), F.greatest(F.least(n, F.lit(edge)), n - edge)
    part = lambda name, x, y: F.struct(F.lit(name).alias("name"), x.cast("int").alias("start"), y.cast("int").alias("end"))
    return F.when(text.isNotNull(), F.array(part("head", F.lit(0), a), part("body", a, b), part("tail", b, n)))


def op3_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return section_tokens(docs, head_body_tail(F.col("text")))
