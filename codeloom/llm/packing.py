"""Best-fit packing of documents into sequences of limited tokens, documents and attention cost.

Tasks encode texts and cut them into pieces. Only the number of pieces of each length goes
to the driver: at most as many numbers as a sequence has tokens. The plan made of them
says which ranks of a length go where; pieces find their rank from their place among the
pieces of their length in their task and the counts of the tasks before. So the packing is
that of one best-fit over all documents, and no group of pieces meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.best_fit import Capacity, Step, plan
from codeloom.llm.common import over_arrow, slices, small, staged, table
from codeloom.llm.words_tokenizer import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Tokens decide; documents and attention, where they do not bind, only between equal residuals.
WEIGHTS = (1.0, 1e-6, 1e-6)
_PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"
# Fixed value: how the vocabulary's byte-level splitting cuts texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones are
    themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a ``tokenizers`` file, in the encoder that is about five
    times as fast on one core; ids are the same, special tokens in texts included."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items()}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in piece): k for piece, k in tokenizer.get_vocab(with_added_tokens=False).items() if piece not in special}
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


_held: dict[str, tiktoken.Encoding] = {}


def _worker_encoder(path: str) -> tiktoken.Encoding:
    """One encoder per worker process and path."""
    if path not in _held:
        _held[path] = byte_encoder(path)
    return _held[path]


def _cuts(size: int, longest: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``size`` tokens: whole ones but for the first."""
    starts = [0, *range(size % longest or longest, size, longest)]
    return list(zip(starts, [*starts[1:], size], strict=True))


def cut_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, longest: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth): the pieces of all documents, written.

    ``ids`` are little-endian 32-bit numbers; ``nth`` counts the pieces of this length that the task
    ``part`` cut before. Null texts are empty: their end id alone.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def work(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        encoder = _worker_encoder(path)
        for batch in slices(batches, "text"):
            rows, held = [], []
            for place, content in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encoder.encode(content or "", allowed_special="all"), end_id], "<u4")
                for nth, (a, b) in enumerate(_cuts(len(ids), longest)):
                    rows.append((place, nth, a, b - a))
                    held.append(ids[a:b].tobytes())
            place, piece, start, length = np.array(rows, np.int64).reshape(-1, 4).T
            order = np.argsort(length, kind="stable")
            begins = np.searchsorted(length[order], length[order])  # of each length
            before = np.zeros(len(length), np.int64)
            before[order] = np.arange(len(order)) - begins
            before += seen[length]
            seen += np.bincount(length, minlength=longest + 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(place)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)),
                pa.array(held, pa.binary()), pa.array(np.full(len(length), part, np.int32)), pa.array(before),
            ], names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return staged(over_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), work, _PIECES), "pieces")


def _placed(pieces: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """``sequence_id`` and ``offset`` of every piece, by its rank among the pieces of its length."""
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = staged(counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")), "ranks")
    ranked = pieces.join(small(offsets, 500_000), ["length", "part"]).withColumn("at", F.col("ahead") + F.col("nth"))
    rows = [(s.length, s.rank, s.rank + s.items, s.bin, s.each, s.offset) for s in steps]
    moves = pieces.sparkSession.createDataFrame(rows, "length int, low long, high long, bin long, each long, from_token long")
    found = ranked.join(small(moves, 500_000), (ranked["length"] == moves["length"]) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).drop(moves["length"])
    turn = F.col("at") - F.col("low")
    return found.withColumns({
        "sequence_id": (F.col("bin") + F.floor(turn / F.col("each"))).cast("long"),
        "offset": F.col("from_token") + F.pmod(turn, F.col("each")) * F.col("length"),
    })


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    A document is its ids and ``end_id``; null and empty texts are the end id alone. Documents
    that fit no empty sequence are cut into the longest pieces that do, the first being the rest.
    Every sequence is filled from token 0 without gaps and keeps all three capacities.
    Repeated rows and rows with null or equal keys are packed each for itself. Other columns
    are not read; an empty table gives no rows.
    """
    pieces = cut_pieces(docs, key, text, vocabulary, end_id, capacity.longest)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity.longest rows
    steps, _ = plan(counts, capacity, weights, rule)
    found = _placed(pieces, steps)
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, lengths): each sequence's ids and the lengths of its pieces in order.

    A group holds at most a sequence's tokens.
    """
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("held"))
    ids = F.aggregate("held", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return grouped.select("sequence_id", "n_tokens", ids.alias("ids"), F.col("held.length").alias("lengths"))


def op12_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
