"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities for the pieces of one fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, by the forward
algorithm; a text is scored by the words it holds. Piece probabilities are learned by
expectation maximisation over the words of a bounded sample of labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Words, not_space, over_arrow, ranges, slices, staged, table

VOCABULARY = "piece_bpe_32k.model"
TRAIN_DOCS = 3000  # labelled texts per language that are learned from, in expectation
ROUNDS = 3
LONGEST_PIECE = 16  # bytes; longer pieces of the vocabulary are left out
LONGEST_RUN = 32  # bytes of a word that are segmented together; a longer word is several runs
FLOOR = 1e-7  # of a single byte, so that every word has a segmentation
BATCH_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARK = 32  # stands before the first byte of a word


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load_pieces(path: str) -> list[bytes]:
    """The pieces as bytes, word starts marked, and all single bytes; each once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            raw = model.id_to_piece(k).replace("▁", " ").encode()
            if len(raw) <= LONGEST_PIECE and b" " not in raw[1:]:
                pieces.add(raw)
    return sorted(pieces)


def _hash(raw: bytes) -> int:
    h = 0
    for b in raw:
        h = (h * int(_BASE) + b + 1) & (2**64 - 1)
    return h


@dataclass
class Pieces:
    """The vocabulary as hashes; row k of a table of probabilities belongs to piece k."""

    pieces: list[bytes]

    @cached_property
    def _index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = np.array([_hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        seen = np.zeros(1 << 20, bool)
        seen[self._slot(hashes)] = True
        return hashes[order], order, seen

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are pieces, and which pieces."""
        ordered, order, seen = self._index
        at = np.flatnonzero(seen[self._slot(hashes)])
        found = np.searchsorted(ordered, hashes[at])
        right = ordered[np.minimum(found, len(ordered) - 1)] == hashes[at]
        return at[right], order[found[right]]

    def matches(self, runs: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of every place in runs of one length, ends ascending."""
        n, length = runs.shape
        before = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            before[i + 1] = before[i] * _BASE + runs[:, i] + np.uint64(1)
        powers = [np.uint64(1)]
        for _ in range(LONGEST_PIECE):
            powers.append(np.uint64(int(powers[-1]) * int(_BASE) & (2**64 - 1)))
        out = []
        for end in range(1, length + 1):
            for size in range(1, min(LONGEST_PIECE, end) + 1):
                rows, pieces = self.find(before[end] - before[end - size] * powers[size])
                if len(rows):
                    out.append((end - size, end, rows, pieces))
        return out


def forward(n: int, length: int, matches: list, probabilities: np.ndarray) -> np.ndarray:
    """Sum over all segmentations of the first i bytes, for each i, run and language."""
    alpha = np.zeros((length + 1, n, probabilities.shape[1]))
    alpha[0] = 1.0
    for start, end, rows, pieces in matches:
        alpha[end][rows] += alpha[start][rows] * probabilities[pieces]
    return alpha


def expected_counts(pieces: Pieces, runs: np.ndarray, counts: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in runs of one length that occur ``counts`` (run, language) times."""
    n, length = runs.shape
    matches = pieces.matches(runs)
    alpha = forward(n, length, matches, probabilities)
    beta = np.zeros_like(alpha)
    beta[length] = counts / np.maximum(alpha[length], 1e-300)
    total = np.zeros_like(probabilities)
    for start, end, rows, found in reversed(matches):
        part = beta[end][rows] * probabilities[found]
        beta[start][rows] += part
        np.add.at(total, found, alpha[start][rows] * part)
    return total


def cut_runs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marked words as runs of bounded length: joined bytes, run starts, run sizes, word of each run."""
    sizes = end - start + 1
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    marked = np.full(int(offsets[-1]), _MARK, np.uint8)
    inside = np.ones(len(marked), bool)
    inside[offsets[:-1]] = False
    marked[inside] = raw[ranges(start, end - start)]
    parts = -(-sizes // LONGEST_RUN)
    word = np.repeat(np.arange(len(sizes)), parts)
    place = ranges(np.zeros(len(parts), np.int64), parts)
    run_start = offsets[:-1][word] + place * LONGEST_RUN
    return marked, run_start, np.minimum(offsets[1:][word] - run_start, LONGEST_RUN), word


def by_length(marked: np.ndarray, start: np.ndarray, size: np.ndarray, limit: int = 20_000):
    """Runs of one length at a time, as (indices, matrix of bytes)."""
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        for k in range(0, len(at), limit):
            some = at[k : k + limit]
            yield some, marked[start[some][:, None] + np.arange(length)]


def word_scores(pieces: Pieces, probabilities: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    marked, run_start, size, word = cut_runs(raw, start, end)
    scores = np.zeros((len(start), probabilities.shape[1]))
    for at, runs in by_length(marked, run_start, size):
        alpha = forward(len(at), runs.shape[1], pieces.matches(runs), probabilities)
        np.add.at(scores, word[at], np.log(np.maximum(alpha[-1], 1e-300)))
    return scores


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    probabilities: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        """Posterior of each language for each text; without words all are equal."""
        words = Words(column, not_space())
        out = np.zeros((len(column), len(self.languages)))
        if len(words.start):
            _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
            which = which.astype(np.int32)
            scores = word_scores(self.pieces, self.probabilities, words.text, words.start[first], words.end[first])
            filled = np.flatnonzero(np.diff(words.first))
            for k in range(out.shape[1]):
                out[filled, k] = np.add.reduceat(scores[which, k], words.first[:-1][filled])
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def held_out(key: Column) -> Column:
    """Every third document by the crc32 of its id as text is not learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _word_counts(sample: DataFrame) -> DataFrame:
    def work(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            words = Words(batch.column("text"), not_space())
            langs, codes = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            owner = codes[words.owner()]
            for code, lang in enumerate(langs.tolist()):
                own = np.flatnonzero(owner == code)
                _, first, count = np.unique(words.hash[own], return_index=True, return_counts=True)
                raw = words.text.tobytes()
                found = [raw[words.start[i] : words.end[i]] for i in own[first].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary()), pa.array(count, pa.int64())], names=["lang", "word", "n"])

    counts = over_arrow(sample, work, "lang string, word binary, n long")
    return staged(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str | None = None, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model | None:
    """Learn from the labelled texts that are not held out; None if there are none.

    Per language about ``train_docs`` texts are used, those with the least hashes of their
    ids, all if there are fewer. The tables that reach the driver have one row per language
    and one per language and piece.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("k")) & F.col("k").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != "und"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    spot = F.xxhash64("k").cast("double") / float(2**64) + 0.5
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, train_docs / n))])
    words = _word_counts(rows.where(spot <= F.element_at(share, F.col("lang"))).where("text is not null").select("text", "lang"))
    pieces = Pieces(load_pieces(vocabulary or vocabulary_path()))
    codes = {name: k for k, name in enumerate(languages)}
    singles = np.array([len(p) == 1 for p in pieces.pieces])
    probabilities = np.full((len(pieces.pieces), len(languages)), 1.0 / len(pieces.pieces))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, probabilities))  # vocabulary x languages

        def work(batches, shared=shared):
            known, table_ = shared.value
            total = np.zeros_like(table_)
            for batch in batches:
                found = batch.column("word").to_pylist()
                raw, ends = np.frombuffer(b"".join(found), np.uint8), np.cumsum([len(w) for w in found])
                starts = ends - np.array([len(w) for w in found], np.int64)
                counts = np.zeros((len(found), table_.shape[1]))
                counts[np.arange(len(found)), [codes[x] for x in batch.column("lang").to_pylist()]] = batch.column("n").to_numpy()
                marked, start, size, word = cut_runs(raw, starts, ends)
                for at, runs in by_length(marked, start, size):
                    total += expected_counts(known, runs, counts[word[at]], table_)
            piece, code = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(code, pa.int32()), pa.array(total[piece, code])], names=["piece", "code", "n"])

        sums = over_arrow(words.repartition("lang", "word"), work, "piece int, code int, n double").groupBy("piece", "code").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(probabilities)
        counts[sums["piece"], sums["code"]] = sums["n"]
        probabilities = (counts + 1e-4) / (counts + 1e-4).sum(axis=0)
        probabilities[singles] = np.maximum(probabilities[singles], FLOOR)
    return Model(languages, pieces, probabilities)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (posterior of that language); ties go to the first name.

    Null texts and those without a letter are ``und`` with score 0, as is everything without a
    model. Columns of these names are replaced. Every text is scored whole.
    """
    names = [f.name for f in docs.schema.fields if f.name not in ("lang_pred", "score", "__letter")]
    plain = docs.select(*[F.col(f"`{n}`") for n in names])
    if model is None:
        return plain.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    marked = plain.withColumn("__letter", F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)))

    def work(batches):
        known = shared.value
        for batch in slices(batches, text, BATCH_BYTES):
            odds = known.score(batch.column(text))
            letter = batch.column("__letter").to_numpy(zero_copy_only=False)
            best = odds.argmax(axis=1)
            langs = np.where(letter, np.array(known.languages, object)[best], "und")
            score = np.where(letter, odds[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = plain.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return over_arrow(marked, work, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
