"""Token ids of whole texts, each distinct word encoded once per worker.

The tokenizer drops white space and never merges across it, so a text's ids are its
words' ids in turn. Texts that hold a special token's opening are encoded as they are.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from codeloom.llm.common import Words, buffers, not_space, ranges

VOCABULARY = "word_bpe_49k.json"
MEMO_WORDS = 500_000
BATCH_BYTES = 1 << 20
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]{1,60})([.,;:!?]*)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordTokenizer:
    """Keeps the ids of words seen, by the 64-bit hash of the word with A-Z lowered (as the
    tokenizer lowers it); forgets them all when they exceed ``MEMO_WORDS``."""

    def __init__(self, path: str, spans: bool = False) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.spans = spans  # whether to keep the characters each id stands for
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for piece, k in vocabulary.items() if piece.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.chars = np.zeros((0, 2), np.int64)  # of each id, within its word

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.hashes) + len(words) > MEMO_WORDS:
            self._forget()
        ids, sizes, chars = self._encode_words(words)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.chars = np.concatenate([self.chars, chars])
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.hashes, hashes)  # the new ones ascend, so both are merged in order
        self.slots = np.insert(self.slots, at, len(self.starts) + np.arange(len(words)))
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])

    def _batch(self, texts: list[str]):
        return (self.tokenizer.encode_batch if self.spans else self.tokenizer.encode_batch_fast)(texts, add_special_tokens=False)

    def _chars(self, encoding) -> np.ndarray:
        return np.array(encoding.offsets, np.int64).reshape(-1, 2) if self.spans else np.zeros((0, 2), np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in turn, how many each has, and their characters if spans are kept.

        Words of plain letters, with or without marks behind, are encoded many at once: each
        is one or two pieces of the tokenizer's splitting, and each piece ends in one id that
        ends a word. Others are encoded one by one.
        """
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        chars: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(words)
        matched = [_PLAIN.fullmatch(w) for w in words]
        at = [k for k, m in enumerate(matched) if m]
        for k in range(0, len(at), 4096):
            some = [matched[i] for i in at[k : k + 4096]]
            encoding = self._batch([" ".join(m.string for m in some)])[0]
            ids = np.array(encoding.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            cuts = ends[np.cumsum([1 + bool(m[2]) for m in some]) - 1][:-1]
            for place, found in zip(at[k : k + 4096], np.split(ids, cuts), strict=True):
                parts[place] = found
            if self.spans:
                begins = np.cumsum([0, *(len(m.string) + 1 for m in some[:-1])])
                for place, begin, found in zip(at[k : k + 4096], begins.tolist(), np.split(self._chars(encoding), cuts), strict=True):
                    chars[place] = found - begin
        rest = [k for k, m in enumerate(matched) if not m]
        for place, encoding in zip(rest, self._batch([words[k] for k in rest]) if rest else [], strict=True):
            parts[place], chars[place] = np.array(encoding.ids, np.uint32), self._chars(encoding)
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64), np.concatenate(chars)

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        return (self.slots[at] if len(self.hashes) else at), known

    def word_slots(self, words: Words, raw: np.ndarray) -> np.ndarray:
        """The memo's slot of each word."""
        distinct, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        _, known = self._slots(distinct)
        if not known.all():
            if len(self.hashes) + int((~known).sum()) > MEMO_WORDS:
                self._forget()
                known[:] = False
            data = raw.tobytes()
            new = first[~known]
            self._learn(distinct[~known], [data[a:b].decode() for a, b in zip(words.start[new].tolist(), words.end[new].tolist(), strict=True)])
        return self._slots(distinct)[0][which]

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column in turn, and how many belong to each text; null is empty."""
        words = Words(column, not_space())
        raw, offsets = buffers(column)
        sizes = np.zeros(len(column), np.int64)
        ids = np.zeros(0, np.uint32)
        if len(words.start):
            slots = self.word_slots(words, raw)
            per_word = self.sizes[slots]
            ids = self.ids[ranges(self.starts[slots], per_word)]
            total = np.concatenate(([0], np.cumsum(per_word)))
            sizes = np.diff(total[words.first])
        opening = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)) if len(raw) else []
        if len(opening):
            ids, sizes = self._replace(column, np.unique(np.searchsorted(offsets, opening, "right") - 1), ids, sizes)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
        return ids, sizes

    def _replace(self, column: pa.Array, texts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i in texts.tolist():
            parts[i] = np.array(self.tokenizer.encode(column[i].as_py() or "", add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


    def encode_spans(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Character range (start, end) of every id of a text column, and ids per text."""
        words = Words(column, not_space())
        raw, offsets = buffers(column)
        before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters before each byte
        spans, sizes = np.zeros((0, 2), np.int64), np.zeros(len(column), np.int64)
        if len(words.start):
            slots = self.word_slots(words, raw)
            per_word = self.sizes[slots]
            begin = before[words.start] - before[offsets[:-1]][words.owner()]
            spans = self.chars[ranges(self.starts[slots], per_word)] + np.repeat(begin, per_word)[:, None]
            total = np.concatenate(([0], np.cumsum(per_word)))
            sizes = np.diff(total[words.first])
        opening = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)) if len(raw) else []
        if len(opening):
            parts = np.split(spans, np.cumsum(sizes)[:-1])
            for i in np.unique(np.searchsorted(offsets, opening, "right") - 1).tolist():
                parts[i] = self._chars(self.tokenizer.encode(column[i].as_py() or "", add_special_tokens=False))
            spans, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return spans, sizes


_held: dict[tuple[str, bool], WordTokenizer] = {}


def worker_tokenizer(path: str, spans: bool = False) -> WordTokenizer:
    """One tokenizer per worker process, path and kind."""
    if (path, spans) not in _held:
        _held[path, spans] = WordTokenizer(path, spans)
    return _held[path, spans]
