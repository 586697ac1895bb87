"""Scalar text expressions: strip, lines, hashes, tokens, summaries, complexity."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import constants as K
from codeloom.functions.arrays import bind


def strip(text: Column) -> Column:
    """Remove white space, in the Unicode sense, from both ends."""
    return F.btrim(text, F.lit(K.WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def count_of(text: Column, token: str) -> Column:
    """Occurrences of an ASCII token that do not overlap."""
    shrunk = F.octet_length(F.replace(text, F.lit(token), F.lit("")))
    return ((F.octet_length(text) - shrunk) / len(token)).cast("int")


def newline_count(text: Column) -> Column:
    return count_of(text, "\n")


def line_count(text: Column) -> Column:
    return newline_count(text) + 1


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line that holds the 0-based character ``offset``."""
    return line_count(F.substring(text, F.lit(1), offset))


def branch_hits(text: Column, tokens: Sequence[str] = K.BRANCH_TOKENS) -> Column:
    """Branch tokens in a text, without regard to case.

    Each token counts by the bytes that vanish with it; tokens of one length share the
    arithmetic, which matters because this runs for every line and part of a corpus.
    """
    by_length: dict[int, list[str]] = {}
    for token in tokens:
        by_length.setdefault(len(token), []).append(token)

    def counted(lowered: Column) -> Column:
        hits = F.lit(0)
        for length, group in by_length.items():
            left = F.octet_length(lowered) * len(group)
            for token in group:
                left = left - F.octet_length(F.replace(lowered, F.lit(token), F.lit("")))
            hits = hits + (left / length).cast("int")
        return hits

    return bind(F.lower(text), counted)


def tokens_in(text: Column, tokens: Sequence[str] = K.BRANCH_TOKENS) -> Column:
    """The branch tokens that a text holds, in any case, as ``(token, size)``."""
    listed = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(len(t)).alias("size")) for t in tokens])
    return bind(F.lower(text), lambda lowered: F.filter(listed, lambda x: F.contains(lowered, x["token"])))


def hits_of(text: Column, present: Column) -> Column:
    """``branch_hits`` of a piece of a text, searched only for the ``tokens_in`` the whole text."""

    def counted(lowered: Column) -> Column:
        def add(n: Column, x: Column) -> Column:
            left = F.octet_length(F.replace(lowered, x["token"], F.lit("")))
            return n + ((F.octet_length(lowered) - left) / x["size"]).cast("int")

        return F.aggregate(present, F.lit(0), add)

    return bind(F.lower(text), counted)


_MARK = "\x01"


def _runs_into(a: str, b: str) -> bool:
    """Whether an occurrence of ``b`` may begin inside one of ``a``."""
    return b in a or any(b.startswith(a[k:]) for k in range(1, len(a)))


def branch_patterns(tokens: Sequence[str] = K.BRANCH_TOKENS) -> list[str]:
    """Patterns whose matches, taken together, are as many as the tokens' occurrences.

    Tokens that cannot overlap share a pattern. Words between blanks may share a blank
    with their neighbour, but not with their own repetition, which counts every other time.
    """
    words = [t[1:-1] for t in tokens if len(t) > 2 and t[0] == t[-1] == " " and " " not in t[1:-1]]
    groups: list[list[str]] = []
    for token in tokens:
        if token[1:-1] in words and token[0] == " ":
            continue
        for group in groups:
            if not any(_runs_into(token, g) or _runs_into(g, token) for g in group):
                group.append(token)
                break
        else:
            groups.append([token])
    found = ["(?:" + "|".join(re.escape(t) for t in group) + ")" for group in groups]
    if words:
        found.append(" (?:" + "|".join(f"{re.escape(w)}(?: {re.escape(w)})?" for w in words) + ")(?= )")
    return found


def branch_marks(lines: Column, tokens: Sequence[str] = K.BRANCH_TOKENS) -> Column:
    """The branch tokens of a file as short texts: its line ends with a mark for each token."""
    joined = F.replace(F.lower(F.array_join(lines, "\n")), F.lit(_MARK), F.lit("_"))
    marked = [F.regexp_replace(joined, p, _MARK) for p in branch_patterns(tokens)]
    return F.array(*[F.regexp_replace(m, f"[^\\n{_MARK}]+", "") for m in marked])


def branches_until(marks: Column, line: Column) -> Column:
    """Branch tokens of the first ``line`` lines. No token spans a line end."""
    def counted(mark: Column) -> Column:
        return F.length(F.call_function("substring_index", mark, F.lit("\n"), line)) - line + 1

    total = F.aggregate(marks, F.lit(0), lambda n, m: n + counted(m))
    return F.when(line <= 0, 0).otherwise(total)


def cyclomatic(text: Column, tokens: Sequence[str] = K.BRANCH_TOKENS) -> Column:
    """Complexity estimate: 1 and one for each branch token."""
    return branch_hits(text, tokens) + 1


def normalise_newlines(text: Column) -> Column:
    folded = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.replace(folded, F.lit("\r"), F.lit("\n"))


def decode_source(content: Column) -> tuple[Column, Column]:
    """Text and codec of raw bytes: strict UTF-8, else latin-1."""
    as_text = content.cast("string")
    valid = F.is_valid_utf8(as_text)
    text = F.when(valid, as_text).otherwise(F.decode(content, "ISO-8859-1"))
    codec = F.when(content.isNull(), None).when(valid, F.lit("utf-8"))
    return normalise_newlines(text), codec.otherwise(F.lit("latin-1"))


def decode_lossy(content: Column) -> Column:
    """Text of raw bytes with every bad sequence replaced by U+FFFD."""
    return normalise_newlines(F.make_valid_utf8(content.cast("string")))


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line end opens no further line."""

    def trimmed(parts: Column) -> Column:
        keep = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
        return F.slice(parts, F.lit(1), keep)

    return bind(F.split(text, K.LINE_ENDS, -1), trimmed)


def first_line(text: Column) -> Column:
    return F.get(F.split(text, K.LINE_ENDS, 2), F.lit(0))


def slice_lines(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, 1-based and inclusive, clamped to the file."""
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(lines))
    wanted = F.greatest(last - first + 1, F.lit(0))
    return F.array_join(F.slice(lines, first, wanted), "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def method_hash(signature: Column, body: Column) -> Column:
    return content_hash(F.concat(signature, F.lit("\n"), F.coalesce(body, F.lit(""))))


def token_estimate(text: Column) -> Column:
    chars = F.coalesce(F.length(text), F.lit(0))
    return F.ceil(chars / K.CHARS_PER_TOKEN).cast("int")


def shorten_signature(raw: Column) -> Column:
    return F.regexp_replace(strip(raw), K.OPENING_BRACE, "")


def heuristic_summary(body: Column) -> Column:
    """Description made from the first line of a body, without a model."""
    line = strip(first_line(strip(F.coalesce(body, F.lit("")))))
    summary = F.concat(F.lit(K.HEURISTIC_PREFIX), F.substring(line, 1, K.HEURISTIC_CHARS))
    return F.when(line == "", F.lit(K.HEURISTIC_EMPTY)).otherwise(summary)


def prompt_body(body: Column) -> Column:
    """Start of a body with code fences escaped, for use inside a prompt."""
    start = F.substring(F.coalesce(body, F.lit("")), 1, K.PROMPT_BODY_CHARS)
    return F.replace(start, F.lit("```"), F.lit("'```'"))


def summary_or_default(summary: Column, description: Column | None = None) -> Column:
    """First non-empty of two reply fields on one line, else a fixed text."""
    second = F.lit("") if description is None else F.coalesce(description, F.lit(""))
    chosen = F.coalesce(F.nullif(summary, F.lit("")), second)
    cleaned = F.replace(strip(chosen), F.lit("\n"), F.lit(" "))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(K.SUMMARY_MISSING))


def between_outer(text: Column, opening: str, closing: str) -> Column:
    """From the first ``opening`` to the last ``closing``, null without both."""
    start = F.instr(text, opening)
    end = F.length(text) - F.instr(F.reverse(text), closing) + 2
    found = (start > 0) & F.contains(text, F.lit(closing)) & (end > start)
    return F.when(found, F.substring(text, start, end - start))
