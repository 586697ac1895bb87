"""Text to chunks: boundary-aware up to a token budget, or fixed windows.

Both are local to one row and expressed with built-in array functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import constants as K
from codeloom.functions import arrays, text


def _boundary_parts(content: Column) -> Column:
    """Cut before every boundary match; strip the parts and drop empty ones."""

    def cut(gaps: Column) -> Column:
        matches = F.regexp_extract_all(content, F.lit(K.CHUNK_BOUNDARY), F.lit(0))
        tails = F.zip_with(
            matches, F.slice(gaps, F.lit(2), F.size(gaps)), lambda m, g: F.concat(m, g)
        )
        return F.concat(F.slice(gaps, 1, 1), tails)

    parts = arrays.bind(F.split(content, K.CHUNK_BOUNDARY, -1), cut)
    return F.filter(F.transform(parts, text.strip), lambda p: p != "")


def token_chunks(content: Column, token_target: int = K.TOKEN_TARGET) -> Column:
    """Array of chunks of at most ``token_target`` estimated tokens.

    A text within the budget stays whole and unstripped. A longer one is cut at
    declarations and blank lines; a part still over the budget is cut by length.
    """

    def hard_split(part: Column) -> Column:
        size = F.floor(F.length(part) * token_target / text.token_estimate(part))
        return arrays.pages(part, F.greatest(size, F.lit(K.MIN_HARD_SPLIT)))

    def fitted(part: Column) -> Column:
        fits = text.token_estimate(part) <= token_target
        return F.when(fits, F.array(part)).otherwise(hard_split(part))

    def or_pages(chunks: Column) -> Column:
        blank = max(K.MIN_HARD_SPLIT, token_target * K.CHARS_PER_TOKEN)
        return F.when(F.size(chunks) > 0, chunks).otherwise(arrays.pages(content, blank))

    cut = arrays.bind(F.flatten(F.transform(_boundary_parts(content), fitted)), or_pages)
    return (
        F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>"))
        .when(text.token_estimate(content) <= token_target, F.array(content))
        .otherwise(cut)
    )


def fixed_chunks(
    content: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP
) -> Column:
    """Array of windows of ``size`` characters that overlap by ``overlap``.

    An overlap as large as the window is ignored. Windows are joined from pieces of
    one step, so a long text is read once and not from its start for every window.
    """
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap must not be negative")
    step = size - overlap if overlap < size else size
    per_window = -(-size // step)

    def windows(stripped: Column) -> Column:
        last = F.ceil((F.length(stripped) - size) / step).cast("int")
        return F.when(
            F.length(stripped) > size,
            arrays.bind(
                arrays.pages(stripped, step),
                lambda pieces: F.transform(
                    F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                    lambda i: F.substring(
                        F.array_join(F.slice(pieces, i + 1, F.lit(per_window)), ""), 1, size
                    ),
                ),
            ),
        ).otherwise(F.array(stripped))

    empty = F.coalesce(content, F.lit("")) == ""
    return F.when(empty, F.array().cast("array<string>")).otherwise(
        arrays.bind(text.strip(content), windows)
    )


def explode_chunks(docs: DataFrame, chunks: Column) -> DataFrame:
    """One row per chunk with its index in the file and its content hash."""
    cut = docs.select("repo", "path", F.posexplode(chunks).alias("chunk_index", "text"))
    return cut.withColumn("chunk_sha", text.content_hash(F.col("text")))


def chunk_files(docs: DataFrame, token_target: int = K.TOKEN_TARGET) -> DataFrame:
    """Boundary-aware chunks of every file, with fixed windows where those give none."""

    def or_fixed(chunks: Column) -> Column:
        return F.when(F.size(chunks) > 0, chunks).otherwise(fixed_chunks(F.col("content")))

    chunks = arrays.bind(token_chunks(F.col("content"), token_target), or_fixed)
    return explode_chunks(docs, chunks)


def chunk_files_fixed(
    docs: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP
) -> DataFrame:
    return explode_chunks(docs, fixed_chunks(F.col("content"), size, overlap))
