"""Line dedup: repeated runs of lines by prefix doubling over line ids.

Every line is a 64-bit id; a suffix is the lines from one line of a document to its end.
Prefix doubling names the first 1, 2, 4 ... lines of all suffixes: two names of half the
length give one of the whole length. Suffixes whose name occurs once are settled and
leave. Equal names of 2^k lines are the intervals of the suffix array where the longest
common prefix is at least 2^k; all but the first suffix of an interval begin a later copy.
Lengths between powers of two are named by the greatest power and the rest after it.
Doubling stops at ``least_lines``, and no whole suffix array is built: a longer run is
covered by its windows of ``least_lines`` lines. Runs that follow each other join to
maximal runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import staged, table
from codeloom.llm.mixing import word_count

LEAST_LINES = 4  # a power of two
LEAST_WORDS = 50


def line_suffixes(docs: DataFrame) -> DataFrame:
    """(key, row, n, name, words): one row per line of ``docs`` (key, row, text)."""
    lines = docs.where("text is not null").select("key", "row", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("key", "row", "n", F.xxhash64("line").alias("name"), word_count(F.col("line")).cast("int").alias("words"))


def later_copies(docs: DataFrame, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(row, n): lines that lie in a later copy of a run of ``least_lines`` lines, or of
    fewer lines with ``least_words`` words. Runs without words do not count, so lines of a
    longer run stay if all windows of ``least_lines`` lines around them have no words."""
    if least_lines < 1 or least_lines & (least_lines - 1):
        raise ValueError("least_lines must be a power of two")
    place = F.struct(F.col("key").isNull().alias("a"), F.col("key").alias("b"), F.col("row").alias("c"), F.col("n").alias("d"))
    names, size, copies, held = staged(line_suffixes(docs), "suffixes"), 1, [], {}
    while True:
        held[size] = _repeated(names, place)
        enough = (F.col("words") >= least_words) | ((F.col("words") > 0) & F.lit(size == least_lines))
        copies.append(_covered(held[size].where(enough), place, size))
        for rest in range(1, size if size < least_lines else 1):
            longer = _joined(held[size], held[rest], size)
            if 2 * size == least_lines:  # not part of a longer name
                longer = longer.where(F.col("words") >= least_words)
            held[size + rest] = _repeated(staged(longer, "suffixes"), place)
            copies.append(_covered(held[size + rest].where(F.col("words") >= least_words), place, size + rest))
        if size == least_lines:
            return reduce(DataFrame.unionByName, copies).distinct()
        names = staged(_joined(held[size], held[size], size), "suffixes")
        size *= 2


def _repeated(names: DataFrame, place: Column) -> DataFrame:
    """The suffixes whose name occurs more than once, with the ``first`` place of the name."""
    repeated = names.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("first")).where("rows > 1").drop("rows")
    return staged(names.join(staged(repeated, "intervals"), "name"), "live")


def _covered(live: DataFrame, place: Column, size: int) -> DataFrame:
    """(row, n): the lines of windows of ``size`` lines that are not the first of their name."""
    later = live.where(place != F.col("first"))
    return later.select("row", F.explode(F.sequence(F.col("n"), F.col("n") + size - 1)).alias("n"))


def _joined(live: DataFrame, then: DataFrame, size: int) -> DataFrame:
    """Suffixes named by ``live`` (``size`` lines) and by ``then`` for the lines after those."""
    ahead = then.select("row", (F.col("n") - size).alias("n"), F.col("name").alias("name2"), F.col("words").alias("words2")).distinct()
    both = live.select("key", "row", "n", "name", "words").join(ahead, ["row", "n"])
    return both.select("key", "row", "n", F.xxhash64("name", "name2").alias("name"), (F.col("words") + F.col("words2")).alias("words"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from ``text``, and ``n_lines``, ``n_deleted``.

    The copy in the document with the least key stays (null keys come last; equal keys by a
    hash of the text), in a document the first. Rows with equal key and text are one document: their lines
    go or stay alike. Null texts stay null with 0 lines, an empty text has one empty line. Other columns stay as they are; columns named as
    the two counts are replaced.
    """
    row = F.xxhash64(F.col(key), F.col(text))
    narrow = docs.select(F.col(key).alias("key"), row.alias("row"), F.col(text).alias("text"))
    gone = later_copies(narrow, least_lines, least_words).groupBy("row").agg(F.collect_set("n").alias("__gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    marked = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("__row", row)
    # always by shuffle: the table of lines gone grows with the input
    joined = marked.join(staged(gone, "gone").withColumnRenamed("row", "__row").hint("merge"), "__row", "left")
    lines = F.split(F.col(text), "\n")
    left = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_deleted = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    return joined.select(*[left.alias(c) if c == text else F.col(f"`{c}`") for c in names], n_lines.alias("n_lines"), n_deleted.alias("n_deleted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.md5("text").alias("text_md5"))
