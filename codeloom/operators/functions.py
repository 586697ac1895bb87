"""Function extraction and the per-file module profile.

Everything here is local to one row: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import constants as K
from codeloom.functions import arrays, paths, text
from codeloom.operators.ranking import priority_limit
from codeloom.operators.skew import keep_listed


def _pattern(language: Column) -> Column:
    out = None
    for name, pattern in K.FUNCTION_PATTERNS.items():
        hit = language == name
        out = F.when(hit, F.lit(pattern)) if out is None else out.when(hit, F.lit(pattern))
    return out


_PAGE = 1024


def _body_at(content: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """Hand ``use`` a function from a start offset to the body window there.

    In a text of ASCII characters a window is a slice of its bytes. Of others pages, each with
    the text a window may need past its end, are cut in one pass, so a window does not
    count characters from the start of a long file.
    """
    sliced = arrays.bind(
        content.cast("binary"),
        lambda raw: use(lambda start: F.substring(raw, start + 1, F.lit(K.BODY_WINDOW)).cast("string")),
    )
    reach = _PAGE + K.BODY_WINDOW
    pattern = F.lit(f"(?s)(?=(.{{1,{reach}}})).{{1,{_PAGE}}}")
    paged = arrays.bind(
        F.regexp_extract_all(content, pattern, F.lit(1)),
        lambda pages: use(
            lambda start: F.substring(
                F.get(pages, (start / _PAGE).cast("int")),
                start % _PAGE + 1,
                F.lit(K.BODY_WINDOW),
            )
        ),
    )
    return F.when(F.octet_length(content) == F.length(content), sliced).otherwise(paged)


_COUNTS = ("chars", "lines", "branches")
_CUT = "\x01"


def _pieces(content: Column, pattern: Column) -> Column:
    """Head, then match, name and gap of every function, cut in one pass of the pattern.

    The cuts are marks the text does not hold: one that holds the mark is cut by its own hash.
    """
    sealed = F.concat(F.lit(_CUT), F.sha2(content.cast("binary"), 256), F.lit(_CUT))
    mark = F.when(F.contains(content, F.lit(_CUT)), sealed).otherwise(F.lit(_CUT))
    return arrays.bind(
        mark,
        lambda cut: F.split(
            F.regexp_replace(content, pattern, F.concat(cut, F.lit("$0"), cut, F.lit("$1"), cut)), cut, -1
        ),
    )


def _parts(pieces: Column, present: Column) -> Column:
    """Array of (match, name, part, chars, lines, branches).

    The text is g0 m0 g1 m1 .. gn; part i is the match mi and the gap after it.
    """
    parts = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 3, F.lit(3)),
        lambda at: F.struct(
            F.get(pieces, at).alias("match"),
            F.get(pieces, at + 1).alias("name"),
            F.concat(F.get(pieces, at), F.get(pieces, at + 2)).alias("part"),
        ),
    )
    return F.transform(
        parts,
        lambda p: F.struct(
            p["match"].alias("match"),
            p["name"].alias("name"),
            p["part"].alias("part"),
            F.length(p["part"]).alias("chars"),
            text.newline_count(p["part"]).alias("lines"),
            text.hits_of(p["part"], present).alias("branches"),
        ),
    )


def _last_inside(starts: Column) -> Column:
    """For each of the ascending ``starts`` the index of the last one inside its window.

    Starts and ends of windows are sorted together: as many starts as stand before an end,
    less the ends before it, lie below it. Both ascend, so the k-th end is that of start k.
    """
    odd_starts = F.transform(starts, lambda s: s.cast("long") * 2 + 1)
    even_ends = F.transform(starts, lambda s: (s.cast("long") + K.BODY_WINDOW) * 2)
    places = F.transform(
        F.sort_array(F.concat(odd_starts, even_ends)), lambda x, place: F.when(x % 2 == 0, place)
    )
    return F.transform(F.array_compact(places), lambda place, k: place - k - 1)


def _signature(match: Column) -> Column:
    """``text.shorten_signature`` of a match, which holds a brace at its end or none at either."""
    return F.btrim(match, F.lit(K.WHITESPACE + "{"))


def _measured(parts: Column, head: Column, present: Column) -> Column:
    """All functions of a text from its parts and the ``chars`` and ``lines`` of its head.

    A match starts a line and no branch token spans a line end, so counts add up over
    parts: a window is the sum of the parts it covers and the head of its last one, and
    the text is not scanned again for every window that overlaps it.
    """

    def counted(part: Column, reach: Column) -> Column:
        """Lines and branches in the first ``reach`` characters of a part."""
        whole = F.struct(part["lines"].alias("lines"), part["branches"].alias("branches"))
        tail = arrays.bind(
            F.substring(part["part"], F.lit(1), reach),
            lambda t: F.struct(
                text.newline_count(t).alias("lines"), text.hits_of(t, present).alias("branches")
            ),
        )
        return F.when(reach >= part["chars"], whole).otherwise(tail)

    def described(before: Column) -> Column:
        def function(last: Column, i: Column) -> Column:
            part, own, end = F.get(parts, i), F.get(before, i), F.get(before, last)
            return arrays.bind(
                counted(F.get(parts, last), own["chars"] - end["chars"] + K.BODY_WINDOW),
                lambda tail: F.struct(
                    i.alias("fn_index"),
                    part["name"].alias("name"),
                    _signature(part["match"]).alias("signature"),
                    (own["chars"] + head["chars"]).alias("start_idx"),
                    (own["lines"] + head["lines"] + 1).alias("start_line"),
                    (end["lines"] - own["lines"] + tail["lines"] + 1).alias("loc"),
                    (end["branches"] - own["branches"] + tail["branches"] + 1).alias("cyclomatic"),
                ),
            )

        return F.transform(_last_inside(F.transform(before, lambda b: b["chars"])), function)

    return arrays.bind(arrays.running_totals(parts, _COUNTS), described)


def function_pieces(content: Column, language: Column) -> Column:
    """A text cut at its functions; null where the language has none."""
    pattern = _pattern(language)
    return F.when(pattern.isNotNull(), _pieces(content, pattern))


def functions_in(pieces: Column) -> Column:
    """How many functions the pieces hold."""
    return F.when(pieces.isNull(), 0).otherwise(((F.size(pieces) - 1) / 3).cast("int"))


def described_pieces(pieces: Column, content: Column) -> Column:
    """``function_array`` of a text that is cut already."""
    first = F.get(pieces, F.lit(0))
    head = F.struct(F.length(first).alias("chars"), text.newline_count(first).alias("lines"))
    found = arrays.bind(
        text.tokens_in(content),
        lambda present: arrays.bind(
            _parts(pieces, present),
            lambda parts: arrays.bind(head, lambda h: _measured(parts, h, present)),
        ),
    )
    return F.when(F.size(pieces) > 1, found)


def function_array(content: Column, language: Column) -> Column:
    """All functions of a text as an array of structs, in text order, without bodies."""
    return arrays.bind(
        function_pieces(content, language), lambda pieces: described_pieces(pieces, content)
    )


def with_bodies(functions: Column, content: Column) -> Column:
    """Add ``body_short``, the body window, to every function of an array."""
    added = _body_at(
        content,
        lambda body: F.transform(
            functions, lambda f: f.withField("body_short", body(f["start_idx"]))
        ),
    )
    return F.when(F.size(functions) > 0, added)


_BARE = (
    "fn_index:int,name:string,signature:string,start_idx:int,start_line:int,loc:int,"
    "cyclomatic:int"
)
FUNCTIONS_TYPE = f"array<struct<{_BARE}>>"
WITH_BODIES_TYPE = f"array<struct<{_BARE},body_short:string>>"


def _typed(docs: DataFrame) -> DataFrame:
    return nonblank(docs).withColumn("language", paths.language(F.col("path")))


def _found() -> Column:
    return function_array(F.col("content"), F.col("language"))


def nonblank(docs: DataFrame) -> DataFrame:
    return docs.where(~text.is_blank(F.col("content")))


def find_functions(docs: DataFrame) -> DataFrame:
    """One row per function of every file; other languages yield none."""
    # Exploding the expression, not a column that holds it, keeps Spark from adding a
    # size filter on the column, which would extract the functions a second time.
    found = arrays.bind(_found(), lambda f: with_bodies(f, F.col("content")))
    return _typed(docs).select("repo", "path", "language", F.inline(found))


def top_functions(functions: Column, limit: int = K.TOP_FUNCTIONS) -> Column:
    """Most complex functions first, longer ones first among equals, then text order."""
    keyed = F.transform(
        functions,
        lambda f: F.struct((-f["cyclomatic"]).alias("a"), (-f["loc"]).alias("b"), f.alias("f")),
    )
    ordered = F.sort_array(keyed)  # fn_index leads f, so ties keep text order
    return F.transform(F.slice(ordered, F.lit(1), F.lit(limit)), lambda k: k["f"])


def profile_modules(docs: DataFrame) -> DataFrame:
    """Static analysis: one row per non-blank file with its top functions."""
    none = F.array().cast(FUNCTIONS_TYPE)
    # counted from the pieces, so that a reader of counts alone measures no function
    cut = _typed(docs).withColumn("pieces", function_pieces(F.col("content"), F.col("language")))
    found = described_pieces(F.col("pieces"), F.col("content"))
    analysed = cut.withColumn("functions", F.coalesce(found, none))
    top = with_bodies(top_functions(F.col("functions")), F.col("content"))
    return analysed.select(
        "repo",
        paths.file_name(F.col("path")).alias("module_name"),
        "path",
        "language",
        text.line_count(F.col("content")).alias("total_lines"),
        functions_in(F.col("pieces")).alias("num_functions"),
        F.coalesce(top, F.array().cast(WITH_BODIES_TYPE)).alias("top_functions"),
        F.lit(K.MODULE_CONFIDENCE).alias("confidence"),
    )


def profile_first(docs: DataFrame, n: int) -> DataFrame:
    """``profile_modules`` of the first ``n`` files of each repository by role and path.

    Files are ranked by their paths alone, and only those that stay are analysed.
    """
    key = ["repo", "path"]
    return profile_modules(keep_listed(docs, priority_limit(nonblank(docs).select(*key), n), key))


def explode_top_functions(modules: DataFrame) -> DataFrame:
    """One row per top function with its rank in the module."""
    # a mapped array, since a filter on the size of the plain one would be pushed below the extraction
    listed = F.transform("top_functions", lambda f: f)
    return modules.select(
        "repo", "path", "language", F.posexplode(listed).alias("pos", "f")
    ).select("repo", "path", "language", (F.col("pos") + 1).alias("rank"), "f.*")
