"""Row-local array helpers that stay linear in the length of a text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    A column used inside a lambda may be inlined by the optimizer and then be
    computed again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_totals(numbers: Column, fields: Sequence[str]) -> Column:
    """For each struct of counts, the field-wise sums over all structs before it.

    Totals are kept inside blocks of about the square root of the length and then shifted
    by block totals. Appending to an array copies it, so short blocks matter.
    """
    zeros = F.struct(*[F.lit(0).alias(f) for f in fields])

    def add(a: Column, b: Column) -> Column:
        return F.struct(*[(a[f] + b[f]).alias(f) for f in fields])

    def scan(xs: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(zeros.alias("sum"), F.slice(F.array(zeros), 1, 0).alias("out"))
        return F.aggregate(
            xs,
            start,
            lambda acc, x: F.struct(
                add(acc["sum"], value(x)).alias("sum"),
                F.concat(acc["out"], F.array(acc["sum"])).alias("out"),
            ),
        )

    def blocks_of(xs: Column, width: Column) -> Column:
        last = F.greatest((F.size(xs) - 1) / width, F.lit(0)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda b: scan(F.slice(xs, b * width + 1, width), lambda x: x),
        )

    def shifted(blocks: Column) -> Column:
        starts = scan(blocks, lambda b: b["sum"])["out"]
        return F.flatten(
            F.zip_with(blocks, starts, lambda b, s: F.transform(b["out"], lambda o: add(o, s)))
        )

    def blocked(xs: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
        return bind(bind(width, lambda w: blocks_of(xs, w)), shifted)

    return bind(numbers, blocked)


def count_below(ordered: Column, bound: Column) -> Column:
    """How many numbers of an ascending array lie below ``bound``.

    Appending the bound and sorting an array that is sorted already is one cheap pass of
    plain array functions, which beats a lambda over every element.
    """
    placed = F.array_position(F.sort_array(F.array_append(ordered, bound)), bound)
    return placed.cast("int") - 1


def pages(text: Column, size: Column | int) -> Column:
    """Cut a text into consecutive pieces of ``size`` characters, in one pass."""
    width = F.lit(str(size)) if isinstance(size, int) else size.cast("string")
    pattern = F.concat(F.lit("(?s).{1,"), width, F.lit("}"))
    return F.regexp_extract_all(text, pattern, F.lit(0))
