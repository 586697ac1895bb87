"""Structured data out of free-form model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators.skew import HOT_ROWS, skew_join
from codeloom.schemas import REPLIES

def parse_strict(document: Column, kind: str) -> Column:
    """Parse a text that is one JSON document of type ``kind`` from end to end, else null.

    Spark's parser stops after the first document and accepts any text behind it. The
    document is therefore put in front of its own hash, which only a parse that read
    all of it can reach.
    """
    seal = F.sha2(document.cast("binary"), 256)
    sealed = F.concat(F.lit('{"doc":'), document, F.lit(',"seal":"'), seal, F.lit('"}'))
    parsed = F.from_json(sealed, f"doc {kind}, seal string")
    return F.when(parsed["seal"] == seal, parsed["doc"])


def json_array(raw: Column) -> Column:
    """Text from the first ``[`` to the last ``]``, null without both."""
    return text.between_outer(raw, "[", "]")


def json_object(raw: Column) -> Column:
    return text.between_outer(raw, "{", "}")


def salvage_arrays(replies: DataFrame, schema: str, raw: str = "raw") -> DataFrame:
    """Parse the array in each reply into ``items``; a bad reply gives null."""
    return replies.withColumn("items", parse_strict(json_array(F.col(raw)), schema))


def salvage_objects(replies: DataFrame, schema: str, raw: str = "raw") -> DataFrame:
    """Parse the object in each reply into ``item``; a bad reply gives null."""
    found = parse_strict(json_object(F.col(raw)), f"struct<{schema}>")
    return replies.withColumn("item", found)


def match_replies(
    requests: DataFrame, replies: DataFrame, order: str = "raw", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Give every ``(sha, ...)`` request the summary a raw reply holds for its hash.

    The last answer to a hash counts: that of the reply with the greatest ``order``, and
    within a reply the one further back. A hash that none answers takes the fixed default.
    """
    parsed = salvage_arrays(replies, REPLIES).select(
        F.col(order).alias("_reply"), F.posexplode("items").alias("_pos", "r")
    )
    summary = text.summary_or_default(F.col("r.summary"), F.col("r.description"))
    answers = parsed.select(
        F.col("r.hash").alias("sha"), summary.alias("summary"), F.struct("_reply", "_pos").alias("_at")
    )
    best = answers.groupBy("sha").agg(F.max_by("summary", "_at").alias("summary"))
    matched = skew_join(requests, best, ["sha"], "left", hot_rows=hot_rows)
    return matched.withColumn("summary", text.summary_or_default(F.col("summary")))
