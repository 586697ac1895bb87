"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets come from weights and a cap per source. A source's documents stand in a seeded
order and are cut into blocks of equal token counts. Sainte-Lague gives every source an
integer quota: with divisor d it is target / d rounded, for any number of sources at once,
and the same rule on the shards' running shares splits the quota among shards. The quota
is filled with blocks chosen by a seeded order; a block is repeated only when the quota
exceeds the blocks there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import fingerprint, small, staged, table
from codeloom.llm.totals import running_totals

SEED = 20240502
MOST_REPEATS = 3
LEAST_BLOCKS = 400  # of the source with the smallest target; sets the block size
MOST_BLOCKS = 10**9  # so that products of two block numbers fit 64 bits
SHARDS = 16


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    bare = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")
    trimmed = F.trim(bare)
    blanks = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(text.isNull() | (trimmed == ""), 0).otherwise(blanks + 1).cast("long")


def source_targets(sizes: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """Per source: ``source_size``, ``weight``, ``target`` from rows (source, size).

    Weights run 1, 2, 3 over the sources by code point, null last. Sources share all words
    by weight; none gets more than ``repeats`` times its size, the excess goes to the rest.
    A source at its cap has cap / weight below the common level, so one pass over the
    sources in that order finds the level. The table has a row per source, 3 numbers each.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    code = F.hex(F.col("source").cast("binary"))  # UTF-8 bytes order as code points do
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), code))
    ranked = totals.withColumn("weight", ((place - 1) % 3 + 1).cast("double"))
    cap = F.col("source_size").cast("double") * repeats
    order = Window.orderBy(F.col("ratio"), F.col("source").isNull(), code)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(1))
    ranked = ranked.withColumns({"cap": cap, "ratio": cap / F.col("weight")})
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.sum("cap").over(upto) + F.col("cap")
    heavy = F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight")
    ranked = ranked.withColumn("level", left / heavy)  # if all before this source are capped
    ranked = ranked.withColumn("open", F.col("ratio") >= F.col("level"))
    # levels fall from the first open source on, so the greatest of them is the common one
    ranked = ranked.withColumn("common", F.max(F.when(F.col("open"), F.col("level"))).over(every))
    target = F.least("cap", F.coalesce(F.col("common"), F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


@dataclass(frozen=True)
class Mix:
    """``taken``: one row per document with ``__taken``; ``quotas``: blocks per source and shard."""

    taken: DataFrame
    quotas: DataFrame


def shard_quotas(plan: DataFrame, shards: int) -> DataFrame:
    """(source, shard, blocks): differences of the quotas of the shards' running shares."""
    share = lambda k: F.round(F.col("quota") * k / shards).cast("long")
    rows = plan.select("source", "quota", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    return rows.select("source", "shard", (share(F.col("shard") + 1) - share(F.col("shard"))).alias("blocks"))


def mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", seed: int = SEED, shards: int = SHARDS) -> Mix:
    """How many words of each document the mix takes.

    Columns of ``taken``: ``doc_id, source, size, source_size, target, taken`` and ``whole``, how often
    the document is taken if only whole ones can be. Documents without words take none and
    belong to no block. Null sources are one source. Repeated rows keep
    one row each; the order of equal rows does not matter. An empty table gives no rows. The
    same rows and seed give the same mix, however they are split.
    """
    sized = staged(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), size.cast("long").alias("size")), "mix-sizes")
    plan = source_targets(sized)
    least, total = plan.agg(F.min(F.when(F.col("target") > 0, F.col("target"))), F.sum("source_size")).first()
    block = max(1, int((least or 1.0) / LEAST_BLOCKS), (total or 0) // MOST_BLOCKS)
    plan = plan.withColumns({
        "blocks": F.ceil(F.col("source_size") / block),
        "quota": F.least(F.round(F.col("target") / block).cast("long"), F.ceil(F.col("source_size") / block) * MOST_REPEATS),
    })
    plan = staged(plan.withColumns({
        # every block is taken ``rounds`` times, and ``extra`` of them once more
        "rounds": F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long"),
        "extra": F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0).cast("long"),
    }), "mix-plan")
    worded = sized.where("size > 0").withColumn("draw", fingerprint(F.lit(seed), "doc_id", "size"))
    placed = running_totals(worded, ["source", "draw", "doc_id"], "size", "source")
    plan = plan.withColumn("phase", F.pmod(fingerprint(F.lit(seed), F.col("source")), F.greatest("blocks", F.lit(1))))
    known = small(plan.withColumnRenamed("source", "__source"))
    rows = placed.join(known, placed.source.eqNullSafe(F.col("__source")))
    a, b = F.col("before"), F.col("before") + F.col("size")
    chosen = chosen_words(b, block) - chosen_words(a, block)
    middle = a + F.floor(F.col("size") / 2)
    whole = F.col("rounds") + chosen_words(middle + 1, block) - chosen_words(middle, block)
    took = rows.select("doc_id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + chosen).cast("long").alias("taken"), whole.cast("long").alias("whole"))
    rest = sized.where("size = 0")
    rest = rest.join(known, rest.source.eqNullSafe(F.col("__source")))
    rest = rest.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(1).cast("long").alias("whole"))
    return Mix(took.unionByName(rest), shard_quotas(plan, shards))


def chosen_words(x: Column, block: int) -> Column:
    """Words before position ``x`` that lie in the ``extra`` chosen blocks of the source.

    Block j is chosen if (j * extra + phase) div blocks grows with j + 1: exactly ``extra``
    of the blocks, from a seeded phase on, over the seeded order of the documents.
    """
    count = F.greatest(F.col("blocks"), F.lit(1))
    share = lambda j: (j * F.col("extra") + F.col("phase") - F.pmod(j * F.col("extra") + F.col("phase"), count)) / count
    whole = F.floor(x / block)
    below, upto = F.round(share(whole)).cast("long"), F.round(share(whole + 1)).cast("long")
    return below * block + F.when(upto > below, x - whole * block).otherwise(0)


def take_whole(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` mixed to whole documents: each row once for every chosen block that holds its middle.

    Documents without words stay once. Repeated rows share their number of takes. All columns stay as they are.
    """
    names = docs.columns
    numbered = docs.withColumns({"__size": word_count(F.col(text)), "__key": fingerprint(*[F.col(f"`{c}`") for c in names])})
    mixed = mix(numbered, F.col("__size"), "__key", source, seed)
    times = mixed.taken.groupBy("doc_id").agg(F.max("whole").cast("int").alias("__times")).where("__times > 0")
    kept = numbered.join(times.withColumnRenamed("doc_id", "__key"), "__key")
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in names])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, word_count(F.col("text"))).taken.drop("source", "whole")
