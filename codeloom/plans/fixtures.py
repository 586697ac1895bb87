"""Inputs of the registered queries, derived from the whole given tables.

The given tables hold no source code, so ``corpus`` turns every part into one file.
Its text is plain SQL that Spark and DuckDB both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import by_key, spread, spread_rows
from codeloom.sources.corpus import admitted

_KEYS = ("*", "CAST(p_partkey AS VARCHAR(20)) AS k", "chr(10) AS nl")
_REPO = "lower(replace(p_brand, '#', '-'))"
_PATH = """
CASE p_partkey % 12
  WHEN 0 THEN 'src/main/java/app/controller/Part' || k || 'Controller.java'
  WHEN 1 THEN 'src/main/java/app/service/Part' || k || 'Service.java'
  WHEN 2 THEN 'src/main/java/app/repository/Part' || k || 'Repository.java'
  WHEN 3 THEN 'src/main/java/app/model/Part' || k || '.kt'
  WHEN 4 THEN 'src/main/java/app/security/Part' || k || 'Auth.java'
  WHEN 5 THEN 'tools/part_' || k || '.py'
  WHEN 6 THEN 'web/js/part' || k || '.ts'
  WHEN 7 THEN 'web/css/part' || k || '.css'
  WHEN 8 THEN 'web/part' || k || '.HTML'
  WHEN 9 THEN '.git/hooks/part' || k || '.py'
  WHEN 10 THEN 'notes/part' || k || '.txt'
  ELSE 'tools/__init' || k || '__.py' END
"""
_CONTENT = """
CASE WHEN p_partkey % 12 IN (0,1,2,3,4) THEN
   'package app;' || nl || nl || 'public class Part' || k || ' {' || nl ||
   repeat(nl || '    public int get' || k || '(int a) {' || nl
     || '        if (a > ' || CAST(p_size AS VARCHAR(11)) || ' && a < 90) {' || nl
     || '            return a;' || nl || '        }' || nl
     || '        else if (a == 3) {' || nl
     || '            for (int i = 0; i < a; i++) a++;' || nl
     || '        }' || nl || '        return 0;' || nl || '    }' || nl, 1 + p_size)
   || '}' || nl
  WHEN p_partkey % 12 IN (5,9) THEN
   'import os' || nl || nl || repeat(nl || 'def f' || k || '(x):' || nl
     || '    if x > ' || CAST(p_size AS VARCHAR(11)) || ':' || nl || '        return x' || nl
     || '    elif x or x:' || nl || '        pass' || nl, 1 + p_size)
  WHEN p_partkey % 12 = 6 THEN
   repeat('function g' || k || '(x) {' || nl || '  while (x) {' || nl || '    x--;' || nl
     || '  }' || nl || '}' || nl || nl, 1 + p_size)
  WHEN p_partkey % 12 = 11 THEN '  ' || nl
  ELSE repeat('p { margin: 0 } ' || p_name || nl, 1 + p_size) END
"""
CORPUS_SQL = f"""
SELECT CAST(p_partkey AS BIGINT) AS file_id, {_REPO} AS repo, {_PATH} AS path,
 {_CONTENT} AS content
FROM (SELECT {', '.join(_KEYS)} FROM part) t
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A part is a file to analyse: few bytes, but some milliseconds of work.
FILES_PER_TASK = 10_000


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    parts = spread_rows(named, FILES_PER_TASK)
    return parts.selectExpr(*_KEYS).selectExpr(
        "CAST(p_partkey AS BIGINT) AS file_id",
        f"{_REPO} AS repo",
        f"{_PATH} AS path",
        f"{_CONTENT} AS content",
    )


# Raw bytes of the corpus: some files are no UTF-8, some have other line ends.
_RAW = (
    "CASE WHEN path LIKE '%.kt' THEN concat(encode(content, 'UTF-8'), unhex('808182')) "
    "WHEN path LIKE '%.HTML' THEN encode(replace(content, '\\n', '\\r\\n'), 'UTF-8') "
    "ELSE encode(content, 'UTF-8') END"
)


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a landed table of raw bytes."""
    return corpus(spark, sf_dir).selectExpr("repo", "path", f"{_RAW} AS content")


# Claims of reports: every line item claims a method in the file of its part. An order
# is a module and sixteen orders are a report, so groups stay small at any scale.
CLAIM_COLUMNS = {
    "report_id": "CAST(floor(l_orderkey / 16) AS BIGINT)",
    "module_pos": "CAST(l_orderkey % 16 AS INT)",
    "name": "'m' || CAST(l_orderkey AS VARCHAR(20)) || '_' || CAST(l_linenumber AS VARCHAR(11))",
    "file_id": "CAST(l_partkey AS BIGINT)",
    "start_line": "CAST(l_suppkey % 95 - 5 AS INT)",
    "end_line": "CAST(CASE WHEN l_returnflag = 'A' THEN 0 "
    "ELSE l_suppkey % 95 - 8 + CAST(l_quantity AS INT) END AS INT)",
    "confidence": "CASE WHEN CAST(l_quantity AS INT) = 7 THEN NULL "
    "ELSE CAST(CAST(l_quantity AS INT) * 2 % 100 AS DOUBLE) / 100 END",
}


# These decide every other claim column, so they order the methods of a module fully.
CLAIM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")


#: Line items are nested and sorted in groups, several times their own size.
ITEMS_PER_TASK = 250_000


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their report and the repository and path of the file of their part."""
    items = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", *CLAIM_ORDER))
    placed = corpus(spark, sf_dir).select("file_id", "repo", "path")
    keyed = items.selectExpr(*[f"{CLAIM_COLUMNS[c]} AS {c}" for c in ("report_id", "file_id")], "*")
    return keyed.join(placed, "file_id", "left").drop("file_id")


def _claimed(items: DataFrame) -> DataFrame:
    claim = [f"{e} AS {c}" for c, e in CLAIM_COLUMNS.items() if c != "report_id"]
    return items.selectExpr("report_id", *claim, *CLAIM_ORDER, "repo", "path")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per claimed method with the repository and path it cites."""
    return _claimed(_items(spark, sf_dir))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested reports of those claims. All files count as one repository, ``all``.

    Line items are moved once, before they are claims: modules and reports are grouped where
    a report's items lie.
    """
    method = F.struct(
        "name", F.concat(F.col("name"), F.lit("()")).alias("signature"),
        F.lit(None).cast("int").alias("loc"),
        F.lit(None).cast("double").alias("cyclomatic_complexity"),
        "confidence",
        F.struct(
            F.col("path"), F.col("start_line").cast("string").alias("start"),
            F.col("end_line").cast("string").alias("end"),
        ).alias("source_ref"),
    )
    methods = F.sort_array(F.collect_list(F.struct(*CLAIM_ORDER, method.alias("k"))))
    n = table(spark, sf_dir, "lineitem").count()
    claimed = _claimed(by_key(_items(spark, sf_dir), ["report_id"], n, ITEMS_PER_TASK))
    modules = claimed.groupBy("report_id", "module_pos").agg(
        methods.alias("ms"),
        F.min("path").alias("first_path"), F.max("path").alias("last_path"),
        F.min("start_line").alias("low"), F.max("end_line").alias("high"),
    )
    none = F.lit(None).cast("string")
    lines = F.when(
        F.col("module_pos") % 4 > 0,
        F.struct(
            F.col("low").cast("string").alias("start"),
            F.when(F.col("module_pos") % 4 > 1, F.col("high").cast("string")).alias("end"),
        ),
    )
    module = F.struct(
        F.concat(F.lit("order "), F.col("module_pos").cast("string")).alias("module_name"),
        F.array(F.lit("gone.java"), F.col("first_path")).alias("paths"),
        F.col("last_path").alias("path"), none.alias("description"), lines.alias("lines"),
        none.alias("example_snippet"),
        F.transform("ms", lambda m: m["k"]).alias("key_methods"),
        none.alias("complexity_notes"),
        F.array().cast("array<string>").alias("recommendations"),
        F.lit(0.9).alias("confidence"),
    )
    keyed = modules.select("report_id", F.struct("module_pos", module.alias("m")).alias("pm"))
    nested = keyed.groupBy("report_id").agg(F.sort_array(F.collect_list("pm")).alias("pms"))
    return nested.select(
        "report_id", F.lit("all").alias("repo"),
        F.transform("pms", lambda p: p["m"]).alias("key_modules"),
    )


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted raw files of the corpus under the one repository of the reports."""
    return admitted(raw_files(spark, sf_dir)).withColumn("repo", F.lit("all"))
