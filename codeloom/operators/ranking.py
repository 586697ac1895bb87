"""Order files and modules by role, and cap their number per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators.numbering import numbered
from codeloom.operators.skew import broadcast_few, keep_listed
from codeloom.session import run_folder, stage


def with_role(df: DataFrame) -> DataFrame:
    return df.withColumn("role", paths.role(F.col("path"))).withColumn(
        "role_rank", paths.role_rank(F.col("path"))
    )


def priority_order(df: DataFrame) -> DataFrame:
    """Sort by repository, role and path; one range-partitioned shuffle."""
    return with_role(df).orderBy("repo", "role_rank", F.lower("path"), "path")


def priority_positions(df: DataFrame, name: str = "n") -> DataFrame:
    """The place of every row in that order, over all repositories."""
    ranked = with_role(df).withColumn("_lower", F.lower("path"))
    return numbered(ranked, [], ["repo", "role_rank", "_lower", "path"], name).drop("_lower")


def _first_per_repo(df: DataFrame, order: list, n: int, rank: str) -> DataFrame:
    window = Window.partitionBy("repo").orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def priority_limit(df: DataFrame, n: int, rank: str = "priority") -> DataFrame:
    """The first ``n`` rows of each repository by role and path; ``n <= 0`` keeps all.

    Tasks drop rows past ``n`` before the shuffle (WindowGroupLimit), so one very large
    repository costs n rows per task. Call it on narrow rows, without file contents.
    """
    ranked = with_role(df)
    if n <= 0:
        return ranked
    return _first_per_repo(ranked, ["role_rank", F.lower("path"), "path"], n, rank)


def scan_limit(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` files of each repository by path; 0 keeps all."""
    if n <= 0:
        return df
    return _first_per_repo(df, ["path"], n, "_n").drop("_n")


def cap_files(docs: DataFrame, n: int) -> DataFrame:
    """Keep the documents ``priority_limit`` selects, ranking without the contents."""
    if n <= 0:
        return docs
    kept = priority_limit(docs.select("repo", "path"), n)
    return keep_listed(docs, kept, ["repo", "path"])


def single_files(files: DataFrame, latest: str | None = None) -> DataFrame:
    """One row per ``(repo, path)``: of rows for one file that with the greatest ``latest``.

    Without ``latest``, and among equals, the greatest of the other columns in their order wins.
    Files that landed more than once are looked for on the keys alone; usually there are
    none, and no content moves. Else only the contents of those files do.
    """
    key = ["repo", "path"]
    counts = files.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    doubled = stage(counts.select(*[F.col(c).alias(f"_{c}") for c in key]), run_folder(files.sparkSession, "doubled"))
    if not doubled.head(1):
        return files
    same = [files[c].eqNullSafe(doubled[f"_{c}"]) for c in key]
    listed = broadcast_few(doubled)
    rest = [c for c in files.columns if c not in (*key, latest)]
    order = F.struct(*([latest] if latest else []), *rest)
    again = files.join(listed, same, "left_semi").groupBy(*key).agg(F.max(order).alias("_row"))
    single = files.join(listed, same, "left_anti")
    return single.unionByName(again.select(*key, "_row.*"))
