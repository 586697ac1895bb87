"""Aggregates over modules, role groups, reports, prompts and report conformance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from codeloom import constants as K
from codeloom.functions import paths, text
from codeloom.operators.numbering import numbered
from codeloom.operators.ranking import priority_limit, with_role
from codeloom.operators.replies import parse_strict
from codeloom.schemas import PROJECT_KNOWLEDGE_FIELDS, REPORT, REPORT_FIELDS


def language_profile(docs: DataFrame) -> DataFrame:
    """Files, characters and lines per language."""
    content = F.col("content")
    return docs.groupBy(paths.language(F.col("path")).alias("language")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.length(content)).alias("chars"),
        F.sum(text.line_count(content)).alias("lines"),
    )


def primary_languages(modules: DataFrame) -> DataFrame:
    """Sorted distinct languages of each repository."""
    found = F.array_sort(F.collect_set("language"))  # the language set is fixed
    return modules.groupBy("repo").agg(found.alias("primary_languages"))


def role_counts(modules: DataFrame) -> DataFrame:
    """Modules per repository and role, with all six roles for every repository."""
    counts = with_role(modules.select("repo", "path")).groupBy("repo", "role").agg(
        F.count(F.lit(1)).alias("n_modules")
    )
    every = counts.select("repo").distinct().select(
        "repo", F.posexplode(F.array(*[F.lit(r) for r in K.ROLES])).alias("role_rank", "role")
    )
    return every.join(counts, ["repo", "role"], "left").select(
        "repo", "role_rank", "role", F.coalesce("n_modules", F.lit(0)).alias("n_modules")
    )


def modules_by_role(modules: DataFrame) -> DataFrame:
    """One row per module with its ``position`` in the group of its repository and role.

    Positions follow the lower-cased path, then the path. An empty role of a repository is
    one row with a null position. A group of any size is spread over tasks.
    """
    rest = [c for c in modules.columns if c != "repo"]
    roled = with_role(modules).withColumn("_order", F.lower("path"))
    placed = numbered(roled, ["repo", "role_rank", "role"], ["_order", "path"])
    members = placed.select("repo", "role_rank", "role", "position", *rest)
    empty = role_counts(modules).where("n_modules = 0").select("repo", "role_rank", "role")
    return members.unionByName(empty, allowMissingColumns=True)


def corpus_totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files and characters in, chunks and chunk characters out, per repository."""
    files = docs.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("file_chars")
    )
    pieces = chunks.groupBy("repo").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chunk_chars")
    )
    zero = F.lit(0).cast("long")
    return files.join(pieces, "repo", "left").select(
        "repo", "files", "file_chars",
        F.coalesce("chunks", zero).alias("chunks"),
        F.coalesce("chunk_chars", zero).alias("chunk_chars"),
    )


# --- prompts ---------------------------------------------------------------------


def _evidence(top: Column) -> Column:
    lines = F.transform(
        F.slice(top, F.lit(1), F.lit(K.PROMPT_FUNCTIONS)),
        lambda f: F.concat(
            F.lit("- "), f["name"],
            F.lit(" (loc="), f["loc"].cast("string"),
            F.lit(", cc="), f["cyclomatic"].cast("string"),
            F.lit(", start="), f["start_line"].cast("string"), F.lit(")"),
        ),
    )
    return F.concat(
        F.lit("[file: "), F.col("path"), F.lit("]\nlang: "), F.col("language"),
        F.lit("\nlines: "), F.col("total_lines").cast("string"),
        F.lit("\nfunctions:\n"), F.array_join(lines, "\n"),
    )


def _joined(df: DataFrame, key: str, order: str, value: str, sep: str, out: str) -> DataFrame:
    """Join a bounded number of texts per key, in order."""
    rows = F.sort_array(F.collect_list(F.struct(order, value)))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r[value]), sep).alias(out))


def prompt_evidence(modules: DataFrame) -> DataFrame:
    """Evidence text of each repository from its first modules by priority."""
    narrow = modules.select("repo", "path", _evidence(F.col("top_functions")).alias("evidence"))
    first = priority_limit(narrow, K.PROMPT_MODULES)
    return _joined(first, "repo", "priority", "evidence", K.EVIDENCE_SEPARATOR, "evidence")


def prompt_contexts(
    contexts: DataFrame, max_chars: int = K.ANALYSIS_CONTEXT_CHARS, prefix: str = "file: "
) -> DataFrame:
    """Context text of each query from its ranked hits, ``path#index`` and cut text each."""
    block = F.concat(
        F.lit(f"[{prefix}"), F.coalesce("path", F.lit("None")), F.lit("#"),
        F.coalesce(F.col("chunk_index").cast("string"), F.lit("None")), F.lit("]\n"),
        F.substring(F.coalesce("document", F.lit("")), 1, max_chars),
    )
    blocks = contexts.select("query_id", "rank", block.alias("block"))
    return _joined(blocks, "query_id", "rank", "block", K.CONTEXT_SEPARATOR, "contexts")


DEFAULT_TEMPLATE = """Summarise this code base as one JSON document of the given shape.

Shape:
{schema}

Facts about its files:
{evidence}

Passages found by search:
{contexts}
"""


def build_prompts(evidence: DataFrame, contexts: DataFrame, template: str = DEFAULT_TEMPLATE):
    """Fill a template per repository; ``contexts`` has the repository as query id."""
    found = contexts.withColumnRenamed("query_id", "repo")
    prompt = F.lit(template.replace("{schema}", REPORT))
    for slot in ("evidence", "contexts"):
        prompt = F.replace(prompt, F.lit("{%s}" % slot), F.coalesce(slot, F.lit("")))
    return evidence.join(found, "repo", "left").select("repo", prompt.alias("prompt"))


# --- reports -----------------------------------------------------------------------


def report_modules(modules: DataFrame, n: int = K.REPORT_MODULES) -> DataFrame:
    """The first ``n`` modules of each repository with their position."""
    return priority_limit(modules, n)


def grouped_modules(modules: Column) -> Column:
    """Names and paths of an array of modules with their ``role`` by it, all six roles included."""
    def members(role: str) -> Column:
        own = F.filter(modules, lambda m: m["role"] == role)
        return F.transform(own, lambda m: F.struct(m["module_name"].alias("module_name"), m["path"].alias("path")))

    names = F.array(*[F.lit(r) for r in K.ROLES])
    return F.map_from_arrays(names, F.array(*[members(r) for r in K.ROLES]))


def assemble_reports(
    modules: DataFrame, urls: DataFrame | None = None, profiled: DataFrame | None = None
) -> DataFrame:
    """One offline report per repository, in the report form, and its ``repository``.

    Of ``modules`` only paths and languages are read where ``profiled`` holds the modules
    that reports may show (``profile_first``).

    ``grouped_modules`` tells the first modules by role and ``role_counts`` how many there
    are in all. All modules by role are a table of their own (``modules_by_role``), because
    they grow with the repository while a report row must not.
    """
    columns = [c for c in modules.columns if c != "repo"]
    first = report_modules(modules if profiled is None else profiled).groupBy("repo").agg(
        F.sort_array(F.collect_list(F.struct("priority", "role", *columns))).alias("key_modules")
    )
    sizes = role_counts(modules).groupBy("repo").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "n_modules")))).alias(
            "role_counts"
        )
    )
    joined = primary_languages(modules).join(sizes, "repo").join(first, "repo")
    url = F.lit(None).cast("string")
    if urls is not None:
        joined, url = joined.join(urls, "repo", "left"), F.col("url")
    unknown, none = F.lit("unknown"), F.array().cast("array<string>")
    return joined.select(
        F.col("repo").alias("repository"),
        F.col("repo").alias("project_name"),
        F.struct(
            url.alias("url"), unknown.alias("branch"), unknown.alias("commit")
        ).alias("repo"),
        F.lit("DRY_RUN").alias("project_overview"),
        "primary_languages",
        F.lit("").alias("architecture_summary"),
        none.alias("dependencies"),
        F.transform("key_modules", lambda m: m.dropFields("priority", "role")).alias("key_modules"),
        grouped_modules(F.col("key_modules")).alias("grouped_modules"),
        "role_counts",
        F.struct(
            F.lit(False).alias("has_tests"), none.alias("test_paths"),
            F.lit(False).alias("ci_present"),
        ).alias("tests_and_ci"),
        F.lit("").alias("global_complexity_notes"),
        none.alias("recommendations"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(
            "generated_at"
        ),
        F.array(F.lit("dry-run")).alias("assumptions"),
    )


def with_report_defaults(reports: DataFrame) -> DataFrame:
    """Fill ``generated_at``, ``key_modules`` and ``grouped_modules`` of parsed model reports."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    no_modules = F.array().cast(reports.schema["key_modules"].dataType)
    listed = reports.withColumn("generated_at", F.coalesce("generated_at", now)).withColumn(
        "key_modules", F.coalesce("key_modules", no_modules)
    )
    def roled(m: Column) -> Column:
        path = F.coalesce(m["path"], F.get(m["paths"], F.lit(0)))
        return F.struct(m["module_name"].alias("module_name"), path.alias("path"), paths.role(path).alias("role"))

    placed = F.transform("key_modules", roled)
    return listed.withColumn("grouped_modules", F.coalesce("grouped_modules", grouped_modules(placed)))


# --- conformance ---------------------------------------------------------------------

#: Fields that a document of each kind may leave out.
OPTIONAL = {
    "lead": {"key_modules[].path"},
    "simple": {
        "global_complexity_notes", "assumptions", "key_modules[].description",
        "key_modules[].key_methods[].description", "key_modules[].key_methods[].complexity_notes",
    },
}


def absences(owner: Column, kind: StructType, optional: set[str], prefix: str = "") -> Column:
    """Paths of all fields of a schema that ``owner`` lacks, in schema order.

    Fields of an absent object are not listed beside it. A member of an array is ``[]``,
    and each member counts.
    """
    found = []
    for field in kind.fields:
        name = prefix + field.name
        value = owner[field.name]
        none = F.array().cast("array<string>")
        missing = none if name in optional else F.array(F.lit(name))
        inner = none
        if isinstance(field.dataType, StructType):
            inner = absences(value, field.dataType, optional, f"{name}.")
        elif isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StructType):
            element, gone = field.dataType.elementType, F.array(F.lit(f"{name}[]"))
            inner = F.flatten(F.transform(
                value,
                lambda x: F.when(x.isNull(), gone).otherwise(absences(x, element, optional, f"{name}[]."))
            ))
        found.append(F.when(value.isNull(), missing).otherwise(inner))
    return F.concat(*found)


def report_conformance(documents: DataFrame, kind: str = "lead", raw: str = "raw") -> DataFrame:
    """Schema violations: one row per document, field and number of absences.

    ``kind`` is ``lead`` for the full report or ``simple`` for the small document. Nested
    fields are named by their path (``key_modules[].lines.start``). Text that is no JSON object
    gives the field ``$``; a value of a wrong type counts as absent.
    """
    fields = {"lead": REPORT_FIELDS, "simple": PROJECT_KNOWLEDGE_FIELDS}[kind]
    schema = ",".join(f"{name}:{type_}" for name, type_ in fields.items())
    parsed = documents.withColumn("doc", parse_strict(text.strip(F.col(raw)), f"struct<{schema}>"))
    missing = absences(F.col("doc"), parsed.schema["doc"].dataType, OPTIONAL[kind])
    fields = F.when(F.col("doc").isNull(), F.array(F.lit("$"))).otherwise(missing)
    keys = [c for c in documents.columns if c != raw]
    rows = parsed.select(*keys, F.explode(fields).alias("field"))
    return rows.groupBy(*keys, "field").agg(F.count(F.lit(1)).cast("int").alias("absent"))


def conformance_rejects(documents: DataFrame, kind: str = "lead", raw: str = "raw") -> DataFrame:
    """The documents that are no JSON object at all, with their text."""
    fields = {"lead": REPORT_FIELDS, "simple": PROJECT_KNOWLEDGE_FIELDS}[kind]
    schema = ",".join(f"{name}:{type_}" for name, type_ in fields.items())
    return documents.where(parse_strict(text.strip(F.col(raw)), f"struct<{schema}>").isNull())
