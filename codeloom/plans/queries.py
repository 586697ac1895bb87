"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import constants as K
from codeloom import schemas
from codeloom.functions import paths, text
from codeloom.functions.confidence import adjust_confidence
from codeloom.operators import (
    approximate,
    cache,
    chunking,
    inference,
    ranking,
    replies,
    report,
    search,
    validation,
)
from codeloom.operators import functions as fn
from codeloom.plans import fixtures as fx
from codeloom.plans.analysis import analyse, describe_modules
from codeloom.session import measured_stage, run_folder, spread, stage
from codeloom.sources import corpus as scan
from codeloom.sources import reports as report_io
from codeloom.sources import tables
from codeloom.sources.caches import open_cache

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(fx.table(spark, sf_dir, "documents").select(*columns))


def _pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(fx.table(spark, sf_dir, "pages").select(*columns))


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.profile_modules(fx.corpus(spark, sf_dir))


def _doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "source", "text")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return docs.select(F.col("source").alias("repo"), path.alias("path"),
                       F.col("text").alias("content"))


# --- scan ------------------------------------------------------------------------


@query
def corpus_scan(spark, sf_dir):
    scanned = scan.scan_files(fx.raw_files(spark, sf_dir))
    return scanned.select(
        "repo", "path", "decoded_as",
        F.length("content").alias("n_chars"), text.content_hash(F.col("content")).alias("sha"),
    )


@query
def ext_filter(spark, sf_dir):
    files = fx.corpus(spark, sf_dir)
    return files.where(paths.has_suffix(F.col("path"))).select("repo", "path")


@query
def hidden_dir_filter(spark, sf_dir):
    files = fx.corpus(spark, sf_dir)
    return files.where(~paths.in_hidden_folder(F.col("path"))).select("repo", "path")


@query
def decode_fallback(spark, sf_dir):
    decoded = scan.decode_files(fx.raw_files(spark, sf_dir))
    return decoded.select("path", "decoded_as", text.content_hash(F.col("content")).alias("sha"))


@query
def newline_norm(spark, sf_dir):
    mixed = F.concat(F.replace("html", F.lit("</p>"), F.lit("</p>\r\n")), F.lit("\r"))
    norm = text.normalise_newlines(mixed)
    rows = _pages(spark, sf_dir, "page_id", "html").select("page_id", norm.alias("t"))
    return rows.select(
        "page_id", text.line_count(F.col("t")).alias("n_lines"),
        text.content_hash(F.col("t")).alias("sha"),
    )


@query
def scan_limit(spark, sf_dir):
    return ranking.scan_limit(fx.corpus(spark, sf_dir).select("repo", "path"), 5)


@query
def vector_dim_check(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    cut = F.when(F.col("label") == 3, F.slice("embedding", 1, 1)).otherwise(F.col("embedding"))
    points = vectors.select("vec_id", cut.alias("vector"))
    good, bad = search.checked_points(points, 64)
    fits = good.withColumn("fits", F.lit(True)).unionByName(bad.withColumn("fits", F.lit(False)))
    return fits.select("vec_id", F.size("vector").alias("dim"), "fits")


def _placed(rows: DataFrame, key: str, body: F.Column, n: F.Column) -> DataFrame:
    """Points of one file per row, in ``n`` chunks."""
    path = F.concat(F.lit("doc/"), F.col(key).cast("string"))
    point = rows.select(
        F.lit("repo").alias("repo"), path.alias("path"),
        F.posexplode(F.array_repeat(body, n.cast("int"))).alias("chunk_index", "text"),
    )
    return point.select(tables.point_id().alias("id"), "repo", "path", "chunk_index", "text")


@query
def points_upsert(spark, sf_dir):
    """A written table of points, in which labelled documents land anew, each twice, and grow, shrink or lose all chunks."""
    label = F.concat(F.lit("label "), F.col("label").cast("string"))
    held = fx.table(spark, sf_dir, "embeddings")
    target = _placed(held, "vec_id", label, F.col("vec_id") % 3 + 1)
    labelled = fx.table(spark, sf_dir, "labels").select("doc_id")
    docs = fx.table(spark, sf_dir, "documents").join(labelled, "doc_id", "left_semi")
    new = _placed(docs, "doc_id", F.col("text"), F.floor(F.col("doc_id") / 3) % 4)
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    landed = docs.select(F.lit("repo").alias("repo"), path.alias("path"))
    base, one = run_folder(spark, "points"), F.array(F.lit(1.0).cast("float")).alias("vector")
    first = target.select("*", one)
    tables.upsert_points(spark, base, first, 1, first.select(*tables.FILE).distinct())
    merged = tables.upsert_points(spark, base, new.select("*", one), 1, landed.union(landed))
    return merged.select(
        "id", "path", "chunk_index", text.content_hash(F.col("text")).alias("text_sha")
    )


# --- scalar functions --------------------------------------------------------------


@query
def language_profile(spark, sf_dir):
    return report.language_profile(fx.corpus(spark, sf_dir))


@query
def path_parts(spark, sf_dir):
    path = F.col("path")
    return fx.corpus(spark, sf_dir).select(
        "path", paths.file_name(path).alias("module_name"), paths.suffix(path).alias("suffix"),
        paths.language(path).alias("language"),
    )


@query
def nonblank_docs(spark, sf_dir):
    return fn.nonblank(fx.corpus(spark, sf_dir)).select("repo", "path")


@query
def line_count(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", text.line_count(F.col("text")).alias("n_lines"))


@query
def cyclomatic(spark, sf_dir):
    files = fx.corpus(spark, sf_dir)
    return files.select("path", text.cyclomatic(F.col("content")).alias("cyclomatic"))


@query
def cyclomatic_validator(spark, sf_dir):
    docs = _pages(spark, sf_dir, "page_id", "html")
    found = text.cyclomatic(F.col("html"), K.VALIDATION_BRANCH_TOKENS)
    return docs.select("page_id", found.alias("cyclomatic"))


@query
def role_class(spark, sf_dir):
    roled = ranking.with_role(fx.corpus(spark, sf_dir).select("path"))
    return roled.select("path", "role", "role_rank")


@query
def content_hash(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", text.content_hash(F.col("text")).alias("sha"))


@query
def token_estimate(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query
def heuristic_summary(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", text.heuristic_summary(F.col("text")).alias("summary"))


@query
def prompt_body(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    fenced = F.replace("text", F.lit(". "), F.lit("```"))
    return docs.select("doc_id", text.prompt_body(fenced).alias("body"))


@query
def line_slice(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text", "n_chars")
    start = (F.col("n_chars") % 7 - 1).cast("int")
    cut = text.slice_lines(text.split_lines(F.col("text")), F.col("start"), F.col("end"))
    ranged = docs.withColumn("start", start).withColumn(
        "end", (F.col("start") + F.col("doc_id") % 6 - 1).cast("int")
    )
    return ranged.select("doc_id", cut.alias("lines"))


@query
def file_lines(spark, sf_dir):
    facts = validation.file_facts(fx.raw_files(spark, sf_dir))
    return facts.select(
        "path", F.size("lines").alias("n_lines"),
        text.content_hash(F.array_join("lines", "\n")).alias("sha"),
    )


@query
def confidence_adjust(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    given = F.when(F.col("o_custkey") % 10 > 0, (F.col("o_custkey") % 100) / 100)
    valid = F.col("o_orderstatus") == "O"
    branches = F.when(F.col("o_orderkey") % 23 > 0, (F.col("o_orderkey") % 23).cast("int"))
    return orders.select("o_orderkey", adjust_confidence(given, valid, branches).alias("adjusted"))


@query
def json_salvage(spark, sf_dir):
    events = spread(fx.table(spark, sf_dir, "events").select("event_id", "event_type", "props"))
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", F.concat(F.lit("sorry ["), F.substring("props", 1, 6)))
        .when(kind == "signup", F.concat(F.lit("none "), F.lit("of this")))
        .when(kind == "view", F.concat(F.lit("here: ["), "props", F.lit(", {bad] end")))
        .otherwise(F.concat(F.lit("Sure! ["), "props", F.lit(", "), "props", F.lit("] ok?")))
    )
    told = events.select("event_id", raw.alias("raw"))
    found = replies.salvage_arrays(told, "array<struct<k:int>>")
    found = replies.salvage_objects(found, "k:int")
    return found.select(
        "event_id", F.size("items").alias("n_items"),
        F.get("items", F.lit(0))["k"].alias("first_k"), F.col("item.k").alias("object_k"),
    )


@query
def summary_defaults(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit(""))
    described = F.when(
        F.col("turn") % 4 == 1, F.concat(F.lit(" \n"), F.col("text"), F.lit("\n"))
    ).when(F.col("turn") % 4 == 3, F.lit(" \n "))
    return turns.select(
        "conv_id", "turn", text.summary_or_default(said, described).alias("summary")
    )


@query
def collection_name(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"))
    return tables.collections(parts)


@query
def repo_from_url(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    return pages.select("page_id", paths.repo_from_url(F.col("url")).alias("repo"))


# --- functions and modules -----------------------------------------------------------


@query
def functions(spark, sf_dir):
    found = fn.find_functions(fx.corpus(spark, sf_dir))
    return found.select(
        "path", "language", "fn_index", "name", "signature", "start_idx", "start_line",
        "loc", "cyclomatic", text.content_hash(F.col("body_short")).alias("body_sha"),
    )


@query
def top_functions(spark, sf_dir):
    tops = fn.explode_top_functions(_modules(spark, sf_dir))
    return tops.select("path", "rank", "fn_index", "name", "start_line", "loc", "cyclomatic")


@query
def module_metrics(spark, sf_dir):
    return _modules(spark, sf_dir).select(
        "repo", "path", "language", "total_lines", "num_functions"
    )


@query
def module_profile(spark, sf_dir):
    tops = F.transform(
        "top_functions",
        lambda f: F.concat_ws(
            ":", f["name"], f["start_line"].cast("string"), f["loc"].cast("string"),
            f["cyclomatic"].cast("string"),
        ),
    )
    return _modules(spark, sf_dir).select(
        "repo", "module_name", "path", "language", "total_lines", "num_functions",
        F.array_join(tops, ",").alias("top_functions"), "confidence",
    )


@query
def primary_languages(spark, sf_dir):
    found = report.primary_languages(_modules(spark, sf_dir))
    return found.select("repo", F.array_join("primary_languages", ",").alias("languages"))


@query
def modules_by_role(spark, sf_dir):
    modules = _modules(spark, sf_dir).select("repo", "path", "language")
    rows = report.modules_by_role(modules)
    module = F.concat("language", F.lit(":"), "path")
    return rows.select("repo", "role_rank", "role", "position", module.alias("module"))


@query
def role_counts(spark, sf_dir):
    return report.role_counts(_modules(spark, sf_dir))


@query
def priority_order(spark, sf_dir):
    files = ranking.priority_positions(fx.corpus(spark, sf_dir).select("repo", "path"))
    return ranking.priority_order(files).select("repo", "role_rank", "role", "path", "n")


@query
def priority_limit(spark, sf_dir):
    first = ranking.priority_limit(fx.corpus(spark, sf_dir).select("repo", "path"), 20)
    return first.select("repo", "priority", "role", "path")


# --- chunks ----------------------------------------------------------------------------


def _shown_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "path", "chunk_index", F.length("text").alias("n_chars"), "chunk_sha"
    )


@query
def chunks_token(spark, sf_dir):
    files = fx.corpus(spark, sf_dir).select("repo", "path", "content")
    return _shown_chunks(chunking.chunk_files(files.unionByName(_doc_chunks(spark, sf_dir))))


@query
def chunks_fixed(spark, sf_dir):
    return _shown_chunks(chunking.chunk_files_fixed(_doc_chunks(spark, sf_dir)))


@query
def corpus_totals(spark, sf_dir):
    docs = _doc_chunks(spark, sf_dir)
    return report.corpus_totals(docs, chunking.chunk_files(docs))


@query
def run_metrics(spark, sf_dir):
    """Totals of a chunking stage, observed while it is written."""
    chunks = chunking.chunk_files(_doc_chunks(spark, sf_dir))
    _, seen = measured_stage(chunks, run_folder(spark, "chunks"), chars=F.sum(F.length("text")))
    return spark.createDataFrame([(seen["rows"], seen["chars"])], "chunks long, chunk_chars long")


@query
def dedup_hash(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    keyed = docs.select("doc_id", text.content_hash(F.col("text")).alias("sha"), "text")
    once = cache.distinct_requests(keyed.select("sha", "text"))
    return once.select("sha", F.length("text").alias("n_chars"))


# --- caches -----------------------------------------------------------------------------


def _hashed_docs(spark, sf_dir) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", text.content_hash(F.col("text")).alias("sha"), "text")


def _vector_cache(spark, sf_dir) -> DataFrame:
    """Vectors an earlier run left for the documents that have an embedding.

    Entries labelled 9 are cut short, as a damaged cache would hold them.
    """
    held = fx.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    vector = F.when(F.col("label") == 9, F.slice("embedding", 1, 1)).otherwise(F.col("embedding"))
    keyed = _hashed_docs(spark, sf_dir).select("doc_id", "sha").join(held, "doc_id")
    return keyed.select(F.lit("m").alias("model"), "sha", vector.alias("vector"))


@query
def cache_lookup(spark, sf_dir):
    known = cache.valid_vectors(_vector_cache(spark, sf_dir), "m", 64)
    docs = _hashed_docs(spark, sf_dir).select("doc_id", "sha")
    found = cache.lookup(docs, known, ["doc_id"])
    return found.select("doc_id", "sha", F.col("vector").isNotNull().alias("hit"))


@query
def cache_miss(spark, sf_dir):
    known = cache.valid_vectors(_vector_cache(spark, sf_dir), "m", 64)
    missed = cache.misses(_hashed_docs(spark, sf_dir).select("sha", "text"), known)
    return missed.select("sha", F.length("text").alias("n_chars"))


@query
def cache_table(spark, sf_dir):
    """A bucketed cache, filled in two overlapping runs, asked for every document."""
    held = _vector_cache(spark, sf_dir)
    table = open_cache(spark, run_folder(spark, "cache"), "m", "vector", 64)
    even = F.crc32("sha") % 2 == 0
    table.add(held.where(even))
    table.add(held)
    docs = _hashed_docs(spark, sf_dir).select("doc_id", "sha")
    missed = cache.misses(docs.select("sha"), table.entries()).withColumn("missed", F.lit(True))
    found = cache.lookup(docs, table.entries(), ["doc_id"]).join(missed, "sha", "left")
    return found.select(
        "doc_id", "sha", F.col("vector").isNotNull().alias("hit"),
        F.coalesce("missed", F.lit(False)).alias("missed"),
    )


@query
def cache_merge(spark, sf_dir):
    known = cache.valid_vectors(_vector_cache(spark, sf_dir), "m", 64)
    missed = cache.misses(_hashed_docs(spark, sf_dir).select("sha", "text"), known)
    fresh = inference.embed(missed, lambda: inference.hashing_embedder(32))
    merged = cache.merge(known, fresh.select("sha", "vector"))
    return merged.select("sha", F.size("vector").alias("dim"))


def _summary_cache(hashed: DataFrame) -> DataFrame:
    """Summaries an earlier run left for all Java functions."""
    java = hashed.where(F.col("language") == "java")
    summary = F.concat(F.lit("cached "), F.col("name"))
    return java.select(F.lit("m").alias("model"), "sha", summary.alias("summary"))


def _hashed_functions(spark, sf_dir) -> DataFrame:
    hashed = inference.with_method_hash(fn.find_functions(fx.corpus(spark, sf_dir)))
    return stage(hashed, run_folder(spark, "functions"))


@query
def summary_cache_lookup(spark, sf_dir):
    hashed = _hashed_functions(spark, sf_dir)
    known = cache.valid_summaries(_summary_cache(hashed), "m")
    asked = hashed.select("repo", "path", "fn_index", "sha")
    found = cache.lookup(asked, known, ["repo", "path", "fn_index"])
    return found.select("path", "fn_index", "sha", "summary")


@query
def summarize_methods(spark, sf_dir):
    hashed = _hashed_functions(spark, sf_dir)
    found = inference.describe_cached(hashed, _summary_cache(hashed), "m")
    put = inference.put_back(hashed.select("repo", "path", "fn_index", "sha"), found.entries)
    return put.select("path", "fn_index", "description")


def _odd_describer():
    """A model that leaves some methods out, repeats some and tells no text of others."""

    def describe(items: list[dict]) -> str:
        told = []
        for item in items:
            digit = item["hash"][0]
            if digit == "2":
                told.append({"hash": item["hash"], "summary": "an earlier try"})
            if digit != "0":
                said = 7 if digit == "1" else f" says\n{item['signature']} "
                told.append({"hash": item["hash"], "summary": said})
        return f"Sure! {json.dumps(told)} Anything else?"

    return describe


@query
def describe_model(spark, sf_dir):
    """All methods described by a model whose answers have gaps."""
    hashed = _hashed_functions(spark, sf_dir)
    folder = run_folder(spark, "described")
    held = open_cache(spark, f"{folder}/cache", "odd", "summary")
    found = inference.describe_cached(hashed, held, "odd", folder, _odd_describer)
    put = inference.put_back(hashed.select("repo", "path", "fn_index", "sha"), found.entries)
    stored = held.entries().select("sha", F.lit(True).alias("stored"))
    return put.join(stored, "sha", "left").select(
        "path", "fn_index", "description", F.coalesce("stored", F.lit(False)).alias("stored")
    )


@query
def describe_functions(spark, sf_dir):
    modules = stage(_modules(spark, sf_dir), run_folder(spark, "modules"))
    none = spark.createDataFrame([], schemas.SUMMARY_CACHE)
    described, _ = describe_modules(
        modules, none, "m", run_folder(spark, "describe")
    )
    shown = F.transform(
        "top_functions", lambda f: F.concat(f["name"], F.lit("|"), f["description"])
    )
    return described.select(
        "path", "num_functions", F.array_join(shown, "\n").alias("descriptions")
    )


@query
def reply_match(spark, sf_dir):
    top = fn.explode_top_functions(_modules(spark, sf_dir))
    hashed = stage(inference.with_method_hash(top), run_folder(spark, "top"))
    requests = hashed.select("sha", "name", "language").distinct()
    said = F.concat(F.lit(" does\n"), F.col("name"), F.lit(" "))
    body = (
        F.when(F.col("language") == "java", F.to_json(F.struct(F.col("sha").alias("hash"),
                                                               said.alias("summary"))))
        .when(F.col("language") == "python", F.to_json(F.struct(F.col("sha").alias("hash"),
                                                                said.alias("description"))))
        .otherwise(F.lit("{oops"))
    )
    told = requests.select(F.concat(F.lit("Fine: ["), body, F.lit("] bye")).alias("raw"))
    return replies.match_replies(requests, told).select("sha", "name", "summary")


@query
def known_collections(spark, sf_dir):
    wanted = tables.collections(
        fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"))
    )
    brands = fx.table(spark, sf_dir, "part").where("p_size > 49 AND p_type = 'SMALL'")
    existing = tables.collections(brands.select(F.col("p_brand").alias("repo")))
    return tables.known_collections(wanted, existing)


# --- inference and search ------------------------------------------------------------------


def _vector_shown(df: DataFrame, *keys: str) -> DataFrame:
    weighted = F.aggregate(
        F.transform("vector", lambda x, i: x.cast("double") * (i + 1)),
        F.lit(0.0), lambda a, x: a + x,
    )
    return df.select(*keys, F.size("vector").alias("dim"), F.round(weighted, 3).alias("checksum"))


@query
def embed_corpus(spark, sf_dir):
    requests = _hashed_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("sha"), "text")
    found = inference.embed(requests, lambda: inference.hashing_embedder(32))
    return _vector_shown(found.withColumnRenamed("sha", "doc_id"), "doc_id")


@query
def embed_cached(spark, sf_dir):
    found = inference.embed_cached(
        _hashed_docs(spark, sf_dir).select("sha", "text"), _vector_cache(spark, sf_dir),
        lambda: inference.hashing_embedder(64), "m", run_folder(spark, "embed_cached"), 64,
    )
    fresh = found.fresh.select("sha").withColumn("fresh", F.lit(True))
    entries = found.entries.join(fresh, "sha", "left")
    return entries.select(
        "sha", F.size("vector").alias("dim"), F.coalesce("fresh", F.lit(False)).alias("fresh")
    )


@query
def batching(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    sizes = inference.batch_sizes(docs, K.EMBED_BATCH)
    return sizes.agg(
        F.sum("batch_rows").alias("rows"),
        (F.max("batch_rows") <= K.EMBED_BATCH).alias("within_bound"),
    )


def _points(spark, sf_dir) -> DataFrame:
    held = spread(fx.table(spark, sf_dir, "embeddings"))
    return held.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query
def vector_topk(spark, sf_dir):
    points = _points(spark, sf_dir)
    (mean,) = search.mean_vectors(points).first()
    hits = search.top_k(points, mean)
    return hits.select("id", "label", F.round("score", 6).alias("score"))


@query
def vector_topk_batch(spark, sf_dir):
    points = _points(spark, sf_dir)
    queries = search.mean_vectors(points, ["label"]).withColumnRenamed("label", "query_id")
    hits = search.top_k_batch(points, queries)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query
def vector_topk_zero(spark, sf_dir):
    """Scores of zero told as null: half of the points lie across the query."""
    points = _points(spark, sf_dir)
    flat = F.transform("vector", lambda x, i: F.when(i > 0, x).otherwise(F.lit(0.0).cast("float")))
    across = points.withColumn("vector", F.when(F.col("label") % 2 == 0, flat).otherwise(F.col("vector")))
    dim = points.select(F.max(F.size("vector"))).first()[0]
    hits = search.top_k(across, [1.0] + [0.0] * (dim - 1), 1000, zero_as_null=True)
    return hits.select("id", F.round("score", 6).alias("score"))


@query
def vector_topk_all(spark, sf_dir):
    """All vectors as queries."""
    points = _points(spark, sf_dir)
    hits = search.top_k_batch(points, points.select(F.col("id").alias("query_id"), "vector"))
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query
def vector_topk_approx(spark, sf_dir):
    """Every twentieth vector as a query against an index of all."""
    points = _points(spark, sf_dir)
    dim = points.select(F.max(F.size("vector"))).first()[0]
    index = approximate.build_index(points, run_folder(spark, "index"), dim)
    queries = points.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vector")
    hits = approximate.search_index(queries, index)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query
def prompt_context(spark, sf_dir):
    points = _points(spark, sf_dir)
    queries = search.mean_vectors(points, ["label"]).withColumnRenamed("label", "query_id")
    docs = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("path"),
        F.lit(0).alias("chunk_index"), "text",
    )
    hits = stage(search.top_k_batch(points, queries), run_folder(spark, "hits"))
    found = search.with_payload(hits, docs, n_hits=hits.count())
    return report.prompt_contexts(search.contexts(found))


@query
def prompt_evidence(spark, sf_dir):
    return report.prompt_evidence(fn.profile_first(fx.corpus(spark, sf_dir), K.PROMPT_MODULES))


# --- reports ---------------------------------------------------------------------------------


@query
def report_assemble(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir)
    shown = fn.profile_first(docs, K.REPORT_MODULES)
    reports = report.assemble_reports(fn.profile_modules(docs), profiled=shown)
    module_paths = F.transform("key_modules", lambda m: m["path"])
    return reports.select(
        F.col("repository").alias("repo"), "project_name", "project_overview",
        F.array_join("primary_languages", ",").alias("languages"),
        F.array_join(module_paths, ",").alias("key_modules"),
        F.col("role_counts")["controllers"].alias("controllers"),
        F.col("role_counts")["other"].alias("other"),
        F.size(F.col("grouped_modules")["other"]).alias("listed_other"),
        F.col("repo.branch").alias("branch"), F.size("dependencies").alias("dependencies"),
        F.col("tests_and_ci.has_tests").alias("has_tests"),
        F.get("assumptions", F.lit(0)).alias("assumption"),
    )


def _report_totals(reports: DataFrame) -> DataFrame:
    methods = F.flatten(F.transform("key_modules", lambda m: m["key_methods"]))
    return reports.select(
        "project_name", F.size("key_modules").alias("modules"), F.size(methods).alias("methods"),
        F.get("key_modules", F.lit(0))["path"].alias("first_path"),
    )


def _named_reports(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("report "), F.col("report_id").cast("string"))
    return fx.reports(spark, sf_dir).withColumn("project_name", name)


@query
def report_json(spark, sf_dir):
    folder = run_folder(spark, "report_json")
    repository = F.concat(F.lit("r"), (F.col("report_id") % 5).cast("string"))
    reports = _named_reports(spark, sf_dir).drop("repo").withColumn("repository", repository)
    report_io.write_reports(reports, folder, compression="gzip")
    back = report_io.read_reports(spark, folder, multi_line=False)
    places = back.select("project_name", F.col("repository").alias("repo"))
    return _report_totals(back).join(places, "project_name")


@query
def report_round_trip(spark, sf_dir):
    """Assembled reports, written and read with the default schema; model reports with defaults."""
    folder = run_folder(spark, "report_rows")
    report_io.write_reports(report.assemble_reports(_modules(spark, sf_dir)), folder)
    back = report_io.read_reports(spark, folder, multi_line=False)
    told = report.with_report_defaults(back.withColumn("grouped_modules", F.lit(None).cast(schemas.GROUPED)))
    members = F.transform(F.col("grouped_modules")["services"], lambda m: m["path"])
    return told.select(
        "repository", "project_name", F.col("repo.commit").alias("commit"),
        F.size("key_modules").alias("modules"), F.array_join(members, ",").alias("services"),
        F.size("grouped_modules").alias("roles"), F.col("role_counts")["other"].alias("other"),
        F.col("generated_at").isNotNull().alias("dated"),
    )


@query
def report_scan(spark, sf_dir):
    told = _named_reports(spark, sf_dir).select(
        "report_id", F.to_json(F.struct("project_name", "key_modules")).alias("raw")
    )
    return _report_totals(report_io.parse_reports(told))


@query
def report_unnest(spark, sf_dir):
    modules = validation.unnest_modules(fx.reports(spark, sf_dir))
    methods = validation.unnest_methods(modules)
    return methods.select(
        "report_id", "module_pos", "module_name", "method_pos", "name",
        F.col("source_ref.path").alias("path"), F.col("source_ref.start").alias("start"),
        F.col("source_ref.end").alias("end"), "confidence",
    )


@query
def first_existing_path(spark, sf_dir):
    modules = validation.unnest_modules(_reports(spark, sf_dir))
    chosen = validation.choose_paths(modules, fx.report_files(spark, sf_dir))
    return chosen.select("report_id", "module_pos", "chosen_path")


def _claims(spark, sf_dir) -> DataFrame:
    rows = fx.claims(spark, sf_dir).withColumn("repo", F.lit("all"))
    return rows.drop("file_id")


@query
def claim_lookup(spark, sf_dir):
    files = fx.report_files(spark, sf_dir).select("repo", "path")
    present = files.withColumn("found", F.lit(True))
    claims = _claims(spark, sf_dir)
    located = validation.locate(claims, present, ["report_id", "module_pos", "name"])
    return located.groupBy("report_id", "path").agg(
        F.count(F.lit(1)).alias("claims"), F.count("found").alias("found")
    )


@query
def containing_function(spark, sf_dir):
    spans = validation.function_spans(fx.report_files(spark, sf_dir))
    found = validation.containing_functions(_claims(spark, sf_dir), spans)
    return found.select(
        "report_id", "path", "start_line", "end_line",
        F.col("within.fn_index").alias("fn_index"), F.col("within.cyclomatic").alias("cyclomatic"),
    )


def _reports(spark, sf_dir) -> DataFrame:
    """The reports as the written table that a validation run would read."""
    return stage(fx.reports(spark, sf_dir), run_folder(spark, "reports"), validation.ZSTD)


def _methods(spark, sf_dir) -> DataFrame:
    files = fx.report_files(spark, sf_dir)
    folder = run_folder(spark, "validate")
    placed = validation.placed_modules(_reports(spark, sf_dir), files, folder)
    return validation.validate_methods(placed, files)


def _validated(spark, sf_dir, reports: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    given = _reports(spark, sf_dir) if reports is None else reports
    found = validation.validate(
        given, fx.report_files(spark, sf_dir), run_folder(spark, "validate")
    )
    return found.methods, found.modules


@query
def validate_methods(spark, sf_dir):
    methods = _methods(spark, sf_dir)
    return methods.select(
        "report_id", "module_pos", "method_pos", "name", "path",
        text.content_hash(F.col("evidence_snippet")).alias("evidence_sha"),
        "computed_loc", "computed_cyclomatic", "confidence_adjusted",
        F.col("_validated").alias("validated"),
    )


@query
def validate_modules(spark, sf_dir):
    _, modules = _validated(spark, sf_dir)
    return modules.select(
        "report_id", "module_pos", "path",
        text.content_hash(F.col("example_snippet_actual")).alias("snippet_sha"),
        F.col("_validated").alias("validated"), "methods", "valid_methods",
    )


@query
def module_validity(spark, sf_dir):
    methods = _methods(spark, sf_dir)
    return methods.groupBy("report_id", "module_pos").agg(
        F.bool_or("_validated").alias("validated")
    )


@query
def validation_summary(spark, sf_dir):
    return validation.validation_summary(*_validated(spark, sf_dir))


@query
def validation_warnings(spark, sf_dir):
    methods = _methods(spark, sf_dir)
    rows = stage(validation.warnings(methods), run_folder(spark, "warnings"))
    first = validation.first_warnings(rows).select(
        "report_id", "module_pos", "method_pos", F.lit(True).alias("shown")
    )
    return rows.join(first, ["report_id", "module_pos", "method_pos"], "left").select(
        "report_id", "module_pos", "method_pos", "warning",
        F.coalesce("shown", F.lit(False)).alias("shown"),
    )


def _validated_totals(out: DataFrame) -> DataFrame:
    methods = F.flatten(F.transform("key_modules", lambda m: m["key_methods"]))
    return out.select(
        "report_id", F.size("key_modules").alias("modules"),
        F.size(F.filter("key_modules", lambda m: m["_validated"])).alias("valid_modules"),
        F.size(F.filter(methods, lambda m: m["_validated"])).alias("valid_methods"),
        F.aggregate(
            methods, F.lit(0),
            lambda a, m: a + F.coalesce(m["computed_cyclomatic"], F.lit(0)),
        ).alias("complexity"),
        F.col("_validation_summary.methods_total").alias("methods_total"),
        F.size("_validation_summary.warnings").alias("warnings"),
    )


@query
def validated_report(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    return _validated_totals(validation.validated_reports(reports, *_validated(spark, sf_dir, reports)))


@query
def validated_sink(spark, sf_dir):
    """Validated reports written as JSON and read again."""
    reports = _reports(spark, sf_dir)
    out = validation.validated_reports(reports, *_validated(spark, sf_dir, reports))
    folder = run_folder(spark, "validated_json")
    report_io.write_validated(out, folder)
    return _validated_totals(spark.read.schema(out.schema).json(folder))


def _raw_documents(spark, sf_dir, kind: str) -> DataFrame:
    """Model documents made of orders: whole ones, ones with gaps and broken ones."""
    orders = spread(
        fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    )
    key = F.col("o_orderkey").cast("string")
    gap = F.col("o_orderstatus") == "O"
    if kind == "lead":
        doc = F.struct(
            key.alias("project_name"), F.lit("text").alias("project_overview"),
            F.struct(F.lit("u").alias("url")).alias("repo"),
            F.array(F.lit("java")).alias("primary_languages"),
            F.when(~gap, F.lit("a")).alias("architecture_summary"),
            F.when(~gap, F.lit("now")).alias("generated_at"),
            F.array(F.lit("x")).alias("recommendations"),
            F.array(F.struct(
                F.lit("m").alias("module_name"), F.array(F.lit("p")).alias("paths"),
                F.struct(F.when(~gap, 1).alias("start")).alias("lines"),
                F.array(
                    F.struct(F.lit("f").alias("name"), F.lit(0.5).alias("confidence")),
                    F.struct(F.when(~gap, "g").alias("name"), F.lit(1.5).alias("confidence")),
                ).alias("key_methods"),
            )).alias("key_modules"),
        )
    else:
        method = F.struct(F.when(~gap, key).alias("name"), F.lit("f()").alias("signature"))
        module = F.struct(
            F.lit("m").alias("module_name"), F.when(~gap, F.lit("p")).alias("path"),
            F.array(method, method).alias("key_methods"),
        )
        doc = F.struct(
            key.alias("project_name"), F.lit("text").alias("project_overview"),
            F.array(module).alias("key_modules"),
            F.lit("2024-01-01T00:00:00Z").alias("generated_at"),
        )
    whole = F.to_json(doc)
    raw = F.when(
        F.startswith("o_orderpriority", F.lit("1")), F.concat(F.lit("{\"a\": "), key)
    ).otherwise(whole)
    return orders.select("o_orderkey", raw.alias("raw"))


@query
def report_conformance(spark, sf_dir):
    lead = report.report_conformance(_raw_documents(spark, sf_dir, "lead"), "lead")
    simple = report.report_conformance(_raw_documents(spark, sf_dir, "simple"), "simple")
    return lead.withColumn("kind", F.lit("lead")).unionByName(
        simple.withColumn("kind", F.lit("simple"))
    )


@query
def analysis_run(spark, sf_dir):
    """The whole analysis, with its stages written; one row per repository."""
    done = analyse(fx.raw_files(spark, sf_dir), run_folder(spark, "analysis"))
    chunks = done.chunks.groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"))
    points = done.points.groupBy("repo").agg(F.countDistinct("id").alias("points"))
    shown = done.reports.select(
        F.col("repository").alias("repo"), F.size("key_modules").alias("key_modules"),
        F.array_join("primary_languages", ",").alias("languages"),
    )
    counts = done.modules.groupBy("repo").agg(
        F.count(F.lit(1)).alias("modules"),
        F.sum(F.size("top_functions")).alias("described"),
    )
    return shown.join(counts, "repo").join(chunks, "repo").join(points, "repo")
