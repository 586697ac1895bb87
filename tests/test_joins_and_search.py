"""Skewed joins, caches, inference and vector search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.operators import cache, inference, numbering, ranking, replies, report, search
from codeloom.operators.skew import hot_keys, skew_join
from codeloom.sources import tables


def test_skew_join_equals_a_plain_join(spark):
    left = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k")
    ).withColumn("k", F.when(F.col("id") % 50 == 1, None).otherwise(F.col("k")))
    right = spark.range(0, 1000, 2).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    right = right.unionByName(spark.createDataFrame([("hot", -1)], "k string, v long"))
    assert [r["_salts"] for r in hot_keys(left, ["k"], 100).collect()] == [4]
    for how in ("left", "inner"):
        got = skew_join(left, right, ["k"], how, ["id"], hot_rows=100).select("id", "k", "v")
        want = left.join(right, "k", how).select("id", "k", "v")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_hot_key_reaches_many_tasks(spark):
    left = spark.range(4000).select("id", F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew_join(left, right, ["k"], "left", ["id"], hot_rows=100)
        parts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 4000


def test_cache_ignores_damaged_entries_and_other_models(spark):
    rows = [("m", "a", [1.0, 2.0]), ("m", "b", [1.0]), ("n", "c", [1.0, 2.0]), ("m", "d", None)]
    entries = spark.createDataFrame(rows, "model string, sha string, vector array<float>")
    known = cache.valid_vectors(entries, "m", 2)
    assert [r["sha"] for r in known.collect()] == ["a"]
    wanted = spark.createDataFrame([(s, s) for s in "aabbcd"], "sha string, text string")
    assert sorted(r["sha"] for r in cache.misses(wanted, known).collect()) == ["b", "c", "d"]


def test_embedding_keeps_order_and_batches(spark):
    rows = [(str(i), f"text {i}") for i in range(23)]
    frame = spark.createDataFrame(rows, "sha string, text string").repartition(3)
    embedder = inference.hashing_embedder(40)
    got = inference.embed(frame, lambda: inference.hashing_embedder(40), batch_size=2)
    for r in got.collect():
        assert r["error"] is None
        assert r["vector"] == pytest.approx(embedder([f"text {r['sha']}"])[0], abs=1e-6)
    sizes = inference.batch_sizes(frame.coalesce(1), 5).collect()
    assert sorted(r["batch_rows"] for r in sizes) == [3, 5, 5, 5, 5]


def test_failed_batches_become_rejects_and_are_not_cached(spark, tmp_path):
    def make():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise OSError("no answer")
            return [[1.0, 2.0]] * len(texts)

        return embed

    rows = [("a", "good"), ("b", "bad"), ("c", "good"), ("a", "good"), ("k", "known")]
    frame = spark.createDataFrame(rows, "sha string, text string")
    held = spark.createDataFrame([("m", "k", [3.0, 4.0])], "model string, sha string, vector array<float>")
    found = inference.embed_cached(
        frame, held, make, "m", str(tmp_path / "run"), 2, batch_size=1, retries=1, backoff=0.0
    )
    assert sorted(r["sha"] for r in found.entries.collect()) == ["a", "c", "k"]
    assert sorted(r["sha"] for r in found.fresh.collect()) == ["a", "c"]
    (reject,) = found.rejects.collect()
    assert reject["sha"] == "b" and "no answer" in reject["error"]


def test_retry_until_it_works():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("again")
        return "done"

    assert inference.with_retries(flaky, 3, lambda n: 0) == ("done", None)
    assert inference.with_retries(lambda: 1 / 0, 1, lambda n: 0)[1].startswith("ZeroDivision")


def test_descriptions_from_a_model(spark, tmp_path):
    def make():
        import json

        def describe(items):
            if any("broken" in i["body"] for i in items):
                return "no json here"
            said = [
                {"hash": i["hash"], "summary": 5 if "number" in i["body"] else " says\n" + i["signature"]}
                for i in items if "silent" not in i["body"]
            ]
            return "Sure: " + json.dumps(said) + " bye"

        return describe

    rows = [("1", "f()", "body"), ("2", "g()", "silent"), ("3", "h()", "broken\nx"), ("4", "i()", "b"), ("5", "j()", "number\ny")]
    frame = spark.createDataFrame(rows, "sha string, signature string, body_short string")
    held = spark.createDataFrame([("m", "4", "known")], "model string, sha string, summary string")
    found = inference.describe_cached(
        frame, held, "m", str(tmp_path / "run"), make, batch_size=1, retries=0
    )
    got = {r["sha"]: r["summary"] for r in found.entries.collect()}
    assert got == {
        "1": "says f()", "2": "<summary unavailable>", "3": "Performs: broken", "4": "known",
        "5": "Performs: number",
    }
    assert {r["sha"] for r in found.fresh.collect()} == {"1"}
    assert {r["sha"] for r in found.rejects.collect()} == {"2", "3", "5"}


def test_salvage(spark):
    rows = [
        ('sure! [{"hash":"h","summary":"s"}] ok', "h"), ("none", None), ("[bad", None),
        ('[{"hash":"h"}] and [{"hash":"i"}]', None), ("] [", None), (None, None),
    ]
    frame = spark.createDataFrame(rows, "raw string, want string")
    out = replies.salvage_arrays(frame, "array<struct<hash:string,summary:string>>")
    for r in out.collect():
        assert (r["items"][0]["hash"] if r["items"] else None) == r["want"], r
    frame = spark.createDataFrame([('x {"a": 1} y',), ("{1}",), ('{"a":1} {"a":2}',)], "raw string")
    out = replies.salvage_objects(frame, "a:int").collect()
    assert [r["item"]["a"] if r["item"] else None for r in out] == [1, None, None]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 8)).round(1)
    rows[10] = 0
    rows[20:30] = rows[20]  # ties
    rows[40] = rows[41] * 2
    data = [(int(i), [float(x) for x in r]) for i, r in enumerate(rows)]
    data.append((999, [1.0]))
    return spark.createDataFrame(data, "id long, vector array<float>").repartition(5), rows


def brute(rows, query, k):
    rows = rows.astype("float32").astype("float64")
    with np.errstate(invalid="ignore"):
        score = rows @ query / (np.linalg.norm(rows, axis=1) * np.linalg.norm(query))
    score = np.where(np.isnan(score), -np.inf, np.round(score, 9))
    return [int(i) for i in np.lexsort((np.arange(len(rows)), -score))[:k]]


def test_top_k_is_exact(points):
    frame, rows = points
    query = rows[20].astype("float32").astype("float64")
    hits = search.top_k(frame, query, 5)
    assert sorted(r["id"] for r in hits.collect()) == brute(rows, query, 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_batch_top_k_is_exact_in_one_block_and_in_many(spark, points):
    frame, rows = points
    ids = [0, 7, 33, 120, 250]
    data = [(f"q{i}", [float(x) for x in rows[i]]) for i in ids]
    queries = spark.createDataFrame(data, "query_id string, vector array<float>")
    for block_bytes in (1 << 20, 8 * 8 * 2):
        hits = search.top_k_batch(frame, queries, 6, block_bytes=block_bytes).collect()
        for i in ids:
            got = sorted((r["rank"], r["id"]) for r in hits if r["query_id"] == f"q{i}")
            assert [p for _, p in got] == brute(rows, rows[i].astype("float32").astype("float64"), 6)


def test_zero_vectors_and_scores(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])],
                                  "id int, vector array<float>")
    rows = {r["id"]: r["score"] for r in search.top_k(frame, [1.0, 0.0], 3).collect()}
    assert rows == {1: None, 2: 0.0, 3: 1.0}
    rows = search.top_k(frame, [1.0, 0.0], 3, zero_as_null=True).collect()
    assert {r["id"]: r["score"] for r in rows}[2] is None


def test_contexts_and_prompts(spark):
    hits = spark.createDataFrame(
        [("q", 1, 0.5, "a.py", 0, "x" * 2000), ("q", 2, None, None, None, None)],
        "query_id string, rank int, score double, path string, chunk_index int, text string",
    )
    (row,) = report.prompt_contexts(search.contexts(hits)).collect()
    assert row["contexts"] == "[file: a.py#0]\n" + "x" * 1500 + "\n\n---\n\n[file: None#None]\n"
    (row,) = report.prompt_contexts(search.contexts(hits), 3000, prefix="").collect()
    assert row["contexts"].startswith("[a.py#0]\n" + "x" * 2000 + "\n\n---")
    evidence = spark.createDataFrame([("q", "EV")], "repo string, evidence string")
    prompts = report.build_prompts(evidence, report.prompt_contexts(search.contexts(hits)))
    text = prompts.first()["prompt"]
    assert "EV" in text and "[file: a.py#0]" in text and "{" + "evidence}" not in text


def test_upsert_replaces_files_and_touches_no_other_repository(spark, tmp_path):
    base = str(tmp_path / "points")

    def points(*rows):
        made = [(f"{r}/{p}/{k}", [float(x)], p, k, "t", r) for r, p, n, x in rows for k in range(n)]
        return spark.createDataFrame(made, schemas.POINTS)

    def landed(*keys):
        return spark.createDataFrame(list(keys), "repo string, path string")

    def files(repo):
        found = (tmp_path / "points" / f"repo={repo}").rglob("*.parquet")
        return {(f.parent.name, f.name): f.stat().st_mtime_ns for f in found}

    first = points(("1", "a", 7, 1), ("1", "b", 2, 1), ("02", "a", 3, 1), ("3", "only", 1, 1))
    keys = landed(("1", "a"), ("1", "b"), ("02", "a"), ("3", "only"))
    assert tables.upsert_points(spark, base, first, 1, keys).count() == 13
    before = files("02")
    second = points(("1", "a", 1, 5), ("1", "c", 2, 5))
    keys = landed(("1", "a"), ("1", "a"), ("1", "c"), ("3", "only"))
    after = tables.upsert_points(spark, base, second, 1, keys)
    found = sorted((r["repo"], r["path"], r["chunk_index"], r["vector"][0]) for r in after.collect())
    assert found == [
        ("02", "a", 0, 1.0), ("02", "a", 1, 1.0), ("02", "a", 2, 1.0), ("1", "a", 0, 5.0),
        ("1", "b", 0, 1.0), ("1", "b", 1, 1.0), ("1", "c", 0, 5.0), ("1", "c", 1, 5.0),
    ]
    assert files("02") == before
    with pytest.raises(Exception, match="vector must have"):
        tables.upsert_points(spark, base, second, 2, keys)
    assert tables.read_points(spark, base).count() == 8
    many = points(*[("big", f"f{k}", 1, 1) for k in range(200)])
    assert tables.upsert_points(spark, base, many, 1, many.select("repo", "path")).where("repo = 'big'").count() == 200
    before, one = files("big"), points(("big", "f7", 2, 9))
    again = tables.upsert_points(spark, base, one, 1, landed(("big", "f7"))).where("repo = 'big'")
    assert again.count() == 201 and again.where("path = 'f7'").count() == 2
    changed = {part for part, _ in set(before.items()) ^ set(files("big").items()) for part in [part[0]]}
    assert len(changed) == 1 and len({part for part, _ in before}) == 16
    assert "bucket" not in again.columns


def test_last_answer_to_a_hash_counts(spark):
    told = spark.createDataFrame(
        [(1, '[{"hash": "x", "summary": "b first"}, {"hash": "y", "summary": "z"}]'),
         (2, '[{"hash": "x", "summary": "c"}, {"hash": "x", "summary": "a last"}]'), (3, "{oops")],
        "n int, raw string",
    )
    asked = spark.createDataFrame([("x", i) for i in range(40)] + [("y", 40), ("none", 41), (None, 42)], "sha string, i int")
    got = {r["i"]: r["summary"] for r in replies.match_replies(asked, told, "n", hot_rows=10).collect()}
    assert len(got) == 43 and {got[i] for i in range(40)} == {"a last"}
    assert got[40] == "z" and got[41] == got[42] == "<summary unavailable>"


def test_batch_search_passes_over_queries_of_another_length(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0]), (3, None)], "query_id long, vector array<float>")
    assert [(r["query_id"], r["id"]) for r in search.top_k_batch(points, asked, 1).collect()] == [(1, 1)]


def test_collections(spark):
    wanted = tables.collections(spark.createDataFrame([("A",), ("a",), ("B",)], "repo string"))
    held = spark.createDataFrame([("repo_a",)], "collection string")
    rows = tables.known_collections(wanted, held).collect()
    assert {(r["collection"], r["known"]) for r in rows} == {("repo_a", True), ("repo_b", False)}


def test_priority_and_caps(spark):
    paths = ["z/Foo.java", "B/UserController.java", "a/usercontroller.java", "m/Model.java"]
    frame = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    ranked = {r["path"]: r["priority"] for r in ranking.priority_limit(frame, 3).collect()}
    assert ranked == {"a/usercontroller.java": 1, "B/UserController.java": 2, "m/Model.java": 3}
    assert ranking.priority_limit(frame, 0).count() == 4
    assert {r["path"] for r in ranking.cap_files(frame, 1).collect()} == {"a/usercontroller.java"}
    assert [r["path"] for r in ranking.scan_limit(frame, 1).collect()] == ["B/UserController.java"]


def test_role_groups_of_any_size_have_positions(spark):
    frame = spark.range(500).select(
        F.lit("r").alias("repo"), F.format_string("x/%04d.java", "id").alias("path"),
        F.lit("java").alias("language"),
    ).repartition(5)
    rows = report.modules_by_role(frame).collect()
    other = sorted((r["position"], r["path"]) for r in rows if r["role"] == "other")
    assert other == [(k + 1, f"x/{k:04d}.java") for k in range(500)]
    empty = [r for r in rows if r["role"] != "other"]
    assert len(empty) == 5 and all(r["position"] is None and r["path"] is None for r in empty)


def test_numbers_over_many_tasks(spark):
    rows = [(k % 3 if k % 7 else None, k % 50, k) for k in range(900)] + [(0, None, 1000), (5, 1, 1001)]
    frame = spark.createDataFrame(rows, "g int, a int, b int").repartition(4)
    for within in (["g"], []):
        got = numbering.numbered(frame, within, ["a", "b"], "n").collect()
        held = {}
        for r in got:
            held.setdefault(r["g"] if within else 0, []).append(r)
        for members in held.values():
            members.sort(key=lambda r: r["n"])
            assert [r["n"] for r in members] == list(range(1, len(members) + 1))
            keys = [(r["a"] is not None, r["a"] or 0, r["b"]) for r in members]
            assert keys == sorted(keys)
        assert len(got) == len(rows)
    assert numbering.numbered(frame.limit(0), ["g"], ["a"]).isEmpty()
