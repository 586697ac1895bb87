"""Bucketed cache tables: unique at write, not moved by joins, found again by later sessions."""

from pyspark.sql import functions as F

from codeloom.operators import cache, inference
from codeloom.sources.caches import open_cache


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def filled(spark, base, rows, model="m", **how):
    table = open_cache(spark, base, model, "vector", 2, **how)
    table.add(spark.createDataFrame(rows, "sha string, vector array<float>"))
    return table


ROWS = [("a", [1.0, 2.0]), ("a", [0.5, 2.0]), ("b", [1.0]), ("c", [float("nan"), 1.0]), ("d", None), (None, [1.0, 1.0]), ("e", [3.0, 4.0]), ("f", [None, 1.0])]


def test_entries_are_checked_and_unique(spark, tmp_path):
    table = filled(spark, str(tmp_path), ROWS)
    assert sorted((r["sha"], r["vector"]) for r in table.entries().collect()) == [("a", [0.5, 2.0]), ("e", [3.0, 4.0])]
    table.add(spark.createDataFrame([("a", [9.0, 9.0]), ("g", [5.0, 6.0])], "sha string, vector array<float>"))
    again = open_cache(spark, str(tmp_path), "m", "vector", 2)
    again.add(spark.createDataFrame(ROWS, "sha string, vector array<float>"))
    assert sorted((r["sha"], r["vector"]) for r in again.entries().collect()) == [("a", [0.5, 2.0]), ("e", [3.0, 4.0]), ("g", [5.0, 6.0])]
    assert open_cache(spark, str(tmp_path), "other/model", "vector", 2).entries().isEmpty()
    assert open_cache(spark, str(tmp_path), "m", "vector", 3).entries().isEmpty()


def test_a_later_session_finds_the_table_and_its_buckets(spark, tmp_path):
    table = filled(spark, str(tmp_path), [(str(k), [1.0, float(k)]) for k in range(50)], buckets=4)
    spark.sql(f"DROP TABLE {table.name}")  # the definition only; the files are external
    found = open_cache(spark, str(tmp_path), "m", "vector", 2, buckets=32)
    assert found.buckets == 4 and found.entries().count() == 50


def test_joins_move_no_cache_row(spark, tmp_path):
    table = filled(spark, str(tmp_path), [(str(k), [1.0, float(k)]) for k in range(500)])
    asked = spark.range(600).select(F.col("id").cast("string").alias("sha"), F.lit("t").alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = cache.lookup(asked, table.entries(), ["sha"])
        plan = plan_of(found)
        assert plan.count("Exchange hash") == 1 and "Aggregate" not in plan
        side = plan[plan.rindex("Sort ["):]  # the cache's side of the join
        assert "Exchange" not in side
        assert "Bucketed: true" in side and "SelectedBucketsCount: 64 out of 64" in side
        missing = asked.select("sha").distinct().join(table.entries().select("sha"), "sha", "left_anti")
        side = plan_of(missing)
        assert "Exchange" not in side[side.rindex("Sort ["):]
        assert found.where("vector is null").count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert cache.misses(asked.unionByName(asked), table.entries()).count() == 100


def test_cached_inference_asks_once(spark, tmp_path):
    calls = []

    def make():
        def embed(texts):
            if "bad" in texts:
                raise OSError("no answer")
            return [[1.0, float(len(t))] for t in texts]

        return embed

    rows = [("a", "good"), ("b", "bad"), ("a", "good"), ("n", None)]
    asked = spark.createDataFrame(rows, "sha string, text string").where("text is not null")
    for run in ("one", "two"):
        table = open_cache(spark, str(tmp_path / "c"), "m", "vector", 2)
        found = inference.embed_cached(asked, table, make, "m", str(tmp_path / run), 2, batch_size=1, retries=0)
        calls.append(sorted(r["sha"] for r in found.fresh.collect()))
        assert [r["sha"] for r in found.entries.collect()] == ["a"]
        assert [r["sha"] for r in found.rejects.collect()] == ["b"]
    assert calls == [["a"], []]


def test_summaries_and_defaults(spark, tmp_path):
    functions = spark.createDataFrame([("1", "f()", "return 1"), ("2", "g()", "")], "sha string, signature string, body_short string")
    for run in ("one", "two"):
        table = open_cache(spark, str(tmp_path / "c"), "heuristic", "summary")
        found = inference.describe_cached(functions, table, "heuristic", str(tmp_path / run))
        assert sorted(r["sha"] for r in found.entries.collect()) == ["1", "2"]
    assert open_cache(spark, str(tmp_path / "c"), "heuristic", "summary").entries().count() == 2
