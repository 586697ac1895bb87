"""Functions are cut in one pass; counts of them alone measure none; parts are dealt by rows."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths, text
from codeloom.operators import functions as fn
from codeloom.session import spread_rows

JAVA = "package a;\n\x01\n" + "".join(
    f"    public int get{i}(int a\x01) {{\n        if (a && a) {{ return {i}; }}\n    }}\n\n" for i in range(40)
)


@pytest.fixture
def files(spark):
    rows = [
        ("r", "A.java", JAVA), ("r", "B.java", JAVA.replace("\x01", " ").replace("return", "retürn")),
        ("r", "c.py", "def f(x):\n  if x : pass\n"), ("r", "d.py", "x = 1\n"), ("r", "e.css", "p {}\n"),
    ]
    return spark.createDataFrame(rows, "repo string, path string, content string")


def test_counts_alone_measure_no_function(files):
    counted = fn.profile_modules(files).select("path", "num_functions")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace(" in plan and "aggregate(" not in plan
    assert {r["path"]: r["num_functions"] for r in counted.collect()} == {
        "A.java": 40, "B.java": 40, "c.py": 1, "d.py": 0, "e.css": 0,
    }


def test_a_text_that_holds_the_mark(files):
    found = {r["path"]: [] for r in files.collect()}
    for r in fn.find_functions(files).orderBy("path", "fn_index").collect():
        found[r["path"]].append(r)
    contents = {r["path"]: r["content"] for r in files.collect()}
    for path, name in (("A.java", "get{}"), ("B.java", "get{}"), ("c.py", "f")):
        rows, content = found[path], contents[path]
        assert [r["name"] for r in rows] == [name.format(i) for i in range(len(rows))]
        for r in rows:
            body = content[r["start_idx"] : r["start_idx"] + 1200]
            assert r["body_short"] == body and r["start_line"] == content[: r["start_idx"]].count("\n") + 1
            assert r["loc"] == body.count("\n") + 1
            assert r["cyclomatic"] == 1 + body.count(" if ") + body.count("&&")
    assert "\x01" in found["A.java"][0]["signature"] and not found["d.py"] and not found["e.css"]


def test_signatures_are_shortened_as_before(files):
    cut = files.select(fn.function_pieces(F.col("content"), paths.language(F.col("path"))).alias("p"), "content")
    raw = cut.select(F.explode(F.transform(fn.described_pieces(F.col("p"), F.col("content")), lambda f: f["signature"])).alias("s"))
    matches = files.select(F.explode(F.regexp_extract_all("content", fn._pattern(paths.language(F.col("path"))), F.lit(0))).alias("m"))
    expected = matches.select(text.shorten_signature(F.col("m")).alias("s"))
    assert sorted(r["s"] for r in raw.collect()) == sorted(r["s"] for r in expected.collect())


def test_parts_are_dealt_by_rows(spark):
    rows = spark.range(0, 1000, 1, spark.sparkContext.defaultParallelism)
    cores = rows.rdd.getNumPartitions()
    assert spread_rows(rows, 10_000).rdd.getNumPartitions() == cores
    dealt = spread_rows(rows, 10)
    number = dealt.rdd.getNumPartitions()
    assert 100 <= number < 100 + cores and number % cores == 0 and dealt.distinct().count() == 1000
