"""The interval join against plain look-ups, and claims read against hot and doubled files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codeloom import constants as K
from codeloom.functions import text
from codeloom.operators import intervals, ranking, validation
from codeloom.operators.skew import skew_join
from codeloom.sources import reports


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_sides(spark):
    draw = random.Random(3)
    marks = [(draw.choice("abc"), line, k, f"f{k}") for k, line in enumerate(sorted(draw.sample(range(1, 300), 60)))]
    marks += [("a", 500, 100, "same"), ("a", 500, 101, "line")]
    points = [(i, draw.choice(["a", "a", "b", "c", "d", None]), draw.choice([None, *range(-5, 600)]), draw.choice([None, *range(0, 600)])) for i in range(400)]
    points += [points[0], points[0]]  # repeated rows come back as often
    return (spark.createDataFrame(points, "id int, k string, x int, y int"),
            spark.createDataFrame(marks, "k string, start int, n int, name string"), points, marks)


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_last_at_or_before(spark, hot_rows):
    left, right, points, marks = random_sides(spark)

    def held(key, at):
        found = [m for m in marks if key is not None and at is not None and m[0] == key and m[1] <= at]
        best = max(found, key=lambda m: (m[1], m[2]), default=None)
        return best and (best[2], best[3])

    got = intervals.last_at_or_before(left, right, ["k"], ["x", "y"], "start", ["n", "name"], hot_rows)
    assert got.columns == ["id", "k", "x", "y", "x_held", "y_held"]
    want = sorted(((i, k, x, y, held(k, x), held(k, y)) for i, k, x, y in points), key=repr)
    assert sorted(((*r[:4], r[4] and tuple(r[4]), r[5] and tuple(r[5])) for r in got.collect()), key=repr) == want


def test_empty_sides(spark):
    left, right, points, _ = random_sides(spark)
    none = intervals.last_at_or_before(left, right.limit(0), ["k"], ["x"], "start", ["n"])
    assert none.count() == len(points) and none.where("x_held is not null").isEmpty()
    assert intervals.last_at_or_before(left.limit(0), right, ["k"], ["x"], "start", ["n"]).isEmpty()


def test_each_side_is_read_once(spark, tmp_path):
    left, right, _, _ = random_sides(spark)
    left.write.parquet(str(tmp_path / "points"))
    right.write.parquet(str(tmp_path / "marks"))
    points, marks = spark.read.parquet(str(tmp_path / "points")), spark.read.parquet(str(tmp_path / "marks"))
    plan = plan_of(intervals.last_at_or_before(points.where("k is not null"), marks, ["k"], ["x", "y"], "start", ["n"]))
    assert plan.count("/marks]") == 1 and "Join" not in plan and plan.count("Exchange hash") == 1


def test_containing_functions_of_random_claims(spark):
    content = "import os\n" + "".join(f"def f{k}(x):\n" + "    if x:\n        pass\n" * (k % 4) for k in range(30))
    files = spark.createDataFrame([("r", "a.py", content.encode()), ("r", "b.css", b"p {}\n")], "repo string, path string, content binary")
    lines = content.split("\n")
    starts = [n for n, line in enumerate(lines, 1) if line.startswith("def")]
    draw = random.Random(5)
    claims = [(i, "r", draw.choice(["a.py", "a.py", "b.css", "gone.py"]), draw.randrange(-2, 90), draw.randrange(-2, 90)) for i in range(200)]
    spans = validation.function_spans(files)
    got = validation.containing_functions(spark.createDataFrame(claims, "id int, repo string, path string, start_line int, end_line int"), spans)

    def holder(line):
        below = [k for k, s in enumerate(starts) if s <= line]
        return below[-1] if below and line <= len(lines) - 1 else None

    for r in got.collect():
        found = [h for h in (holder(r["start_line"]), holder(r["end_line"])) if h is not None] if r["path"] == "a.py" else []
        assert (r["within"] and r["within"]["fn_index"]) == (min(found) if found else None), r


def test_branches_of_line_ranges(spark):
    """Marks of a file give the same counts as scanning the lines themselves."""
    draw = random.Random(6)
    parts = [*K.VALIDATION_BRANCH_TOKENS, "if", "for", " ", "x", " if", "if ", "&", "|", "\x01", "É", "el"]
    rows = []
    for _ in range(60):
        held = ["".join(draw.choice(parts) for _ in range(draw.randrange(8))) for _ in range(draw.randrange(1, 12))]
        a = draw.randrange(len(held) + 1)
        rows.append((held, a, draw.randrange(a, len(held) + 1)))
    df = spark.createDataFrame(rows, "lines array<string>, a int, b int")
    marks = text.branch_marks(F.col("lines"), K.VALIDATION_BRANCH_TOKENS)
    found = text.branches_until(marks, F.col("b")) - text.branches_until(marks, F.col("a"))
    for r in df.select("*", found.alias("n")).collect():
        shown = "\n".join(r["lines"][r["a"] : r["b"]]).lower()
        assert r["n"] == sum(shown.count(t) for t in K.VALIDATION_BRANCH_TOKENS), r


def test_patterns_count_as_the_tokens_do():
    import re

    draw = random.Random(7)
    for tokens in (K.BRANCH_TOKENS, K.VALIDATION_BRANCH_TOKENS, ("aa", "ab", "ba", " a ", "b")):
        patterns = text.branch_patterns(tokens)
        parts = [*tokens, "if", "a", "b", " ", "x", "&", "el"]
        for _ in range(2000):
            s = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 12)))
            assert sum(len(re.findall(p, s)) for p in patterns) == sum(s.count(t) for t in tokens), (s, patterns)


def claims_report(spark, methods):
    doc = json.dumps({"project_name": "t", "key_modules": [{"module_name": "m", "paths": ["a.py"], "key_methods": methods}]})
    return reports.parse_reports(spark.createDataFrame([(1, doc)], "report_id int, raw string")).withColumn("repo", F.lit("r"))


def test_confidences_given_as_text(spark, tmp_path):
    ref = {"path": "a.py", "start": 1, "end": 2}
    given = ["0.8", 0.7, "high", None, True]
    methods = [{"name": str(k), "confidence": c, "source_ref": ref} for k, c in enumerate(given)]
    files = spark.createDataFrame([("r", "a.py", b"def f(x):\n    pass\n")], "repo string, path string, content binary")
    found = validation.validate(claims_report(spark, methods), files, str(tmp_path / "v")).methods
    assert [r[0] for r in found.orderBy("method_pos").select("confidence_adjusted").collect()] == [0.85, 0.75, 0.55, 0.55, 0.55]


def test_doubled_files_move_alone(spark):
    rows = [("r", "a", b"1"), ("r", "a", b"2"), ("r", "b", b"3"), (None, "c", b"4"), (None, "c", b"5"), ("r", None, None)]
    files = spark.createDataFrame(rows, "repo string, path string, content binary")
    got = ranking.single_files(files).collect()
    assert sorted((r["repo"] or "", r["path"] or "", r["content"] and bytes(r["content"])) for r in got) == [("", "c", b"5"), ("r", "", None), ("r", "a", b"2"), ("r", "b", b"3")]
    single = files.where("path = 'b'")
    assert ranking.single_files(single) is single  # nothing is shuffled


def test_without_hot_keys_the_join_is_plain(spark):
    left = spark.range(100).select("id", (F.col("id") % 50).alias("k"))
    right = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert "_salt" not in plan_of(skew_join(left, right, ["k"], hot_rows=10))
    nulls = left.withColumn("k", F.when(F.col("id") < 60, F.col("k")))
    joined = skew_join(nulls, right, ["k"], hot_rows=10)
    assert "_salt" in plan_of(joined) and joined.count() == 100 and joined.where("v is null").count() == 40
