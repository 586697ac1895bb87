"""Which rows validation moves: narrow ones, each once; and that rows of repeated or unnamed keys stay right."""

import pathlib

from conftest import SMALL
from test_validated_moves import _fixed, _one_report, _plan

from pyspark.sql import functions as F

from codeloom.operators import validation
from codeloom.plans import queries

REF = "source_ref:struct<path:string,start:string,end:string>"
MODULES = (
    "array<struct<module_name:string,path:string,paths:array<string>,lines:struct<start:string,end:string>,"
    f"key_methods:array<struct<name:string,confidence:double,{REF}>>>>"
)


def _files(spark, *rows):
    return spark.createDataFrame([*rows], "repo string, path string, content binary")


def test_methods_are_not_moved_to_learn_a_path(spark, tmp_path):
    reports, files = _one_report(spark)
    placed = validation.placed_modules(reports, files, str(tmp_path / "run"))
    assert "key_methods" not in spark.read.parquet(str(tmp_path / "run" / "modules")).columns
    plan = _fixed(spark, lambda: _plan(validation.method_claims(placed)))
    assert "Exchange" not in plan and "Join" not in plan
    rows = validation.method_claims(placed).orderBy("module_pos", "method_pos").collect()
    assert [(r["name"], r["cited_path"], r["start_line"], r["end_line"], r["confidence"]) for r in rows] == [
        ("f", "a.py", 1, 2, 0.5), ("g", "b.py", 1, 2, 0.5), ("g", "b.py", 1, 2, 0.5)
    ]


def test_citations_and_contents_are_moved_once(spark, tmp_path):
    """Also where all files have one repository by name."""
    reports, files = _one_report(spark)
    files = files.withColumn("repo", F.lit("r"))
    placed = validation.placed_modules(reports, files, str(tmp_path / "run"))
    claims = validation.method_claims(placed)
    key = ["report_id", "module_pos", "method_pos"]
    plan = _fixed(spark, lambda: _plan(validation.against_files(claims, files, validation.branch_facts, validation.cut_evidence, key)))
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "REPARTITION" in x]
    assert len(moved) == 1
    assert claims.count() == 3


def test_repeated_reports_and_claims_without_a_path(spark, tmp_path):
    """Two reports share an id; their claims take the path of their own module at the chosen place."""
    none = (None, "1", "1")
    one = [("m", None, ["gone.py", "a.py"], None, [("f", 0.5, none), ("g", 0.5, ("gone.py", "1", "1"))])]
    two = [("m", None, ["gone.py", "b.py"], None, [("h", 0.5, none)])]
    lost = [("m", None, ["a.py"], None, [("i", 0.5, none)])]
    reports = spark.createDataFrame([(1, "r", one), (1, "r", two), (None, "r", lost)], f"report_id long, repo string, key_modules {MODULES}")
    files = _files(spark, ("r", "a.py", b"of a\n"), ("r", "b.py", b"of b\n"), (None, "c.py", b"x\n"))
    found = validation.validate(reports, files, str(tmp_path / "run"))
    got = {r["name"]: (r["path"], r["evidence_snippet"], r["_validated"]) for r in found.methods.collect()}
    assert got == {"f": ("a.py", "of a", True), "g": ("gone.py", None, False), "h": ("b.py", "of b", True), "i": (None, None, False)}
    verdicts = sorted((r["report_id"] or 0, r["path"] or "", r["methods"], r["valid_methods"]) for r in found.modules.collect())
    assert verdicts == [(0, "", 0, 0), (1, "a.py", 3, 2), (1, "b.py", 3, 2)]


def test_files_without_a_name_are_cited_by_nobody(spark):
    files = _files(spark, (None, "a.py", b"one\n"), ("r", None, b"two\n"), ("r", "a.py", None), ("r", "b.py", b"three\n"))
    claims = spark.createDataFrame(
        [(1, None, "a.py", 1, 1), (2, "r", None, 1, 1), (3, "r", "a.py", 1, 1), (4, "r", "b.py", 1, 1), (4, "r", "b.py", 1, 1)],
        "id int, repo string, path string, start_line int, end_line int",
    )
    for hot_rows in (validation.CITED_ROWS, 1):
        found = validation.against_files(claims, files, validation.branch_facts, validation.cut_evidence, ["id"], hot_rows)
        assert sorted((r["id"], r["evidence_snippet"] or "") for r in found.collect()) == [(1, ""), (2, ""), (3, ""), (4, "three"), (4, "three")]
        assert found.columns[:5] == claims.columns


def test_warnings_travel_with_the_verdicts(spark, tmp_path):
    reports, files = _one_report(spark)
    found = validation.validate(reports, files, str(tmp_path / "run"))
    out = validation.validated_reports(reports, found.methods, found.modules)
    plan = _fixed(spark, lambda: _plan(out.select("report_id", "_validation_summary.warnings")))
    assert plan.count("collect_list(struct(module_pos") == 0
    told = {r["report_id"]: r["_validation_summary"]["warnings"] for r in out.collect()}
    text = "Method g could not be validated (path b.py)"
    assert told == {1: [text, text], 2: []}


def test_warnings_are_found_once(spark):
    """Evidence is not cut a second time to number the warnings."""
    assert "Generate inline" not in _plan(queries.REGISTRY["validation_warnings"](spark, SMALL))


def test_the_report_sink_is_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "run_folder", lambda spark, name: str(tmp_path / name))
    assert queries.REGISTRY["report_json"](spark, SMALL).count() > 0
    parts = [p.name for p in pathlib.Path(tmp_path / "report_json").rglob("part-*")]
    assert parts and all(p.endswith(".json.gz") for p in parts)


def test_tasks_of_a_grouping_grow_with_its_rows(spark):
    from codeloom.session import by_key

    df = spark.range(100).withColumnRenamed("id", "k")
    assert by_key(df, ["k"], 1_000, 10).rdd.getNumPartitions() == 100
    assert "REPARTITION_BY_COL" in _plan(by_key(df, ["k"], 10, 10))
