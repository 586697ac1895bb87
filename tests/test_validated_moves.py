"""How often the rows of validated reports are moved, and the size of what is written of them."""

import gzip
import pathlib

from conftest import SMALL

from codeloom.operators import validation
from codeloom.plans import fixtures as fx
from codeloom.sources import reports as report_io


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _fixed(spark, body):
    """Run ``body`` where no join is a broadcast, as on large tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return body()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_items_of_a_report_are_moved_once(spark):
    plan = _fixed(spark, lambda: _plan(fx.reports(spark, SMALL)))
    assert plan.count("Exchange hashpartitioning(report_id") == 1
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "module_pos" in x]


def _one_report(spark):
    module = (
        "struct<module_name:string,path:string,paths:array<string>,lines:struct<start:string,end:string>,"
        "key_methods:array<struct<name:string,confidence:double,"
        "source_ref:struct<path:string,start:string,end:string>>>>"
    )
    method = ("f", 0.5, ("a.py", "1", "2"))
    gone = ("g", 0.5, ("b.py", "1", "2"))
    modules = [("m0", "a.py", None, None, [method, gone]), ("m1", "a.py", None, None, None), ("m2", "b.py", None, None, [gone])]
    reports = spark.createDataFrame([(1, "r", modules), (2, "r", None)], f"report_id long, repo string, key_modules array<{module}>")
    files = spark.createDataFrame([("r", "a.py", b"one\ntwo\nthree\n")], "repo string, path string, content binary")
    return reports, files


def test_modules_and_claims_are_read_a_fixed_few_times(spark, tmp_path, monkeypatch):
    """The wide modules are read for their candidates and once more; claims for counts and once more."""
    reports, files = _one_report(spark)
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            read.add(frame.num_rows)
            yield frame

    counted = reports.mapInArrow(seen, reports.schema)
    placed = validation.placed_modules(counted, files, str(tmp_path / "run"))
    assert read.value == 2 * reports.count()
    read.value = 0
    claims = validation.method_claims(placed)
    n = claims.count()
    found = validation.against_files(
        claims.mapInArrow(seen, claims.schema), files, validation.branch_facts, validation.cut_evidence,
        ["report_id", "module_pos", "method_pos"],
    )
    assert len(found.collect()) == n
    assert read.value <= 3 * n  # counts, rows with a path, rows without


def test_snippets_are_moved_once_and_written_small(spark, tmp_path):
    reports, files = _one_report(spark)
    found = validation.validate(reports, files, str(tmp_path / "run"))
    out = validation.validated_reports(reports, found.methods, found.modules)
    plan = _fixed(spark, lambda: _plan(validation.validated_reports(reports, found.methods, found.modules)))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(report_id" in line and "module_pos" in line]
    assert not moved
    report_io.write_validated(out, str(tmp_path / "json"))
    parts = [p for p in pathlib.Path(tmp_path / "json").iterdir() if p.name.startswith("part-")]
    assert b"one" in b"".join(gzip.open(p).read() for p in parts)
    rows = {r["report_id"]: r for r in spark.read.schema(out.schema).json(str(tmp_path / "json")).collect()}
    first, second, third = rows[1]["key_modules"]
    assert [m["evidence_snippet"] for m in first["key_methods"]] == ["one\ntwo", None]
    assert [m["_validated"] for m in (first, second, third)] == [True, False, False]
    assert first["example_snippet_actual"] == "one\ntwo\nthree" and third["example_snippet_actual"] is None
    assert second["key_methods"] == [] and rows[2]["key_modules"] == []
