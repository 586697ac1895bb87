"""Answers of many calls make one frame; of many missing texts copies are merged before they move."""

import json

import pandas as pd

from codeloom.operators import cache, inference


def test_answers_of_many_calls_make_one_frame():
    calls = []

    def describer(items):
        calls.append([x["hash"] for x in items])
        if "h30" in calls[-1]:
            raise ValueError("no")
        return json.dumps([{"hash": x["hash"], "summary": x["signature"] + x["body"]} for x in items if x["hash"] != "h2"])

    rows = pd.DataFrame({c: [f"{c[0]}{i}" for i in range(500)] for c in ("hash", "signature", "prompt", "body")})
    rows = rows.rename(columns={"hash": "sha"})
    found = list(inference.answered(iter([rows[:7], rows[7:]]), lambda: describer, 12, 0, 0))
    assert len(found) == 1 and [len(c) for c in calls] == [12] * 41 + [8]
    told = found[0].set_index("sha")
    assert list(told.index) == list(rows["sha"]) and list(told["body"]) == list(rows["body"])
    assert told["said"]["h499"] == "s499p499" and told["error"]["h2"] == inference.UNANSWERED
    assert set(told.index[told["error"] == "ValueError: no"]) == {f"h{i}" for i in range(24, 36)}


def test_copies_are_merged_before_they_move(spark, monkeypatch):
    monkeypatch.setattr(cache, "BROADCAST_KEYS", 10)
    rows = [(f"{i % 50}", f"text {i % 50}") for i in range(200)] + [(None, "x")]
    asked = spark.createDataFrame(rows, "sha string, text string")
    known = spark.createDataFrame([(f"{i}", "v") for i in range(5)], "sha string, summary string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small keys would be pushed below the merge
    found = cache.misses(asked, known)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.index("Join LeftSemi") < plan.index("Aggregate")  # the join stands above the merge
    assert sorted((r["sha"], r["text"]) for r in found.collect()) == sorted((f"{i}", f"text {i}") for i in range(5, 50))
