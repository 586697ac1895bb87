"""Queries of a bucket are scored as matrix products, not as rows of pairs."""

import numpy as np
import pytest

from codeloom.operators import approximate, search


@pytest.mark.parametrize("hot_rows", [approximate.BUCKET_ROWS, 20])
def test_buckets_give_the_hits_of_joined_pairs(spark, tmp_path, monkeypatch, hot_rows):
    draw = np.random.default_rng(5)
    held = draw.normal(size=(500, 12)).astype("float32")
    held[50:90], held[7] = held[50], 0
    points = [(i, v.tolist()) for i, v in enumerate(held)]
    points += points[40:70] + [(None, held[60].tolist()), (3, held[200].tolist())]  # ids that come twice or are null
    asked = [(i, held[i].tolist()) for i in range(0, 120)] + [(900, None), (901, [1.0])]
    points = spark.createDataFrame(points, "id long, vector array<float>")
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    index = approximate.build_index(points, str(tmp_path / "i"), 12, tables=4, bits=4)
    joined = approximate.search_index(queries, index, 6, probes=5)
    want = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in joined.where("id is not null").collect())
    monkeypatch.setattr(approximate, "BROADCAST_PROBES", 1)
    found = approximate.search_index(queries, index, 6, probes=5, hot_rows=hot_rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert hot_rows == 20 or "Join" not in plan
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.where("id is not null").collect())
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) > 500
    assert all((a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 1e-12) for a, b in zip(got, want, strict=True))


def test_held_rows_are_not_sorted_for_every_tile(monkeypatch):
    draw = np.random.default_rng(6)
    queries, points = draw.normal(size=(500, 8)), draw.normal(size=(8000, 8))
    queries[3], points[17], points[4000:4040] = np.nan, 0, points[40]  # a zero query is no number
    merges = []
    plain = search._Nearest._merge
    monkeypatch.setattr(search._Nearest, "_merge", lambda self, *a: (merges.append(len(a[0])), plain(self, *a))[1])
    small, whole = (search._Nearest(np.vstack([queries[:3], queries[4:]]), 4, n) for n in (499 * 20, 499 * 8000))
    odd = search._Nearest(queries, 4, 500 * 20)
    small.add(np.arange(len(points)), points)
    tiled = len(merges)
    assert tiled < 100  # of 400 tiles
    for other in (whole, odd):
        other.add(np.arange(len(points)), points)
    assert small.ids.tolist() == whole.ids.tolist() and np.array_equal(small.scores, whole.scores)
    assert odd.ids[odd.q == 3].tolist() == [0, 1, 2, 3]
    assert odd.ids[odd.q != 3].tolist() == small.ids.tolist()
