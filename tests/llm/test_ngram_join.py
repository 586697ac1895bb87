"""Near copies of one text that are not similar to each other: crowded lists, compared in tiles."""

import itertools

import numpy as np
import pytest
from test_operators import brute_components, shingles

from codeloom.llm import ngram_join


def near_copies(marks, singles):
    """Copies of 120 words with two words changed, for every two of ``marks`` places; one word for the first ``singles``."""
    base = [f"word{k}" for k in range(120)]
    texts = []
    for places in [*itertools.combinations(range(marks), 2), *((k,) for k in range(singles))]:
        own = list(base)
        for k in places:
            own[6 * k + 5] = f"new{len(texts)}at{k}"
        texts.append(" ".join(own))
    return list(enumerate(texts, 1))


def written(monkeypatch):
    """Rows of each table that the join writes."""
    rows, real = {}, ngram_join.staged

    def staged(df, name):
        out = real(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "staged", staged)
    return rows


def test_crowded_lists_make_no_pairs(spark, monkeypatch):
    rows = written(monkeypatch)
    found = ngram_join.near_duplicates(spark.createDataFrame(near_copies(19, 0), "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in found) and len(found) == 171
    assert rows.get("met", 0) < 2_000  # of 14,535 pairs of texts, all on shared tokens


@pytest.mark.parametrize("tile", [16, 2048])
def test_crowded_lists_keep_all_links(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "CROWD", 30)
    monkeypatch.setattr(ngram_join, "TILE_NODES", tile)
    # no star finds a link, so all links between components are left to the lists
    monkeypatch.setattr(ngram_join, "star_pairs", lambda posts, percent: posts.select("node", "n").where("false").toDF("a", "b"))
    rows = near_copies(12, 4) + [(1000 + k, f"word5 word6 word7 word8 word9 tail{k} " + "end " * k) for k in range(20)]
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in rows]
    want = brute_components([k for k, _ in rows], lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert [found[k] for k, _ in rows] == want


def test_shared_counts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 5_000, n).astype(np.uint64)) for n in (1, 7, 300, 2_000, 4_000, 50)]
    want = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:4]]
    assert ngram_join.shared_counts(sets[:4], sets[2:]).tolist() == want
