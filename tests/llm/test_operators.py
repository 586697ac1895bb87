"""Operators of the training-data pipeline against brute force, and on hard rows."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontamination, embedding_dedup, language, line_dedup, mixing, ngram_join, sharding, token_counts, token_output, url_filter
from codeloom.llm.components import components
from codeloom.llm.range_coder import decode_file, encode_file
from codeloom.llm.words_tokenizer import WordTokenizer, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, verdict string, row string, start long, draw int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HOT = " ".join(f"word{k}" for k in range(60))


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, 1, 2, "v", "r", 3, 4)


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns whose names operators use."""
    rows = [row(1, "the cat sat on the mat"), row(2, None), row(3, ""), row(4, " \n\t "), row(5, "the cat sat on the mat"),
            row(5, "the cat sat on the mat"), row(None, "le chat est sur la table", "fr", None), row(None, None, None, None),
            row(6, "x" * 40_000, None), row(7, "<|endoftext|> It's\x00 \u00c5 \U0001f600 a\u030a"), row(8, "123 456"), row(9, HOT), row(10, HOT + " more")]
    rows += [row(100 + k, HOT + f" tail{k % 3}") for k in range(30)]
    rows += [row(200 + k, "one two three\nfour five\nsix\nseven\n" + f"own line {k}", "en", "t") for k in range(5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern="[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(ids, linked):
    """Least id reachable, by merging classes."""
    label = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if label[a] != label[b] and linked(a, b):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for k, x in enumerate(label):
        if ids[k] is not None:
            least[x] = min(least.get(x, ids[k]), ids[k])
    return [least.get(x) for x in label]


def test_ngram_join(hard, none):
    rows = hard.select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    found = ngram_join.near_duplicates(hard).collect()
    key = lambda t: str(t)
    assert sorted([tuple(r) for r in found], key=key) == sorted([(r.doc_id, len(s), c) for r, s, c in zip(rows, sets, want, strict=True)], key=key)
    assert ngram_join.near_duplicates(none).count() == 0


def test_first_of_groups(hard, none):
    kept = ngram_join.first_of_groups(hard)
    assert kept.columns == hard.columns
    ids = [r.doc_id for r in kept.where("text like \'the cat%\' or text like \'word0%\'").collect()]
    assert sorted(ids) == [1, 9]
    assert kept.where("doc_id in (2, 3, 4)").count() == 3
    assert ngram_join.first_of_groups(none).count() == 0


def test_ngram_join_random(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 400, 60)] for _ in range(6)]
    rows = []
    for k in range(150):
        text = list(base[k % 6])
        for _ in range(int(rng.integers(0, 4))):
            text[int(rng.integers(0, 60))] = f"n{rng.integers(0, 50)}"
        rows.append((k, " ".join(text)))
    sets = [shingles(t) for _, t in rows]
    want = brute_components(list(range(150)), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k] for k in range(150)] == want


def test_prefixes_share_enough():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 2000, 5000).astype(float)
    for _ in range(200):
        a = np.sort(rng.choice(5000, 40, replace=False)).astype(np.uint64)
        b = np.unique(np.concatenate([a[: int(rng.integers(34, 41))], rng.choice(5000, 3).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            (p, x), (q, y) = (ngram_join.choose_prefix(s, counts[s.astype(int)], 50.0, 80) for s in (a, b))
            assert len(np.intersect1d(p, q)) >= min(x, y)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1)] + [(100 + k, 101 + k) for k in range(40)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**{k: 2 for k in (2, 3, 4, 5)}, 8: 8, 9: 8, **{100 + k: 100 for k in range(41)}}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 16))
    v = [(centre[k % 20] + rng.normal(size=16) * (0.02 if k % 3 else 1.0)).tolist() for k in range(500)]
    v += [v[0]] * 5 + [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [1.0] * 4, [2.0] * 4, []]
    ids = [*range(len(v) - 1), None]
    good = [x is not None and len(x) and all(y is not None and np.isfinite(y) for y in x) and any(x) for x in v]

    def linked(a, b):
        if not (good[a] and good[b] and len(v[a]) == len(v[b])):
            return False
        x, y = np.array(v[a]), np.array(v[b])
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9

    df = spark.createDataFrame([(i, x, 1, 2) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, node int, n long")
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    degree = {ids[a]: sum(linked(a, b) for b in range(len(v)) if a != b) for a in range(len(v))}
    assert sum(found[k].n_links for k in found) >= 0.99 * sum(degree.values())
    assert all(found[k].n_links <= degree[k] for k in found)
    want = brute_components(ids, linked)
    assert [found[i].component_id for i in ids] == want
    assert found[None].kept is None and found[0].kept
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(k, [float(k == j) for j in range(4)]) for k in range(4)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.kept) for r in embedding_dedup.near_vectors(alone).collect()} == {(0, True)}


def test_audit_is_not_drowned_and_not_empty(monkeypatch):
    """One query in a group of thousands, 70 with a link each that only a wider beam finds."""
    rng = np.random.default_rng(3)
    group = rng.normal(size=32) + rng.normal(size=(2_000, 32)) * 0.01
    pairs = np.repeat(rng.normal(size=(70, 32)), 2, axis=0) + rng.normal(size=(140, 32)) * 0.01
    nodes = pd.DataFrame({"dim": 32, "shard": 0, "node": np.arange(2_140), "copies": 1, "vector": list(np.concatenate([group, pairs]))})
    shard = embedding_dedup.build_shard(nodes)
    search = embedding_dedup.Graph.search

    def narrow(graph, queries, beam):
        ids, near = search(graph, queries, beam)
        lost = (near > 0.9).sum(axis=1) < 3
        if beam < 96:  # nothing but the query itself
            ids[lost, 1:], near[lost, 1:] = -1, -2
        return ids, near

    monkeypatch.setattr(embedding_dedup.Graph, "search", narrow)
    told = embedding_dedup.audit_shard(nodes.iloc[[0, *range(2_000, 2_140, 2)]], shard, 0.9)
    assert (told["node"] >= 2_000).all() and (told["truth"] == 1).all()
    seen = {b: (len(x), (x["found"] / x["truth"]).mean()) for b, x in told.groupby("beam")}
    assert seen[24] == (70, 0.0) and seen[96] == (70, 1.0)
    assert embedding_dedup.pick_beam(seen, False, False) == 96
    assert embedding_dedup.pick_beam({}, False, False) is None
    assert embedding_dedup.pick_beam({}, False, True) == 192 and embedding_dedup.pick_beam({}, True, True) == 24
    assert embedding_dedup.pick_beam({b: (70, 0.5) for b in (24, 48, 96, 192)}, False, False) > embedding_dedup.WIDEST


def test_token_files(hard, none, spark):
    tokenizer = WordTokenizer(vocabulary_path()).tokenizer
    found = token_output.write_tokens(hard, file_tokens=500).read(spark).orderBy("start").collect()
    want = sorted(tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in hard.collect())
    assert sorted(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in found) == want
    keys = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert keys == sorted(keys)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    assert token_output.write_tokens(none).read(spark).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 20_000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65_536, n), np.full(n, 7), np.tile(rng.integers(0, 100, 50), n // 50 + 1)[:n]):
        assert (decode_file(encode_file(ids.astype(np.uint16))) == ids).all()


def test_range_coder_finds_damage():
    data = bytearray(encode_file(np.arange(9000).astype(np.uint16)))
    data[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        decode_file(bytes(data))
    with pytest.raises(ValueError):
        encode_file(np.array([70_000]))


def test_word_ids_are_the_tokenizers():
    rng = np.random.default_rng(3)
    letters = np.array(list("aBcé '\n\t.,!<|>ß0９\x1c\u0130\u030a "))
    texts = [None, "", "<|endoftext|>", "<|ENDOFTEXT|>", *("".join(rng.choice(letters, 80)) for _ in range(200))]
    own = WordTokenizer(vocabulary_path(), spans=True)
    ids, sizes = own.encode(pa.array(texts, pa.string()))
    chars, _ = own.encode_spans(pa.array(texts, pa.string()))
    want = [own.tokenizer.encode(t or "", add_special_tokens=False) for t in texts]
    assert ids.tolist() == [i for e in want for i in e.ids]
    assert sizes.tolist() == [len(e.ids) for e in want]
    assert [tuple(c) for c in chars.tolist()] == [o for e in want for o in e.offsets]


def test_section_tokens(hard, none):
    sections = token_counts.head_body_tail(F.col("text"), 10)
    tokenizer = WordTokenizer(vocabulary_path()).tokenizer
    total = {(r.doc_id, r.text): len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in hard.where("doc_id is not null").collect()}
    for rule in token_counts.RULES:
        found = token_counts.section_tokens(hard, sections, rule=rule)
        assert found.agg(F.sum("n_tokens")).first()[0] == sum(total.values()) + total[5, "the cat sat on the mat"] + 6
    assert token_counts.section_tokens(none, sections).count() == 0


def test_allocation_rules():
    spans, owner = np.array([[0, 3], [3, 9]]), np.array([0, 0])
    first, starts, ends = np.array([0, 3]), np.array([0, 4, 6]), np.array([4, 6, 9])
    by = {r: token_counts.allocate(spans, owner, first, starts, ends, r) for r in token_counts.RULES}
    assert [by[r][0].tolist() for r in ("start", "end", "majority")] == [[2, 0, 0], [1, 0, 1], [1, 0, 1]]
    assert by["start"][1].tolist() == [1, 0, 0]


def test_shards(hard, none, spark):
    rows = sharding.shuffle_records(hard, 4).read(spark)
    found = rows.collect()
    assert sorted(str((r.doc_id, r.text)) for r in found) == sorted(str((r.doc_id, r.text)) for r in hard.collect())
    counts = np.bincount([r.shard for r in found], minlength=4)
    assert counts.max() - counts.min() <= 1
    for s in range(4):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))
    again = {(r.shard, r.slot): r.text for r in sharding.shuffle_records(hard, 4).read(spark).collect()}
    assert again == {(r.shard, r.slot): r.text for r in found}
    assert sharding.shuffle_records(none, 4).read(spark).count() == 0


def test_language(hard, none, spark):
    rows = [(k, " ".join(np.random.default_rng(k).choice("the and of that with is was for".split() if k % 2 else "le la et que dans est pour les".split(), 12).tolist()), "en" if k % 2 else "fr") for k in range(120)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = language.identify(hard, model)
    assert set(hard.columns) < set(found.columns)
    for r in found.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr") and 0 <= r.score <= 1
    told = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    held = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert held and all(told[k] == lang for k, lang in held)
    assert language.train(none) is None
    assert {r.lang_pred for r in language.identify(hard, None).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = language.Pieces([b" ", b"a", b"b", b"ab", b" a"])
    p = np.array([[0.1], [0.2], [0.3], [0.25], [0.15]])
    runs = np.frombuffer(b" ab", np.uint8)[None, :]
    alpha = language.forward(1, 3, pieces.matches(runs), p)
    assert alpha[-1, 0, 0] == pytest.approx(0.1 * 0.2 * 0.3 + 0.1 * 0.25 + 0.15 * 0.3)


def test_mix(hard, none):
    size = mixing.word_count(F.col("text"))
    rows = mixing.mix(hard, size).taken.collect()
    assert len(rows) == hard.count()
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    sizes = {}
    for r in hard.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    for source, total in sizes.items():
        own = [r for r in rows if r.source == source]
        assert all(r.source_size == total for r in own)
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.05, abs=2)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(str, mixing.mix(hard, size).taken.collect())) == sorted(map(str, rows))
    assert mixing.mix(none, size).taken.count() == 0 and mixing.take_whole(none).count() == 0
    assert mixing.take_whole(hard).columns == hard.columns


def test_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 0)], "source string, size long")
    found = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert found == {"a": 960.0, "b": 30.0, "c": 30.0, None: 0.0}


def test_quotas_of_shards_add_up(spark):
    plan = spark.createDataFrame([("a", 37), ("b", 5), (None, 0)], "source string, quota long")
    found = mixing.shard_quotas(plan, 4).groupBy("source").agg(F.sum("blocks").alias("n"), (F.max("blocks") - F.min("blocks")).alias("d")).collect()
    assert {r.source: r.n for r in found} == {"a": 37, "b": 5, None: 0} and all(r.d <= 1 for r in found)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://NET/", "https://a.example.net/en/x?q", "http://example.net/en", "http://xexample.com/de/", "http://example.com/de/#a",
            "http://b.org/fr/login", "http://b.org/login", "http://net", "://net/", "http://ads.shop.com/x", "http://x.com/shop/cart/1"]
    found = {r.url: (r.host, r.path, r.matched, r.verdict) for r in url_filter.judge(spark.createDataFrame([(u, 1, "z") for u in urls], "url string, path int, verdict string")).collect()}
    assert found[None] == found[""] == found["no scheme"] == ("", "", None, "allow")
    assert found["http://NET/"] == ("net", "/", "net/", "block")
    assert found["https://a.example.net/en/x?q"] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert found["http://example.net/en"][2:] == ("net/", "block")
    assert found["http://xexample.com/de/"][2] is None
    assert found["http://example.com/de/#a"][2:] == ("example.com/de/", "block")
    assert found["http://b.org/fr/login"][2:] == ("org/fr/", "allow")
    assert found["http://b.org/login"][2:] == ("login page", "block")
    assert found["http://net"][2] is None and found["://net/"][2] == "net/"
    assert found["http://ads.shop.com/x"][3] == "block" and found["http://x.com/shop/cart/1"][3] == "block"


def test_open_ended_runs_are_no_tokens():
    assert url_filter.site_rule("example.net/foo", "block").tokens == ("example", "net")
    index, free = url_filter.index_rules(url_filter.SITE_RULES, {"net": 9, "example": 9, "en": 1})
    assert index["en"][0].name == "example.net/en/" and not free


def brute_hits(text, items):
    pattern = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, ids = words(text, pattern), set(), set()
    for item, t in items:
        b = words(t, pattern)
        k = min(13, len(b))
        grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                ids.add(str(item))
    return len(w), len(hit), len(ids)


@pytest.mark.parametrize("set_bytes", [1 << 20, 300])
def test_decontamination(hard, none, spark, set_bytes):
    items = [(1, " ".join(f"word{k}" for k in range(20, 40))), (2, "the CAT sat"), (3, ""), (4, None), (2, "six; seven"), (5, "Le chat")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(hard, bench, set_bytes=set_bytes).collect()
    want = [(r.doc_id, *brute_hits(r.text, items)) for r in hard.collect()]
    assert sorted([str((r.doc_id, r.n_words, r.n_hit, r.n_items)) for r in found]) == sorted(map(str, want))
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found)
    kept = decontamination.decontaminate(hard, bench, set_bytes=set_bytes)
    assert kept.columns == hard.columns and kept.count() == sum(not r.contaminated for r in found)
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(hard, bench, action="cut", set_bytes=set_bytes).collect()}
    assert cut[1] == " on the mat" and cut[2] is None
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(hard, bench.limit(0)).where("n_hit > 0").count() == 0


def test_line_dedup(hard, none):
    out = line_dedup.dedup_lines(hard)
    assert set(out.columns) == {*hard.columns, "n_deleted"}
    found = {r.doc_id: r for r in out.collect()}
    assert found[200].n_deleted == 0 and found[203].text == "own line 3" and found[203].n_deleted == 4
    assert found[9].n_deleted == 0 and found[103].n_deleted == 1 and found[103].text == ""
    assert (found[2].text, found[2].n_lines, found[3].n_lines) == (None, 0, 1)
    assert line_dedup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("set_bytes", [1 << 20, 80])
def test_items_without_id_hit(spark, set_bytes):
    bench = spark.createDataFrame([(None, "the cat sat"), (None, "on the mat"), (7, "cat sat on")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the cat sat"), (3, "dog")], "doc_id long, text string")
    found = {r.doc_id: r for r in decontamination.contamination(docs, bench, set_bytes=set_bytes).collect()}
    assert [(found[k].n_hit, found[k].n_items, found[k].contaminated) for k in (1, 2, 3)] == [(6, 2, True), (3, 1, True), (0, 0, False)]
    assert [found[k].items_sha256 for k in (1, 2)] == [hashlib.sha256(x).hexdigest() for x in (b"7", b"")]
    assert [r.doc_id for r in decontamination.decontaminate(docs, bench, set_bytes=set_bytes).collect()] == [3]


def brute_later_lines(texts, least_lines, least_words):
    """(text, line) in a later copy of any run of enough words or lines; no line is without words."""
    gone, seen = set(), set()
    for d, text in enumerate(texts):
        lines = text.split("\n")
        for n in range(len(lines)):
            for to in range(n + 1, len(lines) + 1):
                run, size = tuple(lines[n:to]), sum(len(words(x)) for x in lines[n:to])
                if run in seen and (size >= least_words or to - n >= least_lines):
                    gone.update((d, k) for k in range(n, to))
                seen.add(run)
    return gone


@pytest.mark.parametrize("least_lines", [1, 4, 8])
def test_line_runs_of_every_length(spark, least_lines):
    rng = np.random.default_rng(least_lines)
    lines = [" ".join(f"w{k}x{j}" for j in range(rng.integers(1, 30))) for k in range(60)]
    long = [" ".join(f"v{k}x{j}" for j in range(20)) for k in range(3)]
    texts = ["\n".join([*long, f"own {k}"]) for k in range(2)]
    runs = [[lines[k] for k in rng.integers(0, len(lines), size)] for size in range(1, 10) for _ in range(2)]
    for k in range(30):
        parts = [[f"mine {k} {j}", *runs[i]] for j, i in enumerate(rng.integers(0, len(runs), 3))]
        texts.append("\n".join(x for part in parts for x in part))
    gone = brute_later_lines(texts, least_lines, 50)
    assert {(1, 0), (1, 1), (1, 2)} <= gone
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, least_lines=least_lines).collect()}
    for d, text in enumerate(texts):
        assert found[d] == "\n".join(x for n, x in enumerate(text.split("\n")) if (d, n) not in gone)
