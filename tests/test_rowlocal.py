"""Row-local operators against the plain Python statements, on random and literal text."""

import random

import pytest
from pyspark.sql import functions as F

import spec
from codeloom import constants as K
from codeloom.functions import paths, text
from codeloom.functions.confidence import adjust_confidence
from codeloom.operators import chunking
from codeloom.operators import functions as fn

PIECES = [
    "public ", "static ", "private\t", "int ", "List<String> ", "foo", "Bar_9", "(", ")", "{",
    "}", "\n", "\n\n", "  ", "\t", "def ", "function ", "class ", "final ", ":", ", a", " if ",
    " for ", "&&", "&&&", "||", "elif ", "else if", " while ", "catch ", "if", "x", ";", "=",
    "\x0c", "\x1d", "\xa0", " ", "\r", "é", "ß", "İ", "Σ", "😀", "public", "new X() {",
    "return y", "\n \n", "\ndef g(a):\n", "\npublic void h(int a) {\n", "\nf(x) {\n",
]


def random_text(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(n)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = [random_text(rng, rng.choice([5, 40, 400, 3000])) for _ in range(250)]
    dense = "".join(f"f{i}(x) {{\n" for i in range(600))
    long_line = "def f(a):\n" + "x" * 30_000 + "\n\n" + "y" * 7000
    blanks = "int a\n" + "\n" * 60 + " " * 30 + "public int f(a) {"
    return [*made, "", " ", "\n", "a", dense, long_line, blanks, " \n" * 60]


def test_long_blank_runs_stay_cheap(docs):
    """The plain pattern is cubic here, so there is no comparison, only the known result."""
    content = "int a\n" + "\n" * 20_000 + " " * 3000 + "public int f(a) {"
    (row,) = fn.find_functions(docs({"a.java": content})).collect()
    assert (row["name"], row["start_line"]) == ("f", 2)


def test_functions_match_plain_python(spark, docs, texts):
    for language, ext in (("java", "java"), ("python", "py"), ("js", "ts")):
        named = {f"{i}.{ext}": t for i, t in enumerate(texts)}
        rows = fn.find_functions(docs(named)).collect()
        got = {}
        for r in rows:
            got.setdefault(r["path"], []).append(
                (r["fn_index"], r["name"], r["signature"], r["start_idx"], r["start_line"],
                 r["loc"], r["cyclomatic"], r["body_short"])
            )
        for path, content in named.items():
            assert sorted(got.get(path, [])) == spec.functions(content, language), path


def test_profile_keeps_the_most_complex_functions(docs, texts):
    named = {f"{i}.java": t for i, t in enumerate(texts)}
    rows = {r["path"]: r for r in fn.profile_modules(docs(named)).collect()}
    assert set(rows) == {p for p, t in named.items() if t.strip()}
    for path, row in rows.items():
        found = spec.functions(named[path], "java")
        best = sorted(found, key=lambda f: (-f[6], -f[5]))[: K.TOP_FUNCTIONS]
        assert row["num_functions"] == len(found)
        assert [f["fn_index"] for f in row["top_functions"]] == [f[0] for f in best]
        assert [f["body_short"] for f in row["top_functions"]] == [f[7] for f in best]
        assert row["total_lines"] == named[path].count("\n") + 1


def test_languages_without_functions(docs):
    content = "public int f(int a) {\n"
    found = fn.profile_modules(docs({"a.css": content, "b.html": content, "c": content}))
    assert {(r["language"], r["num_functions"]) for r in found.collect()} == {
        ("css", 0), ("html", 0), ("other", 0)
    }


@pytest.mark.parametrize("target", [20, 300, 1500])
def test_token_chunks_match_plain_python(docs, texts, target):
    named = {str(i): t for i, t in enumerate(texts)}
    column = chunking.token_chunks(F.col("content"), target)
    for row in docs(named).select("path", column.alias("c")).collect():
        assert row["c"] == spec.token_chunks(named[row["path"]], target), row["path"]


@pytest.mark.parametrize("size,overlap", [(1500, 270), (500, 500), (1000, 0), (90, 89), (7, 3)])
def test_fixed_chunks_match_plain_python(docs, texts, size, overlap):
    named = {str(i): t for i, t in enumerate(texts) if len(t) < 20_000 or size > 100}
    column = chunking.fixed_chunks(F.col("content"), size, overlap)
    for row in docs(named).select("path", column.alias("c")).collect():
        assert row["c"] == spec.fixed_chunks(named[row["path"]], size, overlap), row["path"]


def test_chunk_rows_have_index_and_hash(docs):
    import hashlib

    content = "class A\n" + "a" * 7000 + "\n\nclass B\n" + "b" * 10
    rows = chunking.chunk_files(docs({"p": content})).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["chunk_sha"] for r in rows)
    blank = chunking.chunk_files(docs({"p": ""}))
    assert blank.count() == 0


def test_no_python_in_row_local_plans(docs):
    frame = docs({"a.java": "x"})
    for out in (fn.find_functions(frame), fn.profile_modules(frame), chunking.chunk_files(frame)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan


def test_text_functions(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = frame.select(
        "i", text.strip(F.col("t")).alias("strip"), text.line_count(F.col("t")).alias("lines"),
        text.split_lines(text.normalise_newlines(F.col("t"))).alias("split"),
        text.cyclomatic(F.col("t")).alias("cc"), text.token_estimate(F.col("t")).alias("tokens"),
        text.line_of_offset(F.col("t"), F.lit(17)).alias("line"),
    ).collect()
    for r in rows:
        t = texts[r["i"]]
        assert r["strip"] == t.strip()
        assert r["lines"] == t.count("\n") + 1
        assert r["split"] == t.replace("\r\n", "\n").replace("\r", "\n").splitlines()
        assert r["cc"] == spec.branches(t)
        assert r["tokens"] == -(-len(t) // 4)
        assert r["line"] == t[:17].count("\n") + 1


def test_slice_lines(spark):
    frame = spark.createDataFrame(
        [(1, 2, "1\n2"), (-3, 1, "1"), (2, 1, ""), (4, 99, "4\n5"), (6, 9, ""), (2, 4, "2\n3\n4")],
        "s int, e int, want string",
    )
    lines = F.array(*[F.lit(str(i)) for i in range(1, 6)])
    for r in frame.withColumn("got", text.slice_lines(lines, F.col("s"), F.col("e"))).collect():
        assert r["got"] == r["want"], r


def test_decoding(spark):
    rng = random.Random(3)
    raw = [b"ok \xc3\xa9", b"\x80\x81\x82", b"a\r\nb\r", b"", "€".encode()]
    raw += [bytes(rng.randrange(256) for _ in range(rng.randrange(12))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(raw)), "i int, b binary")
    content, codec = text.decode_source(F.col("b"))
    lossy = text.decode_lossy(F.col("b"))
    for r in frame.select("i", content.alias("t"), codec.alias("c"), lossy.alias("l")).collect():
        b = raw[r["i"]]
        try:
            want, name = b.decode("utf-8"), "utf-8"
        except UnicodeDecodeError:
            want, name = b.decode("latin-1"), "latin-1"
        fold = lambda s: s.replace("\r\n", "\n").replace("\r", "\n")
        assert (r["t"], r["c"]) == (fold(want), name)
        assert r["l"] == fold(b.decode("utf-8", errors="replace"))


def test_paths(spark):
    rows = [
        ("a.py", ".py", False, "python"), ("x/.eslintrc.json", ".json", False, "other"),
        ("x/.bashrc", "", False, "other"), ("d.e/f", "", False, "other"),
        ("A.B.JAVA", ".JAVA", False, "java"), (".git/a.py", ".py", True, "python"),
        ("x/.h/y.py", ".py", True, "python"), ("x/y.tar.gz", ".gz", False, "other"),
        ("noext", "", False, "other"), ("x/a.", "", False, "other"), ("w/i.HTM", ".HTM", False, "html"),
    ]
    frame = spark.createDataFrame(rows, "path string, suffix string, hidden boolean, lang string")
    path = F.col("path")
    out = frame.select(
        "*", paths.suffix(path).alias("s"), paths.in_hidden_folder(path).alias("h"),
        paths.language(path).alias("l"),
    )
    for r in out.collect():
        assert (r["s"], r["h"], r["l"]) == (r["suffix"], r["hidden"], r["lang"]), r


def test_roles_take_the_first_hit(spark):
    want = {
        "a/UserController.java": ("controllers", 0), "a/service/RepoX.java": ("services", 1),
        "a/report.java": ("repositories", 2), "a/dao/X.java": ("repositories", 2),
        "dao/X.java": ("other", 5), "a/respository/X": ("repositories", 2),
        "a/Model.java": ("entities", 3), "a/author.java": ("security", 4), "x": ("other", 5),
    }
    frame = spark.createDataFrame([(p,) for p in want], "path string")
    for r in frame.select(
        "path", paths.role(F.col("path")).alias("r"), paths.role_rank(F.col("path")).alias("k")
    ).collect():
        assert (r["r"], r["k"]) == want[r["path"]]


def test_repo_names(spark):
    want = {
        "https://host/user/repo.git": "repo", "https://host/user/my.repo.git": "my.repo",
        "git@host:user/repo.git": "repo", "https://host/u/r?x=a/b.c#d/e": "r", "https://host": "",
        "https://host/.dot": ".dot",
    }
    frame = spark.createDataFrame([(u,) for u in want], "url string")
    for r in frame.select("url", paths.repo_from_url(F.col("url")).alias("n")).collect():
        assert r["n"] == want[r["url"]], r


def test_confidence(spark):
    rows = [
        (0.8, True, 5, 0.8), (0.8, False, None, 0.6), (0.8, True, 15, 0.6), (0.98, True, 3, 1.0),
        (None, True, 3, 0.55), (0.2, False, None, 0.2), (0.5, True, 20, 0.5),
    ]
    frame = spark.createDataFrame(rows, "c double, v boolean, b int, want double")
    out = frame.withColumn("got", adjust_confidence(F.col("c"), F.col("v"), F.col("b")))
    assert all(r["got"] == r["want"] for r in out.collect())


def test_summaries(spark):
    rows = [
        ("  first \n second", "Performs: first"), (" \n ", K.HEURISTIC_EMPTY),
        (None, K.HEURISTIC_EMPTY), ("x" * 200, "Performs: " + "x" * 140),
    ]
    frame = spark.createDataFrame(rows, "body string, want string")
    out = frame.withColumn("got", text.heuristic_summary(F.col("body")))
    assert all(r["got"] == r["want"] for r in out.collect())
    rows = [("a\nb ", "x", "a b"), ("", " d ", "d"), (None, None, K.SUMMARY_MISSING),
            (" ", "d", K.SUMMARY_MISSING)]
    frame = spark.createDataFrame(rows, "s string, d string, want string")
    out = frame.withColumn("got", text.summary_or_default(F.col("s"), F.col("d")))
    assert all(r["got"] == r["want"] for r in out.collect())


def test_prompt_body_and_hash(spark):
    import hashlib

    frame = spark.createDataFrame([("s", "```a```" + "b" * 900), ("s", None)], "s string, b string")
    rows = frame.select(
        text.prompt_body(F.col("b")).alias("p"), text.method_hash(F.col("s"), F.col("b")).alias("h")
    ).collect()
    assert rows[0]["p"] == "'```'a'```'" + "b" * 793
    assert rows[1]["p"] == "" and rows[1]["h"] == hashlib.sha256(b"s\n").hexdigest()
