from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import names, paths, tags, vectors


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_effects(spark):
    cases = {
        "with open(path) as f: pass": ["filesystem"],
        "let open = |x| x; open(y)": [],
        "const open = (x) => x;\nopen(a)": [],
        "open = make()\nopen(z)": [],
        "def f(open, y):\n    open(y)": [],
        "OpenOptions::new().open(p)": ["filesystem"],
        "fs.readFileSync(p)": ["filesystem"],
        "fs.remaining_days": [],
        'fetch("/users/")': [],
        "fetch(url)": ["network"],
        "self.query(x)": [],
        "cur.execute('x')": ["db"],
        "std::process::id()": [],
        "Command::new(x)": ["process"],
        "    global cache": ["global_mutate"],
        "# the global customer": [],
        "unsafe { eval(x) }": ["unsafe"],
        "raise Error": ["panic"],
        "the open door": [],
        None: [],
        "": [],
    }
    assert column(spark, list(cases), tags.effects) == list(cases.values())


def test_risks_and_cost(spark):
    assert column(spark, ["hashlib.sha256(password)", "x: Any", "parse(src); pickle.loads(b)", ""], lambda v: tags.risks(F.lit("f"), F.lit(""), v)) == [["auth", "crypto"], ["any_type"], ["parser", "unsafe"], []]
    assert column(spark, ["for x in y:\n  while z: open(f)", "", None], lambda v: tags.cost_hint(v)) == [4, 0, 0]


@pytest.mark.parametrize(
    "body,doc,reason",
    [("def f():\n    pass", "", "empty_body"), ("fn f() {}", "", "empty_body"), ("x = 1", "d" * 81, "doc_oversells"), ("raise NotImplementedError", "", "stub"), ("a = compute(1)\nreturn a", "", ""), (None, None, "empty_body")],
)
def test_hollow(spark, body, doc, reason):
    row = spark.createDataFrame([(body, doc)], "b string, d string").select(tags.hollow_reason("b", "d").alias("r")).first()
    assert row["r"] == reason


def test_names(spark):
    cases = {"get_user": ["user"], "UserModel": ["user", "model"], "HTTPServerV2_get_userID": ["http", "server", "v", "2", "user", "id"], "the-a set": [], "": []}
    assert column(spark, list(cases), names.tokenize) == list(cases.values())
    assert column(spark, ["UserModel", "load_user", "x", ""], lambda v: names.stem(names.tokenize(v))) == ["model", "load", "x", ""]
    assert column(spark, ["new", "Clone", "resolve"], names.is_generic) == [True, True, False]


def test_shingles(spark):
    assert column(spark, ["a b", "x1 x2 x3 x4 x5 x6", "x1 x2 x3 x4 x5 x1 x2 x3 x4 x5 x1", ""], lambda v: names.shingles(names.code_tokens(v))) == [["b"], ["x1 x2 x3 x4 x5", "x2 x3 x4 x5 x6"], ["x1 x2 x3 x4 x5", "x2 x3 x4 x5 x1", "x3 x4 x5 x1 x2", "x4 x5 x1 x2 x3", "x5 x1 x2 x3 x4"], []]


def test_contains_identifier(spark):
    rows = spark.createDataFrame([("let x: Ledger;", "Ledger"), ("Ledgers", "Ledger"), ("_Ledger", "Ledger"), ("a.b", "a.b"), ("axb", "a.b"), ("x", "")], "t string, i string")
    assert [r[0] for r in rows.select(names.contains_identifier(F.col("t"), F.col("i"))).collect()] == [True, False, False, True, False, False]


def test_paths(spark):
    files = ["a/tests/x.py", "test_a.py", "a_test.rs", "b.spec.ts", "a/contest.py", "Tests/q.PY"]
    assert column(spark, files, paths.is_test) == [True, True, True, True, False, True]
    assert column(spark, ["a.pyi", "b.JSX", "c.rs", "d.md", "Makefile", "a.b/c"], paths.language) == ["python", "typescript", "rust", None, None, None]
    assert column(spark, ["docs/a.py", "src/docs_view.rs", "x/README.md", "start-dev.sh", "Cargo.lock", "src/a.py"], paths.is_noise_partner) == [True, False, True, True, True, False]
    patterns = paths.ignore_patterns("*.log\n# x\nbuild/\nsrc/*.gen.py\n")
    assert column(spark, ["a/b.log", "build", "build/x", "src/q.gen.py", "src/q.py"], lambda v: paths.is_ignored(v, patterns)) == [True, True, False, True, False]


def test_three_decimals_round_the_double_as_c_does(spark):
    values = [m / n for n in (8.0, 16.0, 400.0, 1200.0, 2000.0) for m in range(int(min(n, 255)) + 1)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", vectors.three_decimals(F.col("v")).alias("x"))
    assert [r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])] == ["%.3f" % v for v in values]


def test_stub_vectors_are_whole_numbers_through_one_root(spark):
    text = "page 17"
    byte = list(hashlib.sha256(text.encode()).digest()) * 2
    norm = sum(x * x for x in byte) ** 0.5
    assert column(spark, [text], vectors.stub_doubles) == [[x / norm for x in byte]]
