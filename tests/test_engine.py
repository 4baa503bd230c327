"""Parsers and the whole engine on a small tree of its own."""

from __future__ import annotations

import json
import subprocess

import pytest

from quarry.engine import Engine
from quarry.plans import report
from quarry.sources.git import parse_log
from quarry.sources.parsers import call_name, parse_source

FILES = {
    "app.py": '''import os
from core.store import Store


def load_user(name):
    """Reads one user."""
    with open(name) as f:
        return f.read().strip()


def process(items, limit=3):
    total = 0
    for x in items:
        if x > limit and x < 9 or x == 0:
            total += 1
        elif x < 0:
            total -= 1
        else:
            if total:
                total = process([x], limit)
    return total


def unused_helper():
    pass


def main():
    print(process([1]), load_user("a"), load_user("b"))
''',
    "core/store.py": "class Store:\n    def save(self, key: str, *, deep=True):\n        return helper(key)\n\n\ndef helper(x):\n    return x + 1\n\n\ndef get():\n    return helper(2)\n",
    "web/mod.ts": """import { x } from "./store";
export function getUser(id: number): string {
  if (id > 3 && id < 9) { return fetch(id).toString(); } else { return id ? "a" : "b"; }
}
export const runAll = (a, b) => { for (const q of a) { getUser(q); } return b; };
class K { private step(z: number) { while (z) { z--; } return this.step(z); } }
function unusedTs() {}
""",
    "lib.rs": """use std::fs;
// A ledger.
pub struct Ledger { n: i32 }
impl Ledger {
    pub fn total(&self, p: &str, k: usize) -> i32 {
        match k { 0 => 1, 1 if k > 0 || p.len() > 2 => 2, _ => { for i in 0..3 { aid(i); } 3 } }
    }
}
fn aid(i: i32) -> Vec<u8> { if i > 1 { fs::read("x").unwrap() } else if i < 0 { Vec::<u8>::new() } else { vec![] } }
#[cfg(test)]
mod tests { #[test] fn checks() { aid(1); } fn near() { aid(2); } }
fn main() { let l = Ledger { n: 1 }; l.total("a", 2); }
""",
    "tests/test_app.py": "def test_it():\n    process([1])\n",
    "__init__.py": "",
    "broken.py": "def (:\n",
    "node_modules/skip.js": "function no() {}\n",
    "old.gen.py": "def ignored(): pass\n",
    ".gitignore": "*.gen.py\n",
}


def parsed(name):
    suffix = "." + name.rsplit(".", 1)[1]
    language = {".py": "python", ".ts": "typescript", ".rs": "rust"}[suffix]
    out = parse_source(language, suffix, FILES[name].encode())
    return {s.name: s for s in out.symbols}, [(c["owner"], c["callee"]) for c in out.calls], out.import_modules


def test_python_parser():
    symbols, calls, modules = parsed("app.py")
    p = symbols["process"]
    assert (p.cyclomatic, p.cognitive, p.nesting, p.nargs) == (9, 12, 3, 2)
    assert symbols["load_user"].docstring == "Reads one user." and symbols["main"].is_entry and symbols["main"].signature == "def main()"
    assert calls.count(("load_user", "read")) == 2 and ("process", "process") in calls
    assert modules == ["os", "core", "core", "Store"]
    symbols, _, _ = parsed("core/store.py")
    assert symbols["save"].kind == "method" and symbols["save"].signature.startswith("class Store: def save(") and symbols["save"].nargs == 2
    assert parse_source("python", ".py", FILES["broken.py"].encode()).symbols == []


def test_typescript_parser():
    symbols, calls, modules = parsed("web/mod.ts")
    assert set(symbols) == {"getUser", "runAll", "step", "unusedTs"} and modules == ["./store"]
    assert (symbols["getUser"].cyclomatic, symbols["getUser"].cognitive) == (4, 5)
    assert calls.count(("getUser", "fetch")) == 2 and calls.count(("runAll", "getUser")) == 2 and calls.count(("step", "step")) == 1
    assert symbols["runAll"].signature == "const runAll = ..."


def test_rust_parser():
    symbols, calls, modules = parsed("lib.rs")
    assert symbols["Ledger"].kind == "struct" and symbols["Ledger"].docstring == "A ledger." and modules == ["use std::fs;"]
    assert (symbols["total"].cyclomatic, symbols["total"].nargs, symbols["total"].is_public) == (7, 2, True)
    assert symbols["checks"].is_test and symbols["near"].is_test and not symbols["aid"].is_test and symbols["main"].is_entry
    assert calls.count(("aid", "read")) == 2 and ("main", "total") in calls


@pytest.mark.parametrize("text,name", [("a.b.c", "c"), ("std::fs::read", "read"), ("Vec::<Vec<u8>>::new", "new"), ("a(x).b", "a"), ("x[0]", ""), ("", "")])
def test_call_names(text, name):
    assert call_name(text) == name


def test_parsers_survive_anything():
    for language in ("python", "typescript", "rust"):
        for text in (b"", b"\xff\xfe\x00", b"((((((", b"}}}}", b"fn f(", b"class A {", b"const x = ", b"'" * 50, b"if if if", b"fn a() { match x { " * 30):
            parse_source(language, ".x", text)


def test_git_log_parser():
    rows = parse_log("---\nabc\nAnn\n100\n1\t2\ta.py\n-\t-\tb.png\n\n---\ndef\n\nbad\n3\t0\tc.py\n")
    assert rows.values.tolist() == [["abc", "Ann", 100, 1, 2, "a.py"], ["def", "", 0, 3, 0, "c.py"]]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(3):
        (root / "app.py").write_text(FILES["app.py"] + f"# {i}\n")
        (root / "lib.rs").write_text(FILES["lib.rs"] + f"// {i}\n")
        git("add", "-A")
        git("commit", "-qm", f"c{i}")
    engine = Engine(spark, str(root))
    engine.summary = engine.scan(git=True)
    return engine


def test_scan_and_rescan(engine):
    assert engine.summary["files"] == 7 and engine.summary["parsed"] == 7 and engine.summary["git"]["commits"] == 3
    churn = {r["relpath"]: r["churn"] for r in engine.files.collect()}
    assert churn["app.py"] > 0 and "old.gen.py" not in churn and "__init__.py" in churn
    with open(f"{engine.root}/core/store.py", "a") as f:
        f.write("\n\ndef later():\n    return 1\n")
    again = engine.scan(git=True)
    assert (again["parsed"], again["reused"]) == (1, 6)
    assert engine.symbols.filter("name = 'later'").count() == 1 and engine.symbols.filter("name = 'process'").count() == 1


def test_questions(engine, tmp_path):
    dead = {r["name"] for r in engine.dead()["symbols"].collect()}
    assert {"unused_helper", "unusedTs"} <= dead and "load_user" not in dead
    assert {r["reason"] for r in engine.dead()["hollow"].filter("name = 'unused_helper'").collect()} == {"empty_body"}
    assert {"main", "process"} <= {r["name"] for r in engine.rank(3).collect()}
    cut = engine.slice("main")
    assert cut["error"].startswith("ambiguous") and len(cut["candidates"]) == 2 and cut["blast_radius"] == 0
    assert engine.slice("nothing")["error"] == "symbol not found"
    cut = engine.slice("app.py::main")
    assert {s["name"] for s in cut["symbols"]} == {"main", "process", "load_user"} and cut["effects"] == ["filesystem"] and "print" in cut["unresolved_callees"]
    cut = engine.slice("process")
    assert [t["name"] for t in cut["tests"]] == ["test_it"] and cut["taint"]["params"] == ["items", "limit"]
    assert {c["name"] for c in engine.slice("Ledger")["callers"]} == {"main"}
    assert engine.similar_to("nothing") == {"error": "symbol not found"} and engine.similar_to("process").count() <= 10
    assert engine.sql("select count(*) as n from symbols where is_test").first()["n"] >= 3


def test_reports(engine, tmp_path):
    dest = engine.report(str(tmp_path))
    assert {"report.html", "index.json", "rank.json", "agent.json", "heatmap.svg", "data"} <= {p.name for p in dest.iterdir()}
    assert json.loads((dest / "agent.json").read_text())["must_read"]
    assert "</script><" not in (dest / "report.html").read_text().split('type="application/json">')[1].split("</script>")[0]
    assert engine.report(str(tmp_path), refresh=True) == dest and report.newest_report_dir(str(tmp_path)) == dest
    pack = engine.review(str(tmp_path / "r"), "process")
    assert pack["sessions"] and pack["behavior"]["root"]["name"] == "process"
    assert engine.labels(str(tmp_path / "l.csv")) == len((tmp_path / "l.csv").read_text().splitlines()) - 1
    profile = tmp_path / "p.json"
    profile.write_text('{"nodes":[{"callFrame":{"functionName":"process"},"hitCount":7}]}')
    assert engine.ingest_profile(str(profile))["mapped"] == 1
    assert {r["relpath"]: r["profile_total"] for r in engine.files.collect()}["app.py"] == 7.0


def test_history_and_names_are_found_anew(engine):
    before = {r["relpath"]: r["churn"] for r in engine.history()["hot_files"].collect()}
    with open(f"{engine.root}/app.py", "a") as f:
        f.write("\n# one more line\n" * 5)
    call = ["git", "-C", engine.root, "-c", "user.name=N", "-c", "user.email=n@example.org"]
    subprocess.run([*call, "commit", "-qam", "more"], check=True)
    after = {r["relpath"]: r["churn"] for r in engine.history()["hot_files"].collect()}
    assert after["app.py"] == before["app.py"] + 10
    stored = {r["relpath"]: r["churn"] for r in engine.files.collect()}
    assert stored["app.py"] == before["app.py"]  # without another scan
    kinds = lambda df: sorted((r["relpath"], r["ord"], r["kind"]) for r in df.collect())
    assert kinds(engine.names()) == kinds(engine.table("name_flags").join(engine.symbols.select("relpath", "ord"), ["relpath", "ord"]))
    assert {r["relpath"] for r in engine.file_rank().collect()} == set(stored)


def test_a_scan_out_of_time_keeps_what_it_had(engine):
    known = {(r["relpath"], r["name"]) for r in engine.symbols.collect()}
    digest = {r["relpath"]: r["digest"] for r in engine.files.collect()}
    with open(f"{engine.root}/core/store.py", "a") as f:
        f.write("\n\ndef too_late():\n    return 2\n")
    summary = engine.scan(git=True, budget_seconds=0)
    assert (summary["parsed"], summary["late"] >= 1) == (0, True)
    assert {(r["relpath"], r["name"]) for r in engine.symbols.collect()} == known
    assert {r["relpath"]: r["digest"] for r in engine.files.collect()} == digest
    again = engine.scan(git=True, budget_seconds=600, model="quarry.functions.vectors:stub_vector")
    assert again["parsed"] >= 1 and again["late"] == 0 and again["model"] == "quarry.functions.vectors:stub_vector"
    assert engine.symbols.filter("name = 'too_late'").count() == 1


def test_views(engine, capsys):
    from quarry.__main__ import _show

    _show({"issues": [{"a": i, "b": "x" * i} for i in range(40)], "unresolved_callees": [str(i) for i in range(30)]}, False)
    out = capsys.readouterr().out
    assert "  14  " in out and "  15  " not in out and "11, ... and more" in out
    _show({"files": engine.files, "n": 1, "none": []}, True)
    told = json.loads(capsys.readouterr().out)
    assert len(told["files"]) == engine.files.count() and told["none"] == []


def test_reset(engine):
    engine.reset()
    assert engine.files.count() == 0 and engine.table("meta").count() > 0
    assert engine.scan()["parsed"] == 7


def test_stream_tags(spark, tmp_path):
    from quarry.streaming.watch import churn_windows, tag_stream

    source = tmp_path / "in"
    spark.createDataFrame([("a.py", "with open(p) as f: pass")], "relpath string, content string").write.parquet(str(source))
    stream = spark.readStream.schema("relpath string, content string").parquet(str(source))
    q = tag_stream(stream).writeStream.format("memory").queryName("tagged").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select effects, language from tagged").first().asDict() == {"effects": ["filesystem"], "language": "python"}
    log = tmp_path / "log"
    spark.createDataFrame([("c", "a", 100, 1, 2, "x"), ("d", "a", 90_000, 1, 0, "x")], "commit string, author string, ts long, added long, deleted long, path string").write.parquet(str(log))
    q = churn_windows(spark.readStream.schema("commit string, author string, ts long, added long, deleted long, path string").parquet(str(log))).writeStream.format("memory").queryName("churned").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["churn"] for r in spark.sql("select churn from churned").collect()) == [1, 3]
