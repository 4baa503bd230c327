"""Command line: python -m quarry COMMAND [--repo DIR] [--json]."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import tempfile

from quarry import __version__


#: Rows that a view shows; --json gives all.
SHOWN = {"issues": 15, "symbols": 25, "files": 25, "hollow": 25, "candidates": 20, "unresolved_callees": 12}
_HEAVY = ("embed_sig", "embed_doc", "embed_body", "body", "docstring", "fingerprint")


def _table(rows: list[dict], limit: int) -> None:
    """Rows in columns, at most so many, and how many more there are."""
    shown = [{k: str(v) for k, v in r.items()} for r in rows[:limit]]
    wide = {k: min(60, max(len(k), *(len(r[k]) for r in shown))) for k in (shown[0] if shown else {})}
    for r in [{k: k for k in wide}, *shown] if shown else []:
        print("  " + "  ".join(r[k][:w].ljust(w) for k, w in wide.items()).rstrip())
    if len(rows) > limit:
        print("  ... and more")


def _show(value, as_json: bool, name: str = "") -> None:
    from pyspark.sql import DataFrame

    limit = SHOWN.get(name, 25)
    if as_json:
        _emit(value)
        print()
    elif isinstance(value, DataFrame):
        _table([r.asDict(recursive=True) for r in value.drop(*_HEAVY).limit(limit + 1).collect()], limit)
    elif isinstance(value, list) and value and isinstance(value[0], dict):
        _table(value, limit)
    elif isinstance(value, list):
        print(", ".join(map(str, value[:limit])) + (", ... and more" if len(value) > limit else ""))
    elif isinstance(value, dict):
        for k, v in value.items():
            print(f"{k}:", end="\n" if isinstance(v, (DataFrame, dict)) or (isinstance(v, list) and v and isinstance(v[0], dict)) else " ")
            _show(v, False, k)
    else:
        print(value)


def _emit(value) -> None:
    """Strict JSON; tables are streamed a partition at a time."""
    from pyspark.sql import DataFrame

    if isinstance(value, DataFrame):
        print("[", end="")
        for i, r in enumerate(value.drop(*_HEAVY[:4]).toLocalIterator()):
            print(", " * (i > 0) + json.dumps(r.asDict(recursive=True), default=str), end="")
        print("]", end="")
    elif isinstance(value, dict):
        print("{", end="")
        for i, (k, v) in enumerate(value.items()):
            print(", " * (i > 0) + json.dumps(k), end=": ")
            _emit(v)
        print("}", end="")
    else:
        print(json.dumps(value, default=str), end="")


def _profiled(lang: str, pid: int | None, seconds: int, command: list[str], dest: str) -> str | None:
    """Runs or attaches a profiler; the reason if that can't be done."""
    if lang == "python":
        call = ["py-spy", "record", "--format", "speedscope", "--output", dest, *(["--pid", str(pid), "--duration", str(seconds)] if pid else ["--", *command])]
    elif lang == "node" and not pid:
        call = ["node", "--cpu-prof", f"--cpu-prof-dir={os.path.dirname(dest)}", f"--cpu-prof-name={os.path.basename(dest)}", *command]
    else:
        return "record a speedscope file with samply or perf and pass it to ingest-profile" if lang == "rust" else "attaching to node is not supported"
    try:
        return None if subprocess.run(call, check=False).returncode == 0 else "the profiler failed"
    except OSError as e:
        return str(e)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--repo", default=".")
    common.add_argument("--json", action="store_true")
    common.add_argument("--quiet", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name: commands.add_parser(name, parents=[common])
    for name in ("scan", "analyze"):
        c = add(name)
        c.add_argument("--max-files", type=int)
        c.add_argument("--budget-seconds", type=float)
        c.add_argument("--model", help="module:function from a text column to a vector column")
        c.add_argument("--no-embed", action="store_true")
        c.add_argument("--git", action=argparse.BooleanOptionalAction, default=name == "analyze")
    add("rank").add_argument("--limit", type=int, default=15)
    c = add("slice")
    c.add_argument("symbol")
    c.add_argument("--depth", type=int, default=4)
    c = add("issues")
    c.add_argument("--limit", type=int, default=40)
    c.add_argument("--all", action="store_true")
    add("cluster").add_argument("--similar-to")
    add("heatmap").add_argument("--out")
    add("ingest-profile").add_argument("path")
    c = add("profile")
    c.add_argument("--lang", default="python")
    c.add_argument("--pid", type=int)
    c.add_argument("--duration", type=int, default=10)
    c.add_argument("run", nargs="*")
    add("review").add_argument("--slice")
    add("label").add_argument("--out")
    c = add("sql")
    c.add_argument("query")
    for name in ("version", "report", "dead", "names", "history", "index-path", "inventory"):
        add(name)
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    from quarry.engine import Engine
    from quarry.plans.build import store_path
    from quarry.session import local_session

    if args.command == "index-path":
        print(store_path(os.path.abspath(args.repo)))
        return 0
    engine = Engine(local_session(), args.repo)
    folder = os.path.join(engine.root, "quarry-reports")
    fresh = args.command in ("scan", "analyze")
    if not fresh and not engine.exists():
        print(json.dumps({"error": "no index; scan first"}) if args.json else "no index; scan first", file=sys.stdout if args.json else sys.stderr)
        return 1
    if fresh:
        value = engine.scan(args.max_files, args.git, not args.no_embed, args.budget_seconds, args.model)
        if args.command == "analyze":
            value["report"] = str(engine.report())
            engine.review(value["report"])
    elif args.command == "rank":
        value = engine.rank(args.limit)
    elif args.command == "slice":
        value = engine.slice(args.symbol, args.depth)
        if value.get("files"):
            value["heatmap"] = engine.heatmap(os.path.join(folder, "slice.svg"), value["files"])
    elif args.command == "issues":
        value = engine.issues(-1 if args.all else args.limit)
    elif args.command == "cluster":
        value = engine.similar_to(args.similar_to) if args.similar_to else engine.clusters()
    elif args.command == "heatmap":
        value = engine.heatmap(args.out or os.path.join(folder, "heatmap.svg"))
    elif args.command == "ingest-profile":
        value = engine.ingest_profile(args.path)
    elif args.command == "profile":
        dest = os.path.join(tempfile.mkdtemp(), "profile.json")
        reason = _profiled(args.lang, args.pid, args.duration, args.run, dest)
        value = {"error": reason} if reason else engine.ingest_profile(dest)
    elif args.command == "review":
        value = engine.review(folder, args.slice)
    elif args.command == "label":
        value = {"rows": engine.labels(args.out or os.path.join(folder, "labels.csv"))}
    elif args.command == "report":
        value = {"report": str(engine.report(refresh=True))}
    elif args.command == "sql":
        value = engine.sql(args.query)
    else:
        value = getattr(engine, args.command)()
    if not args.quiet:
        _show(value, args.json, args.command)
    return 1 if isinstance(value, dict) and "error" in value and args.command != "slice" else 0


if __name__ == "__main__":
    sys.exit(main())
