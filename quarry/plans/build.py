"""Building and keeping the index: parse what changed, derive everything else again."""

from __future__ import annotations

import importlib
import os
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schema
from quarry.functions import tags
from quarry.functions.vectors import stub_vector
from quarry.operators import clones, dead, embed, graph, history, index, issues, metrics, rank
from quarry.operators import names as name_health
from quarry.sources import git, tree
from quarry.sources.shared import materialize

#: Facts depend on it: another version parses every file anew.
PARSER_VERSION = "1"
SCHEMA_VERSION = "1"


def store_path(root: str) -> str:
    return os.path.join(root, "quarry-index")


def load(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the index; empty if there is none yet."""
    path = os.path.join(store, name)
    return spark.read.parquet(path) if os.path.isdir(path) else spark.createDataFrame([], schema.TABLES[name])


def save(tables: dict[str, DataFrame], store: str) -> None:
    """Writes all tables beside the old ones and swaps the folders: readers see one version or the other."""
    fresh, old = f"{store}.new", f"{store}.old"
    shutil.rmtree(fresh, ignore_errors=True)
    for name, df in tables.items():
        df.write.parquet(os.path.join(fresh, name))
    shutil.rmtree(old, ignore_errors=True)
    if os.path.isdir(store):
        os.rename(store, old)
    os.rename(fresh, store)
    shutil.rmtree(old, ignore_errors=True)


def reset(spark: SparkSession, store: str) -> None:
    """Empties all tables but meta."""
    save({name: load(spark, store, name) if name == "meta" else spark.createDataFrame([], columns) for name, columns in schema.TABLES.items()}, store)


def read_meta(spark: SparkSession, store: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in load(spark, store, "meta").collect()}


def _model(name: str | None):
    """The function that module:function names; the stub for no name."""
    if name is None:
        return stub_vector
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def scan(spark: SparkSession, root: str, max_files: int | None = None, with_git: bool = False, with_embed: bool = True, store: str | None = None, budget_seconds: float | None = None, model: str | None = None) -> dict:
    """Walks, parses changed files, resolves, tags, ranks and flags; writes the index; returns a summary.

    Files that can't be parsed within the budget keep what the index has of them, if anything, and count as
    changed at the next scan. A model is named as module:function, a function from a text column to a vector
    column; without it vectors are the deterministic stub. Vectors of another model are made anew. Each step is written to the shared folder and read again: plans stay small, and nothing is computed twice.
    """
    began = time.time()
    root = str(Path(root).resolve())
    store = store or store_path(root)
    meta = read_meta(spark, store)
    fresh = meta.get("parser_version") != PARSER_VERSION or meta.get("schema_version") != SCHEMA_VERSION
    raw = tree.read_tree(spark, root, max_files)
    walked = materialize(index.dedupe_files(tree.files_table(raw)), "walked")
    old_files = load(spark, store, "files") if not fresh else spark.createDataFrame([], schema.FILES)
    state = materialize(index.changes(walked, old_files, fresh), "state")
    counts = {r["state"]: r["count"] for r in state.groupBy("state").count().collect()}
    dirty = state.filter("state = 'dirty'").select("relpath")
    gone = state.filter("state <> 'reused'").select("relpath")

    source = raw.join(dirty, "relpath", "left_semi").join(walked.select("relpath", "language"), "relpath")
    parsed = materialize(tree.parse_files(source, None if budget_seconds is None else began + budget_seconds), "parsed")
    late = 0
    if budget_seconds is not None:
        missed = materialize(dirty.join(parsed.select("relpath"), "relpath", "left_anti"), "late")
        late = missed.count()
        gone = gone.join(missed, "relpath", "left_anti")
        known = old_files.join(missed, "relpath", "left_semi").select(*walked.columns)
        walked = materialize(walked.join(missed, "relpath", "left_anti").unionByName(known), "walked")
    new_symbols = tree.symbols_table(parsed, walked)
    new_calls = graph.attach_calls(new_symbols, tree.owner_calls_table(parsed))
    kept = lambda name, columns: index.without_files(load(spark, store, name), gone).select(*columns)
    symbols = new_symbols
    calls, imports = new_calls, tree.import_facts_table(parsed)
    ast_nodes = parsed.select("relpath", "ast_nodes")
    if not fresh and os.path.isdir(store):
        symbols = symbols.unionByName(kept("symbols", new_symbols.columns))
        calls = calls.unionByName(kept("call_facts", calls.columns))
        imports = imports.unionByName(kept("import_facts", imports.columns))
        ast_nodes = ast_nodes.unionByName(index.without_files(old_files, gone).select("relpath", "ast_nodes"))
    symbols, calls, imports = materialize(symbols, "symbols"), materialize(calls, "calls"), materialize(imports, "imports")
    files = walked.join(ast_nodes, "relpath", "left").withColumns({"ast_nodes": F.coalesce("ast_nodes", F.lit(0).cast("long")), "profile_self": F.lit(0.0), "profile_total": F.lit(0.0)})

    edges = materialize(graph.resolve_calls(calls, symbols, files).unionByName(graph.resolve_imports(imports, files)), "edges")
    full = graph.with_fans(symbols, edges)
    full = full.withColumns({"effects": tags.effects("body"), "risks": tags.risks("name", "signature", "body"), "cost_hint": tags.cost_hint("body")})
    full = name_health.with_fingerprints(full, edges)
    info: dict = {"enabled": False}
    log = spark.createDataFrame([], schema.GIT_LOG)
    if with_git:
        log, reason = git.git_log(spark, root)
        info = {"enabled": not reason} | ({"reason": reason} if reason else {"commits": history.commit_count(log).first()["commits"]})
    files = history.with_history(files, log)
    pairs = materialize(history.coupling(log), "coupling")
    files = materialize(rank.compute_rank(materialize(files, "files"), symbols, edges), "files")
    empty = F.lit(None).cast("array<float>")
    full = embed.embed_symbols(full, _model(model), only_missing=False) if with_embed else full.withColumns({c: empty for c in ("embed_sig", "embed_doc", "embed_body")})
    full = materialize(full, "full")
    flags = name_health.name_flags(full).unionByName(dead.hollow_symbols(full, files).select("relpath", "ord", F.lit("hollow").alias("kind"), F.col("reason").alias("detail"), F.lit(1.0).alias("score")))
    copies = clones.token_clones(full)
    if with_embed:
        flags = flags.unionByName(clones.mismatches(full))
        copies = copies.unionByName(clones.vector_clones(full))
    found = issues.find_issues(full, files, pairs)
    entries = {"repo": root, "model": (model or "stub") if with_embed else "none", "parser_version": PARSER_VERSION, "schema_version": SCHEMA_VERSION}
    columns = lambda name: schema.struct(schema.TABLES[name]).fieldNames()
    tables = {
        "files": files.select(*columns("files")),
        "symbols": full.select(*columns("symbols")),
        "call_facts": calls.select(*columns("call_facts")),
        "import_facts": imports.select(*columns("import_facts")),
        "edges": edges,
        "clones": copies,
        "name_flags": flags,
        "git_coupling": pairs,
        "issues": found,
        "meta": index.upsert(load(spark, store, "meta"), spark.createDataFrame(list(entries.items()), schema.META)),
    }
    save(tables, store)
    stored = {name: load(spark, store, name) for name in ("files", "symbols", "edges", "clones", "issues", "name_flags")}
    sizes = {r["name"]: r["n"] for r in metrics.table_counts(**stored).collect()}
    kinds = {r["kind"]: r["n"] for r in metrics.kind_counts(stored["name_flags"]).collect()}
    return {
        "files": sizes["files"], "symbols": sizes["symbols"], "edges": sizes["edges"], "parsed": counts.get("dirty", 0) - late, "late": late, "reused": counts.get("reused", 0), "removed": counts.get("removed", 0), "clones": sizes["clones"],
        "hollow": kinds.get("hollow", 0), "mismatches": kinds.get("doc_body_mismatch", 0) + kinds.get("signature_body_mismatch", 0), "issues": sizes["issues"], "git": info, "elapsed_seconds": round(time.time() - began, 3), "model": entries["model"],
    }
