"""Source trees: the walk on the driver, reading and parsing on the executors."""

from __future__ import annotations

import os
import time
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schema
from quarry.functions.paths import LANGUAGES, SKIPPED_DIRS, ignore_patterns, is_ignored
from quarry.operators.metrics import with_file_metrics

MANIFESTS = (("pyproject.toml", "python"), ("Cargo.toml", "rust"), ("package.json", "node"))


def list_paths(root: str) -> list[str]:
    """Relative paths of all files below the root, in order; skipped folders are not entered.

    Spark's binaryFile source hides names that begin with '_' or '.', which source trees are full of.
    """
    found = []
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in SKIPPED_DIRS)
        found += [os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in files]
    return sorted(found)


def read_tree(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """relpath, content (binary) of the tree's source files: known suffixes, not ignored, the first max_files by path.

    The root must be reachable from the executors (a shared file system, or one machine).
    """
    ignore = Path(root, ".gitignore")
    patterns = ignore_patterns(ignore.read_text(errors="replace")) if ignore.is_file() else []
    suffixes = tuple("." + x for x in LANGUAGES)
    paths = [p for p in list_paths(root) if p.lower().endswith(suffixes)]
    listed = spark.createDataFrame(pd.DataFrame({"relpath": pd.Series(paths, dtype="object")}), "relpath string").filter(~is_ignored(F.col("relpath"), patterns))
    if max_files is not None:
        listed = listed.orderBy("relpath").limit(max_files)

    def read(batches):
        for batch in batches:
            yield batch.assign(content=[_bytes(os.path.join(root, p)) for p in batch["relpath"]])

    parts = max(1, min(len(paths) // 64 + 1, spark.sparkContext.defaultParallelism * 4))
    return listed.repartition(parts, "relpath").mapInPandas(read, "relpath string, content binary")


def _bytes(path: str) -> bytes:
    try:
        return Path(path).read_bytes()
    except OSError:
        return b""


def parse_files(raw: DataFrame, deadline: float | None = None) -> DataFrame:
    """Adds symbols, calls, import_modules, ast_nodes to relpath, content, language; one Python pass.

    Files whose turn comes after the deadline (in seconds since 1970) are left out.
    """

    def parse(batches):
        from quarry.sources.parsers import parse_source

        for batch in batches:
            batch = batch.reset_index(drop=True)
            if deadline is not None:
                found = []
                for lang, p, c in zip(batch["language"], batch["relpath"], batch["content"], strict=True):
                    if time.time() >= deadline:
                        break
                    found.append(parse_source(lang, os.path.splitext(p)[1].lower(), bytes(c)))
                batch = batch.iloc[: len(found)]
            else:
                found = [parse_source(lang, os.path.splitext(p)[1].lower(), bytes(c)) for lang, p, c in zip(batch["language"], batch["relpath"], batch["content"], strict=True)]
            rows = pd.DataFrame([x.as_row() for x in found], columns=["symbols", "calls", "import_modules", "ast_nodes"])
            yield pd.concat([batch[["relpath"]].reset_index(drop=True), rows], axis=1)

    return raw.select("relpath", "content", "language").mapInPandas(parse, f"relpath string, {schema.EXTRACTED}")


def files_table(raw: DataFrame) -> DataFrame:
    return with_file_metrics(raw).filter("language is not null")


def symbols_table(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """One row a symbol, keyed by its place in the file; tests of test files, and public route handlers as entries."""
    flat = parsed.select("relpath", F.posexplode("symbols").alias("ord", "s")).select("relpath", "ord", "s.*")
    rows = flat.join(files.select("relpath", F.col("is_test").alias("_test")), "relpath")
    route = F.col("relpath").contains("app/") & F.col("relpath").endswith("route.ts") & F.col("is_public")
    return rows.withColumns({"is_entry": F.col("is_entry") | route, "is_test": F.col("is_test") | F.col("_test")}).drop("_test")


def owner_calls_table(parsed: DataFrame) -> DataFrame:
    return parsed.select("relpath", F.explode("calls").alias("c")).select("relpath", "c.owner", "c.callee")


def import_facts_table(parsed: DataFrame) -> DataFrame:
    return parsed.select("relpath", F.explode("import_modules").alias("module_hint"))


def packages(root: str) -> list[dict[str, str]]:
    """Package manifests at the root."""
    return [{"kind": kind, "path": name} for name, kind in MANIFESTS if Path(root, name).is_file()]
