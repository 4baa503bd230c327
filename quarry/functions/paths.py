"""Paths: languages, tests, segments and the deny-lists that issue rules use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "typescript", "jsx": "typescript", "rs": "rust"}
SKIPPED_DIRS = frozenset(".git .mypy_cache .pytest_cache .ruff_cache .tox .venv __pycache__ build dist node_modules quarry-index quarry-reports target vendor venv".split())
IO_BOUNDARY = ("/db/", "/io/", "cli.py", "git_hist.py", "http", "profile.py", "store.py")
_NOISE_SEGMENTS = (".cursor", "asset", "assets", "doc", "docs", "fixture", "fixtures", "locale", "locales", "test", "tests", "tools")
_NOISE_FILES = (".dockerignore", ".editorconfig", ".gitattributes", ".gitignore", ".gitmodules", ".npmignore", "cargo.lock", "cargo.toml")


def suffix(relpath: Column) -> Column:
    """The lower-cased extension with its dot, '' without one."""
    return F.lower(F.regexp_extract(relpath, r"[^/](\.[^./]+)$", 1))


def language(relpath: Column) -> Column:
    """python, typescript or rust by suffix; null for other files."""
    out = None
    for ext, name in LANGUAGES.items():
        hit = suffix(relpath) == "." + ext
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def segments(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def has_segment(path: Column, *names: str) -> Column:
    """A whole path component, in any case, is one of the names."""
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, names)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test(relpath: Column) -> Column:
    """A component test, tests, spec or __tests__, or a file name that test runners look for."""
    return has_segment(relpath, "__tests__", "spec", "test", "tests") | F.lower(basename(relpath)).rlike(r"^test_|_test\.(?:py|rs)$|\.(?:spec|test)\.ts$")


def is_docs(path: Column) -> Column:
    return has_segment(path, "doc", "docs")


def is_boundary(path: Column) -> Column:
    """Paths where I/O belongs."""
    out = F.lit(False)
    for part in IO_BOUNDARY:
        out = out | path.contains(part)
    return out


def is_outside_core(path: Column) -> Column:
    return has_segment(path, "bin", "scripts", "tools", "ui") | is_docs(path)


def is_noise_partner(path: Column) -> Column:
    """Files that change with everything: docs, tests, assets, manifests, ignore files, starters, Markdown, JSON."""
    name = F.lower(basename(path))
    return has_segment(path, *_NOISE_SEGMENTS) | name.isin(*_NOISE_FILES) | name.rlike(r"^start.*\.sh$") | name.rlike(r"[^.].*\.(?:json|markdown|md)$")


def far_apart(a: Column, b: Column) -> Column:
    """The first components differ."""
    return F.get(F.split(a, "/"), F.lit(0)) != F.get(F.split(b, "/"), F.lit(0))


def glob_regex(glob: str) -> str:
    """A regular expression for an ignore pattern: * and ? match anything, / included; [..] are classes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out += "[" + ("^" + re.escape(inner[1:]) if inner[0] == "!" else re.escape(inner)).replace(r"\-", "-") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def ignore_patterns(text: str) -> list[str]:
    """Patterns of an ignore file: trimmed lines without comments; a trailing slash is dropped."""
    lines = (x.strip() for x in text.splitlines())
    return [glob_regex(x.rstrip("/")) for x in lines if x and not x.startswith("#")]


def is_ignored(relpath: Column, patterns: list[str]) -> Column:
    """A pattern matches the whole path or the file's name. Directories exclude nothing; there is no negation."""
    out = F.lit(False)
    for p in patterns:
        out = out | relpath.rlike(p) | basename(relpath).rlike(p)
    return out
