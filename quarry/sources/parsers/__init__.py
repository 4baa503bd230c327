"""Parsers of single files: source text in, symbols, calls and imports out."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

ENTRY_NAMES = frozenset(("app", "cli", "handler", "main", "run"))
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


@dataclass
class Symbol:
    kind: str
    name: str
    body: str
    signature: str
    docstring: str
    start_line: int
    end_line: int
    nargs: int = 0
    nesting: int = 0
    cognitive: int = 0
    cyclomatic: int = 1
    is_test: bool = False
    is_entry: bool = False
    is_public: bool = True


@dataclass
class Extracted:
    ast_nodes: int = 0
    import_modules: list[str] = field(default_factory=list)
    symbols: list[Symbol] = field(default_factory=list)
    calls: list[dict[str, str]] = field(default_factory=list)

    def as_row(self) -> dict:
        return asdict(self)


def without_turbofish(text: str) -> str:
    """Rust's ::<...> go, brackets nested."""
    while (at := text.find("::<")) >= 0:
        depth, end = 0, len(text)
        for i in range(at + 2, len(text)):
            depth += (text[i] == "<") - (text[i] == ">")
            if not depth:
                end = i + 1
                break
        text = text[:at] + text[end:]
    return text


def call_name(callee: str) -> str:
    """The name a call is filed under: up to the first '(', last '::' part, last '.' part; '' if no identifier."""
    name = without_turbofish(callee.split("(", 1)[0]).rsplit("::", 1)[-1].rsplit(".", 1)[-1].strip()
    return name if _IDENTIFIER.match(name) else ""


def parse_source(language: str, suffix: str, source: bytes) -> Extracted:
    """Symbols, calls and imports of one file. Files that don't parse give an empty result, never an error."""
    from quarry.sources.parsers import braces, python

    text = source.decode("utf-8", "replace")
    try:
        if language == "python":
            return python.parse(text)
        return braces.parse_rust(text) if language == "rust" else braces.parse_typescript(text)
    except (SyntaxError, ValueError, RecursionError, IndexError):
        return Extracted()
