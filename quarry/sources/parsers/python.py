"""Python files through the standard library's syntax tree."""

from __future__ import annotations

import ast

from quarry.sources.parsers import ENTRY_NAMES, Extracted, Symbol, call_name

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)


class _Source:
    def __init__(self, text: str):
        self.text = text
        self.lines = [x.encode() for x in text.splitlines(keepends=True)]

    def cut(self, line: int, column: int, end_line: int, end_column: int) -> str:
        if line == end_line:
            return self.lines[line - 1][column:end_column].decode("utf-8", "replace")
        parts = [self.lines[line - 1][column:], *self.lines[line : end_line - 1], self.lines[end_line - 1][:end_column]]
        return b"".join(parts).decode("utf-8", "replace")

    def of(self, node: ast.AST) -> str:
        return self.cut(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)


class _Complexity(ast.NodeVisitor):
    """Cyclomatic and cognitive complexity, and the deepest nesting, of one function."""

    def __init__(self, source: _Source, root: ast.AST, name: str):
        self.source, self.root, self.name = source, root, name
        self.cyclomatic, self.cognitive, self.deepest, self.nest = 1, 0, 0, 0

    def _inside(self, nodes) -> None:
        self.nest += 1
        for n in nodes:
            self.visit(n)
        self.nest -= 1

    def visit(self, node: ast.AST) -> None:
        self.deepest = max(self.deepest, self.nest)
        super().visit(node)

    def _structure(self) -> None:
        self.cyclomatic += 1
        self.cognitive += 1 + self.nest

    def _otherwise(self, body: list[ast.stmt]) -> None:
        if body:
            self.cognitive += 1
            self._inside(body)

    def visit_If(self, node: ast.If) -> None:
        self._structure()
        self._inside([node.test, *node.body])
        rest = node.orelse
        while len(rest) == 1 and isinstance(rest[0], ast.If) and self.source.of(rest[0]).startswith("elif"):
            self.cyclomatic += 1
            self.cognitive += 1
            self._inside([rest[0].test, *rest[0].body])
            rest = rest[0].orelse
        self._otherwise(rest)

    def _loop(self, node) -> None:
        self._structure()
        self._inside([n for f, n in ast.iter_fields(node) if isinstance(n, ast.AST)] + node.body)
        self._otherwise(node.orelse)

    visit_For = visit_AsyncFor = visit_While = _loop

    def visit_Try(self, node) -> None:
        for n in (*node.body, *node.handlers, *node.finalbody):
            self.visit(n)
        if node.orelse:
            self.cognitive += 1
            for n in node.orelse:
                self.visit(n)

    visit_TryStar = visit_Try

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        self._structure()
        self._inside(ast.iter_child_nodes(node))

    def visit_IfExp(self, node: ast.IfExp) -> None:
        self._structure()
        self._inside(ast.iter_child_nodes(node))

    def visit_Match(self, node: ast.Match) -> None:
        self._structure()
        self._inside(ast.iter_child_nodes(node))

    def visit_match_case(self, node: ast.match_case) -> None:
        self.cyclomatic += 1
        self.generic_visit(node)

    def visit_BoolOp(self, node: ast.BoolOp) -> None:
        first = node.values[0]
        for value in node.values[1:]:
            text = self.source.cut(first.lineno, first.col_offset, value.end_lineno, value.end_col_offset)
            extra = 2 if " and " in text and " or " in text else 1 if " and " in text or " or " in text else 0
            self.cyclomatic += extra
            self.cognitive += extra
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        if self.source.of(node.func).rsplit(".", 1)[-1] == self.name:
            self.cyclomatic += 1
            self.cognitive += 1
        self.generic_visit(node)

    def _nested(self, node) -> None:
        if node is self.root:
            self.generic_visit(node)
        else:
            self._inside(ast.iter_child_nodes(node))

    visit_FunctionDef = visit_AsyncFunctionDef = visit_Lambda = _nested


def _parameters(body: str, name: str) -> str:
    start = body.index("(", body.index(name) + len(name)) if "(" in body else 0
    depth = 0
    for i in range(start, len(body)):
        depth += (body[i] in "([{") - (body[i] in ")]}")
        if not depth:
            return body[start : i + 1]
    return "()"


def _count(args: ast.arguments) -> int:
    """Parameters without self and cls; those with both a type and a default, and bare * ones, don't count."""
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    pairs = [*zip(plain, defaults, strict=True), *zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    count = sum(not (a.annotation and d) and (a.annotation is not None or d is not None or a.arg not in ("self", "cls")) for a, d in pairs)
    return count + sum(a is not None and a.annotation is not None for a in (args.vararg, args.kwarg))


def _docstring(source: _Source, node) -> str:
    first = node.body[0]
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return source.of(first.value).strip(" \"'")
    return ""


def parse(text: str) -> Extracted:
    source = _Source(text)
    tree = ast.parse(text)
    out = Extracted(ast_nodes=sum(1 for _ in ast.walk(tree)))

    def function(node, owner: str | None) -> None:
        body = source.of(node)
        command = False
        if node.decorator_list:
            whole = source.cut(node.decorator_list[0].lineno, max(0, node.decorator_list[0].col_offset - 1), node.end_lineno, node.end_col_offset)
            command = any(x in whole for x in (".command", "callback", "@app."))
        measured = _Complexity(source, node, node.name)
        measured.visit(node)
        signature = f"def {node.name}{_parameters(body, node.name)}"
        out.symbols.append(
            Symbol(
                "method" if owner else "function", node.name, body, f"class {owner}: {signature}" if owner else signature, _docstring(source, node), node.lineno, node.end_lineno, _count(node.args),
                measured.deepest, measured.cognitive, measured.cyclomatic, node.name.startswith("test_"), command or node.name in ENTRY_NAMES or node.name == "__main__", not node.name.startswith("_"),
            )
        )
        for part in (*node.body, node.args, *([node.returns] if node.returns else [])):
            for call in ast.walk(part):
                if isinstance(call, ast.Call) and (name := call_name(source.of(call.func))):
                    out.calls.append({"owner": node.name, "callee": name})

    def walk(node: ast.AST, owner: str | None) -> None:
        if isinstance(node, _FUNCTIONS):
            function(node, owner)
        elif isinstance(node, ast.ClassDef):
            for child in node.body:
                walk(child, node.name)
        elif isinstance(node, ast.Import):
            out.import_modules += [a.name.split(".")[0] for a in node.names if not a.asname]
        elif isinstance(node, ast.ImportFrom):
            if node.module != "__future__" or node.level:
                head = (node.module or "").split(".")[0] if not node.level else ""
                out.import_modules += [head, *([head] if not node.level else []), *(a.name for a in node.names if not a.asname and a.name != "*")]
        else:
            for child in ast.iter_child_nodes(node):
                walk(child, owner)

    walk(tree, None)
    return out
