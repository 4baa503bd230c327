"""Rust and TypeScript or JavaScript through a token scanner with matched brackets."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from quarry.sources.parsers import ENTRY_NAMES, Extracted, Symbol, call_name

_COMMON = r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_RUST = re.compile(_COMMON + r"""|(?P<string>b?r(?P<h>\#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?'(?:\\.[^']*|[^'\\\n])')|(?P<life>'[A-Za-z_]\w*)|(?P<word>[A-Za-z_]\w*!?(?!=)|[A-Za-z_]\w*)|(?P<number>\d[\w.]*?(?=\.\.|[^\w.]|\Z))|(?P<op>=>|->|::|&&|\|\||==|!=|<=|>=|\.\.=?|.)""", re.S)
_TYPESCRIPT = re.compile(_COMMON + r"""|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|&&=?|\|\|=?|\?\?=?|\?\.|===?|!==?|<=|>=|\.\.\.|.)""", re.S)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


class Scan:
    """Tokens without white space; pair[i] is the index of a bracket's partner; comments are kept apart."""

    def __init__(self, text: str, pattern: re.Pattern):
        self.text, self.tokens, self.comments = text, [], []
        for m in pattern.finditer(text):
            kind = m.lastgroup
            if kind == "space":
                continue
            kept = self.comments if kind == "comment" else self.tokens
            kept.append(Token(kind if kind != "h" else "string", m.group(), *m.span()))
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in _CLOSE:
                while stack and _OPEN[self.tokens[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    self.pair[i] = stack.pop()
                    self.pair[self.pair[i]] = i
        self._starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self._ends = [t.end for t in self.comments]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self._starts, at)

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind != "string"

    def close(self, i: int) -> int:
        return self.pair.get(i, len(self.tokens) - 1)

    def cut(self, i: int, j: int) -> str:
        return self.text[self.tokens[i].start : self.tokens[j].end]

    def comment_before(self, i: int) -> str:
        """The comment right before a token, with nothing but white space between."""
        start = self.tokens[i].start
        k = bisect.bisect_right(self._ends, start) - 1
        if k < 0 or self.text[self._ends[k] : start].strip():
            return ""
        return self.comments[k].text.lstrip("/#! ").strip()

    def skip_angles(self, i: int) -> int:
        """Past a <...> that starts at i."""
        depth = 0
        while i < len(self.tokens):
            depth += self.is_(i, "<") - self.is_(i, ">")
            i += 1
            if depth <= 0:
                break
        return i


def _logic(scan: Scan, lo: int, hi: int) -> int:
    """Each && or || node counts 1, or 2 if its text holds both kinds."""
    total, start, ops = 0, lo, []

    def flush(end: int) -> None:
        nonlocal total
        edges = [start, *(i for i in ops), end]
        for k, i in enumerate(ops):
            if scan.is_(i, "||"):
                right = next((j for j in ops[k + 1 :] if scan.is_(j, "||")), end)
                left = start
            else:
                left = max([j + 1 for j in ops[:k] if scan.is_(j, "||")], default=start)
                right = edges[k + 2]
            text = scan.text[scan.tokens[left].start : scan.tokens[min(right, len(scan.tokens)) - 1].end] if right > left else ""
            total += 2 if "&&" in text and "||" in text else 1
        ops.clear()

    i = lo
    while i < hi:
        if scan.is_(i, "(", "[", "{"):
            end = min(scan.close(i), hi)
            total += _logic(scan, i + 1, end)
            if scan.is_(i, "{") and not ops:
                start = end + 1
            i = end
        elif scan.is_(i, "&&", "||") and not (scan.is_(i, "||") and (i == start or scan.is_(i - 1, "(", ",", "=", "move", "=>"))):
            ops.append(i)
        elif scan.is_(i, ";", ",", "=", "=>", "return", "if", "while", "?", ":", "let", "match"):
            flush(i)
            start = i + 1
        i += 1
    flush(hi)
    return total


class _Walk:
    """Complexity of the tokens of one function, by language."""

    def __init__(self, scan: Scan, name: str, rust: bool):
        self.scan, self.name, self.rust = scan, name, rust
        self.cyclomatic, self.cognitive, self.deepest = 1, 0, 0

    def _head_end(self, i: int, hi: int) -> int:
        """The block that a construct's head ends at; for statements without one, the next token."""
        s = self.scan
        if not self.rust and s.is_(i, "("):
            return s.close(i) + 1
        while i < hi and not s.is_(i, "{", ";"):
            i = s.close(i) + 1 if s.is_(i, "(", "[") else i + 1
        return i

    def _statement_end(self, i: int, hi: int) -> int:
        s = self.scan
        while i < hi and not s.is_(i, ";"):
            if s.is_(i, "{"):
                return s.close(i) + 1
            i = s.close(i) + 1 if s.is_(i, "(", "[") else i + 1
        return min(i + 1, hi)

    def _block(self, i: int, hi: int, nest: int) -> int:
        s = self.scan
        if s.is_(i, "{"):
            end = min(s.close(i), hi)
            self.run(i + 1, end, nest)
            return end + 1
        end = self._statement_end(i, hi)
        self.run(i, end, nest)
        return end

    def run(self, lo: int, hi: int, nest: int) -> None:
        s = self.scan
        self.deepest = max(self.deepest, nest)
        i = lo
        while i < hi:
            t = s.tokens[i]
            member = s.is_(i - 1, ".", "?.")
            if t.kind == "word" and not member and t.text == "if" and not (self.rust and self._guard(i, hi)):
                i = self._if(i, hi, nest)
                continue
            if t.kind == "word" and not member and t.text in ("for", "while", "loop", "match", "switch", "catch") and (self.rust or t.text not in ("loop", "match")) and not s.is_(i + 1, ":", "<"):
                self.cyclomatic += 1
                self.cognitive += 1 + nest
                head = self._head_end(i + 1, hi)
                self.run(i + 1, head, nest + 1)
                if t.text == "match" and s.is_(head, "{"):
                    self.cyclomatic += self._arms(head)
                i = self._block(head, hi, nest + 1)
                continue
            if not self.rust and s.is_(i, "?") and not s.is_(i + 1, ":", ".", ")", ",") and self._ternary(i, hi):
                self.cyclomatic += 1
                self.cognitive += 1 + nest
            if not self.rust and s.is_(i, "=>"):
                end = self._arrow_end(i + 1, hi)
                self.run(i + 1, end, nest + 1)
                i = end
                continue
            if t.kind == "word" and t.text.rstrip("!") == self.name and s.is_(i + 1, "(") and not t.text.endswith("!") and not s.is_(i - 1, "fn", "function"):
                self.cyclomatic += 1
                self.cognitive += 1
            i += 1

    def _if(self, i: int, hi: int, nest: int) -> int:
        s = self.scan
        self.cyclomatic += 1
        self.cognitive += 1 + nest
        head = self._head_end(i + 1, hi)
        self.run(i + 1, head, nest + 1)
        i = self._block(head, hi, nest + 1)
        if s.is_(i, "else") and i < hi:
            self.cognitive += 1
            i = self._if(i + 1, hi, nest + 1) if s.is_(i + 1, "if") else self._block(i + 1, hi, nest + 1)
        return i

    def _guard(self, i: int, hi: int) -> bool:
        """An if between a match arm's pattern and its arrow."""
        s = self.scan
        while i < hi and not s.is_(i, "{", ",", ";", "=>"):
            i = s.close(i) + 1 if s.is_(i, "(", "[") else i + 1
        return s.is_(i, "=>")

    def _arms(self, brace: int) -> int:
        s, n, i = self.scan, 0, brace + 1
        end = s.close(brace)
        while i < end:
            n += s.is_(i, "=>")
            i = s.close(i) + 1 if s.is_(i, "(", "[", "{") else i + 1
        return n

    def _ternary(self, i: int, hi: int) -> bool:
        s, depth = self.scan, 0
        while i < hi and not s.is_(i, ";"):
            if s.is_(i, "(", "[", "{"):
                i = s.close(i)
            elif s.is_(i, "?"):
                depth += 1
            elif s.is_(i, ":"):
                return depth > 0
            i += 1
        return False

    def _arrow_end(self, i: int, hi: int) -> int:
        s = self.scan
        if s.is_(i, "{"):
            return min(s.close(i) + 1, hi)
        while i < hi and not s.is_(i, ",", ";"):
            i = s.close(i) + 1 if s.is_(i, "(", "[", "{") else i + 1
        return min(i, hi)


def _calls(scan: Scan, lo: int, hi: int, owner: str, out: Extracted) -> None:
    """Every name(...) in the tokens; macros and declarations are no calls. A chain a(x).b() files both under a."""
    keywords = {"if", "for", "while", "match", "switch", "catch", "return", "function", "fn", "loop", "in", "await", "typeof", "super", "new", "else", "move", "async"}
    for i in range(lo, hi):
        if not scan.is_(i, "(") or i == lo:
            continue
        j = i - 1
        if scan.is_(j, ">"):  # a turbofish
            depth = 0
            while j > lo:
                depth += scan.is_(j, ">") - scan.is_(j, "<")
                j -= 1
                if not depth:
                    break
            if not scan.is_(j, "::"):
                continue
            j -= 1
        last = scan.tokens[j]
        if last.kind != "word" or last.text in keywords or last.text.endswith("!") or scan.is_(j - 1, "fn", "function", "struct", "enum", "new"):
            continue
        k = j  # back to the start of the callee
        while k > lo and (scan.is_(k - 1, ".", "::", "?.") or (scan.is_(k, ".", "::", "?.") and (scan.tokens[k - 1].kind in ("word", "number", "string") or scan.is_(k - 1, ")", "]", "?", ">")))):
            k -= 1
            while scan.is_(k, ")", "]") and k in scan.pair:
                k = scan.pair[k]
                if k > lo and (scan.tokens[k - 1].kind == "word" and scan.tokens[k - 1].text not in keywords or scan.is_(k - 1, ")", "]")):
                    k -= 1
        if name := call_name(scan.cut(k, i - 1)):
            out.calls.append({"owner": owner, "callee": name})


def _count_parameters(scan: Scan, open_: int) -> int:
    end, i, n = scan.close(open_), open_ + 1, 0
    start = i
    while i <= end:
        if i == end or scan.is_(i, ","):
            text = scan.cut(start, i - 1) if i > start else ""
            if text and text not in ("self", "&self", "&mut self", "mut self", "cls") and not re.match(r"(&('\w+ )?)?(mut )?self\b", text):
                n += 1
            start = i + 1
        elif scan.is_(i, "(", "[", "{"):
            i = scan.close(i)
        elif scan.is_(i, "<"):
            i = scan.skip_angles(i) - 1
        i += 1
    return n


def _finish(scan: Scan, out: Extracted, start: int, end: int, name: str, rust: bool, inner: int | None = None, **more) -> None:
    """Adds a symbol and its calls; inner is the first token after the name, which is no call."""
    inner = start if inner is None else inner
    walk = _Walk(scan, name, rust)
    walk.run(inner, end + 1, 0)
    extra = _logic(scan, inner, end + 1)
    out.symbols.append(
        Symbol(name=name, start_line=scan.line(scan.tokens[start].start), end_line=scan.line(scan.tokens[end].end - 1), body=scan.cut(start, end), cyclomatic=walk.cyclomatic + extra, cognitive=walk.cognitive + extra, nesting=walk.deepest, **more)
    )
    _calls(scan, inner, end + 1, name, out)


def parse_rust(text: str) -> Extracted:
    scan = Scan(text, _RUST)
    out = Extracted(ast_nodes=len(scan.tokens))
    types = {"struct": "struct", "enum": "enum", "type": "type", "trait": "trait", "union": "union"}

    def items(i: int, hi: int, test_module: bool) -> None:
        attributes, first = "", None
        while i < hi:
            t = scan.tokens[i]
            if scan.is_(i, "#") and scan.is_(i + 1, "[", "!"):
                open_ = i + 1 + scan.is_(i + 1, "!")
                attributes += scan.cut(i, scan.close(open_)) + " "
                i = scan.close(open_) + 1
                continue
            if t.kind == "word" and t.text in ("pub", "async", "unsafe", "extern", "const", "default") or (first is not None and (t.kind == "string" or scan.is_(i, "("))):
                first = i if first is None else first
                i = scan.close(i) + 1 if scan.is_(i, "(") else i + 1
                if t.text in ("const",) and not scan.is_(i, "fn", "unsafe", "async", "extern"):
                    i, first, attributes = _semicolon(i), None, ""
                continue
            start = i if first is None else first
            public = any(scan.is_(k, "pub") for k in range(start, i))
            if scan.is_(i, "fn") and i + 1 < hi:
                name = scan.tokens[i + 1].text
                open_ = i + 2 if not scan.is_(i + 2, "<") else scan.skip_angles(i + 2)
                k = scan.close(open_) + 1
                while k < hi and not scan.is_(k, "{", ";"):
                    k += 1
                end = scan.close(k) if scan.is_(k, "{") else min(k, hi - 1)
                body = scan.cut(start, end)
                if scan.is_(k, "{"):
                    _finish(
                        scan, out, start, end, name, True, open_, kind="function", signature=body.split("{")[0].strip()[:240], docstring=scan.comment_before(start), nargs=_count_parameters(scan, open_), is_public=public or name == "main",
                        is_entry=name == "main" or "main]" in attributes, is_test="test]" in attributes or "cfg(test)" in attributes or "#[test]" in body or name.startswith("test_") or test_module,
                    )
                i = end + 1
            elif t.text in types and t.kind == "word" and i + 1 < hi and scan.tokens[i + 1].kind == "word":
                k = i + 1
                while k < hi and not scan.is_(k, "{", ";"):
                    k = scan.close(k) + 1 if scan.is_(k, "(", "[") else k + 1
                end = scan.close(k) if scan.is_(k, "{") else min(k, hi - 1)
                body = scan.cut(start, end)
                _finish(scan, out, start, end, scan.tokens[i + 1].text, True, kind=types[t.text], signature=body.split("{")[0].split("=")[0].strip()[:240], docstring=scan.comment_before(start), is_public=public)
                i = end + 1
            elif scan.is_(i, "mod", "impl"):
                k = i
                while k < hi and not scan.is_(k, "{", ";"):
                    k += 1
                if scan.is_(k, "{"):
                    items(k + 1, scan.close(k), test_module or (t.text == "mod" and "cfg(test)" in attributes))
                    k = scan.close(k)
                i = k + 1
            elif scan.is_(i, "use"):
                end = _semicolon(i)
                out.import_modules.append(scan.cut(i if first is None else start, end - 1))
                i = end
            else:
                i = scan.close(i) + 1 if scan.is_(i, "{", "(", "[") else i + 1
            attributes, first = "", None

    def _semicolon(i: int) -> int:
        while i < len(scan.tokens) and not scan.is_(i, ";"):
            i = scan.close(i) + 1 if scan.is_(i, "(", "[", "{") else i + 1
        return min(i + 1, len(scan.tokens))

    items(0, len(scan.tokens), False)
    return out


def parse_typescript(text: str) -> Extracted:
    scan = Scan(text, _TYPESCRIPT)
    out = Extracted(ast_nodes=len(scan.tokens))
    n = len(scan.tokens)

    def body_after(open_: int) -> int:
        """The '{' of a body after the parameters, past a return type; else the index of what ends a signature."""
        k = scan.close(open_) + 1
        if scan.is_(k, ":"):
            k += 1
            while k < n and not scan.is_(k, ";", "=>"):
                if scan.is_(k, "{"):
                    after = scan.close(k) + 1
                    if not scan.is_(after, "{", "|", "&", "["):
                        return k
                    k = after
                    continue
                if scan.is_(k, "<"):
                    k = scan.skip_angles(k)
                    continue
                k = scan.close(k) + 1 if scan.is_(k, "(", "[") else k + 1
        return k

    def function(start: int, name_at: int, open_: int) -> int:
        k = body_after(open_)
        if not scan.is_(k, "{"):
            end = k if scan.is_(k, ";") else k - 1
        else:
            end = scan.close(k)
        end = min(end, n - 1)
        name, body = scan.tokens[name_at].text, scan.cut(start, end)
        _finish(
            scan, out, start, end, name, False, open_, kind="function", signature=body.split("{")[0].split("=>")[0].strip()[:240], docstring=scan.comment_before(start), nargs=_count_parameters(scan, open_), is_public=not name.startswith("_"),
            is_entry=name in ENTRY_NAMES or name in ("GET", "POST", "PUT", "DELETE"), is_test=name.startswith("test") or name.endswith("Test"),
        )
        return end + 1

    def members(lo: int, hi: int) -> None:
        i = lo
        while i < hi:
            start = i
            while i < hi and scan.is_(i, "public", "private", "protected", "static", "async", "readonly", "override", "abstract", "get", "set", "*") and not scan.is_(i + 1, "(", "=", ":", ";", "?"):
                i += 1
            at = i
            open_ = at + 1 if not scan.is_(at + 1, "<") else scan.skip_angles(at + 1)
            if scan.tokens[at].kind in ("word", "string") and scan.is_(open_, "("):
                i = function(start, at, open_)
                continue
            while i < hi and not scan.is_(i, ";"):
                if scan.is_(i, "{"):
                    walk(i + 1, scan.close(i))
                    i = scan.close(i)
                    break
                i += 1
            i += 1

    def walk(i: int, hi: int) -> None:
        while i < hi:
            t = scan.tokens[i]
            if scan.is_(i, "import") and not scan.is_(i + 1, "(", "."):
                end = i
                while end < hi and not (scan.is_(end, ";") or scan.tokens[end].kind == "string"):
                    end += 1
                if end < hi and scan.tokens[end].kind == "string":
                    out.import_modules.append(scan.tokens[end].text.strip("\"'"))
                i = end + 1
            elif scan.is_(i, "function") or (scan.is_(i, "async") and scan.is_(i + 1, "function")):
                at = i + 1 + scan.is_(i, "async")
                at += scan.is_(at, "*")
                if at < hi and scan.tokens[at].kind == "word":
                    open_ = at + 1 if not scan.is_(at + 1, "<") else scan.skip_angles(at + 1)
                    i = function(i, at, open_)
                else:
                    i = at
            elif scan.is_(i, "class") and not scan.is_(i - 1, "."):
                k = i
                while k < hi and not scan.is_(k, "{"):
                    k += 1
                members(k + 1, scan.close(k))
                i = scan.close(k) + 1
            elif scan.is_(i, "const", "let") and i + 1 < hi and scan.tokens[i + 1].kind == "word":
                i = arrows(i, hi)
            else:
                del t
                i += 1

    def arrows(start: int, hi: int) -> int:
        """const x = (..) => ..: the declaration is the function's text; its calls count twice, as whole and as value."""
        end = start
        while end < hi and not scan.is_(end, ";"):
            if end > start and scan.tokens[end].kind == "word" and scan.is_(end, "const", "let", "function", "class", "export", "import", "return") and scan.line(scan.tokens[end].start) > scan.line(scan.tokens[end - 1].start):
                break
            end = scan.close(end) + 1 if scan.is_(end, "(", "[", "{") else end + 1
        last = min(end if scan.is_(end, ";") else end - 1, hi - 1)
        k = start + 1
        while k <= last and not scan.is_(k, "="):
            k = scan.skip_angles(k) if scan.is_(k, "<") else k + 1
        value = k + 1
        open_ = value + scan.is_(value, "async")
        open_ = scan.skip_angles(open_) if scan.is_(open_, "<") else open_
        arrow = None
        if scan.is_(open_, "("):
            after = scan.close(open_) + 1
            while after <= last and not scan.is_(after, "=>", ";", "{"):
                after += 1
            arrow = after if scan.is_(after, "=>") and (after == scan.close(open_) + 1 or scan.is_(scan.close(open_) + 1, ":")) else None
        elif open_ <= last and scan.tokens[open_].kind == "word" and scan.is_(open_ + 1, "=>"):
            arrow = open_ + 1
        if arrow is not None:
            name = scan.tokens[start + 1].text
            _finish(
                scan, out, start, last, name, False, kind="function", signature=f"const {name} = ...", docstring=scan.comment_before(start), nargs=_count_parameters(scan, open_) if scan.is_(open_, "(") else 0, is_public=not name.startswith("_"),
                is_entry=name in ENTRY_NAMES, is_test=name.startswith("test"),
            )
            _calls(scan, value, last + 1, name, out)
        walk(value, last + 1)
        return last + 1

    walk(0, n)
    return out
