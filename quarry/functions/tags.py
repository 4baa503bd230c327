"""Behaviour tags of code: effects, risks, cost and hollow bodies, as native expressions.

Word boundaries are Unicode-aware ((?U)). A boundary after '(' asks for a word character next, so
``fetch(url)`` matches and ``fetch("x")`` does not; that rule is part of the tags' definition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NODE_FS = sorted("access appendFile chmod chown close copyFile exists link lstat mkdir open readFile readdir readlink realpath rename rm rmdir stat symlink truncate unlink writeFile".split())
_NODE_STREAMS = sorted("createReadStream createWriteStream promises watch watchFile".split())


def _either(*parts: str) -> str:
    return "(?:" + "|".join(parts) + ")"


def _whole(*parts: str) -> str:
    return r"\b" + _either(*parts) + r"\b"


#: (tag, pattern) in the order in which tags are listed. The file-system tag has a rule of its own for open().
EFFECTS: tuple[tuple[str, str], ...] = (
    ("filesystem", _whole("File::", "OpenOptions", r"Path\(", "fs::", r"fs\." + _either(*_NODE_STREAMS, _either(*_NODE_FS) + "(?:Sync)?"), "read_file", "std::fs", "tokio::fs", "write_file")),
    ("network", _whole("axios", r"fetch\(", "httpx", "hyper::", "reqwest", r"requests\.", "ureq", "websocket")),
    ("db", "(?i)" + _either(_whole("diesel", "prisma", "sqlalchemy", "sqlite3", "sqlx"), r"\bexecute\(", r"query!\(")),
    ("process", _whole("Command::new", "child_process", r"os\.system", "std::process::Command", "subprocess")),
    ("global_mutate", _either(r"(?m:^\s*global\b)", r"static mut\b")),
    ("unsafe", _either(r"\beval\(", r"\bunsafe\b")),
    ("panic", _whole(r"expect\(", "panic!", "raise ", "throw ", r"unwrap\(")),
)

RISKS: tuple[tuple[str, str], ...] = (
    ("auth", "(?i)" + _either("authn", "jwt", "login", "oauth", "passwd", "password", "secret", "session")),
    ("crypto", "(?i)" + _whole("aes", "bcrypt", "decrypt", "encrypt", "fernet", "hashlib", "hmac", "rsa", "sha256")),
    ("parser", "(?i)" + _whole("ast", "grammar", "parse", "parser", r"pickle\.loads", r"yaml\.load")),
    ("money", "(?i)" + _whole("balance", "currency", "invoice", "ledger", "payment", "price")),
    ("migration", _whole("ALTER TABLE", "alembic", "migrate", "schema_version")),
    ("unsafe", _either(r"\beval\(", r"\bexec\(", r"\bunsafe\b", r"pickle\.loads")),
    ("any_type", _either(r":\s*Any\b", r"\bany\b", r"\bas any\b")),
)

LOOPS = _whole("for", "loop", "while")
ALLOCATIONS = _whole("Vec::", r"\.clone\(", "alloc", r"clone\(", "malloc", r"to_owned\(", r"to_vec\(")
IO_CALLS = _whole(r"execute\(", r"fetch\(", r"json\.loads", r"open\(", "read_to_string")

_OPEN_CALL = r"(?U)(^|[^\w])open\(\b"
_MUTABLE, _TYPED, _GENERICS = r"(?:mut\s+)?", r"(?::[^=\n]*)?", r"(?:<[^>\n]*>)?"
_LIST_BEFORE, _LIST_AFTER = r"(?:[^{0}\n]*,)?\s*", r"\s*(?:[{1}][^{0}\n]*)?"
#: Bindings of a local name ``open``: declarations, assignments, closure, function and arrow parameters.
_OPEN_BOUND = "(?U)" + _either(
    rf"\b(?:const|let|var)\s+{_MUTABLE}open\b",
    rf"(?m:^\s*open\s*{_TYPED}=[^=])",
    r"\|" + _LIST_BEFORE.format("|") + _MUTABLE + "open" + _LIST_AFTER.format("|", ",:") + r"\|",
    rf"\b(?:def|fn|function)\s*\w*\s*{_GENERICS}\s*\(" + r"(?:[^)]*,)?\s*" + _MUTABLE + r"open\s*[),:=]",
    r"\(\s*" + _LIST_BEFORE.format("()") + "open" + _LIST_AFTER.format("()", ",") + r"\)\s*=>",
)


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def open_is_file(body: Column | str) -> Column:
    """A call ``.open(`` or ``::open(`` opens a file; a bare ``open(`` does unless the body binds that name."""
    body = _text(body)
    before = F.regexp_extract_all(body, F.lit(_OPEN_CALL), F.lit(1))
    return F.arrays_overlap(before, F.array(F.lit("."), F.lit(":"))) | ((F.size(before) > 0) & ~body.rlike(_OPEN_BOUND))


def _tagged(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(tag)) for tag, hit in pairs]))


def effects(body: Column | str) -> Column:
    """Ordered effect tags of a body; none for null."""
    text = _text(body)
    hits = [(tag, text.rlike("(?U)" + pattern)) for tag, pattern in EFFECTS]
    hits[0] = (hits[0][0], hits[0][1] | open_is_file(text))
    return _tagged(hits)


def risks(name: Column | str, signature: Column | str, body: Column | str) -> Column:
    """Ordered risk tags of name, signature and body together."""
    text = F.concat_ws("\n", _text(name), _text(signature), _text(body))
    return _tagged([(tag, text.rlike("(?U)" + pattern)) for tag, pattern in RISKS])


def cost_hint(body: Column | str) -> Column:
    """Loops, allocations and twice the I/O calls."""
    text = _text(body)
    count = lambda p: F.regexp_count(text, F.lit("(?U)" + p)).cast("long")
    return count(LOOPS) + count(ALLOCATIONS) + 2 * count(IO_CALLS)


_DROPPED_STARTS = ("#", "//", "/*", '"""', "'''", "def ", "fn ", "pub fn ", "export ", "function ")
_DROPPED_LINES = ("}", "{", "):", ") {", ") -> None:", ") -> None {")
_STUBS = ("pass", "...", "return", "return None", "return;", "NotImplemented")


def core_lines(body: Column | str) -> Column:
    """Trimmed lines that are neither blank, comments, signatures nor lone brackets."""
    lines = F.transform(F.split(_text(body), "\r?\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))

    def kept(x: Column) -> Column:
        drop = (x == "") | x.isin(*_DROPPED_LINES)
        for start in _DROPPED_STARTS:
            drop = drop | x.startswith(start)
        return ~drop

    return F.filter(lines, kept)


def hollow_reason(body: Column | str, docstring: Column | str) -> Column:
    """empty_body, doc_oversells, stub or '' for a body and its documentation; lengths are in bytes."""
    core, doc = core_lines(body), _text(docstring)
    joined = F.array_join(core, " ")
    blank = (F.size(core) == 0) | F.btrim(joined).rlike(r"(?i)^(?:\.\.\.|;\s*|pass|return|return \(\)|return None|return;| \{\s*\})$")
    oversold = (F.octet_length(doc) > 80) & (F.octet_length(joined) < 40)
    stub = (F.size(core) <= 2) & F.forall(core, lambda x: x.isin(*_STUBS) | x.startswith("raise NotImplemented"))
    return F.when(blank, "empty_body").when(oversold, "doc_oversells").when(stub, "stub").otherwise("")
