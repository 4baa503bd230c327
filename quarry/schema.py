"""Schemas of the tables that operators consume and produce.

Files are keyed by relpath and symbols by (relpath, ord), where ord is the symbol's place in its file:
keys that depend on content alone, so that a retried task or a second scan finds the same ones.
"""

from __future__ import annotations

from pyspark.sql import types as T

FILES = "relpath string, language string, digest string, loc long, size long, is_test boolean, tokens long, ast_nodes long, pagerank double, hotspot double, churn long, authors long, bus_factor long, bursts long, age_days long, first_seen string, last_seen string, profile_self double, profile_total double"
SYMBOLS = "relpath string, ord int, name string, kind string, start_line long, end_line long, signature string, docstring string, body string, cyclomatic long, cognitive long, nesting long, nargs long, is_public boolean, is_entry boolean, is_test boolean, fan_in long, fan_out long, effects array<string>, risks array<string>, cost_hint long, fingerprint string, embed_sig array<float>, embed_doc array<float>, embed_body array<float>"
CALL_FACTS = "relpath string, ord int, callee string"
IMPORT_FACTS = "relpath string, module_hint string"
EDGES = "src_relpath string, src_ord int, dst_relpath string, dst_ord int, dst_name string, kind string"
CLONES = "a_relpath string, a_ord int, b_relpath string, b_ord int, score double, method string"
NAME_FLAGS = "relpath string, ord int, kind string, detail string, score double"
GIT_LOG = "commit string, author string, ts long, added long, deleted long, path string"
GIT_COUPLING = "file_a string, file_b string, shared long, strength double"
ISSUES = "relpath string, ord int, kind string, detail string, score double"
META = "key string, value string"

#: What the parser returns for one file.
EXTRACTED = "symbols array<struct<name:string,kind:string,start_line:long,end_line:long,signature:string,docstring:string,body:string,cyclomatic:long,cognitive:long,nesting:long,nargs:long,is_public:boolean,is_entry:boolean,is_test:boolean>>, calls array<struct<owner:string,callee:string>>, import_modules array<string>, ast_nodes long"

TABLES = {"files": FILES, "symbols": SYMBOLS, "call_facts": CALL_FACTS, "import_facts": IMPORT_FACTS, "edges": EDGES, "clones": CLONES, "name_flags": NAME_FLAGS, "git_coupling": GIT_COUPLING, "issues": ISSUES, "meta": META}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
