"""The driver's tables seen through the index's schemas.

Parts become symbols of generated code, lines of an order become calls from one part to the next,
orders become commits, and documents become bodies. Each binding is one SQL text that Spark and
DuckDB both run, so that an operator and its oracle start from the same rows; everything after it is
written twice. In the generated code ¤ stands for the symbol's name, ¶ for a line end, « » for braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_BODIES = (
    "def ¤(path):¶    with open(path) as f:¶        return f.read()",
    "def ¤(url):¶    data = requests.get(url)¶    for row in data:¶        print(row)",
    "def ¤():¶    pass",
    "def ¤(key):¶    global cache¶    cache = key¶    return cache",
    "fn ¤(x: i32) -> i32 «¶    let v = items.clone(x);¶    unsafe « ptr.read(v) »¶»",
    "fn ¤() «¶    let t = conn.execute(sql);¶    t.unwrap(v)¶»",
    "export function ¤(a) «¶  const open = (x) => x;¶  return open(a);¶»",
    "function ¤(a) «¶  return fetch(a).then(b => b.json());¶»",
    "def ¤(q):¶    return subprocess.run(q)",
    "def ¤(secret, password):¶    return hashlib.sha256(secret)",
    "def ¤(price, balance):¶    while price > 0:¶        price -= balance¶    return price",
    "def ¤(src):¶    tree = ast.parse(src)¶    return eval(src)",
    "fn ¤(s: &str) «¶    let text = read_to_string(s);¶    panic!(text)¶»",
    "def ¤():¶    ...",
    "def ¤(x: Any):¶    raise NotImplementedError",
    "def ¤(rows):¶    import sqlite3¶    for r in rows:¶        for c in r:¶            yield c",
    "fn ¤(n: Ledger) «¶    loop « alloc(n); to_vec(n); Vec::with(n) »¶»",
    "def ¤(doc):¶    return doc",
    "# comment only¶// another¶»",
    "async function ¤(p) «¶  await fs.readFile(p);¶  throw new Error(p);¶»",
    "def ¤(m):¶    alembic.run(m)¶    return json.loads(m)",
    "fn ¤(open: Handler) «¶    open(7);¶»",
    "fn ¤(p: &Path) «¶    OpenOptions::new().open(p)¶»",
    "",
)
_BODY = "CASE k % 24 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(_BODIES)) + " END"
_LONG_DOC = "Reads every entry, checks it twice, merges the parts that belong together and reports what is left."

SYMBOLS = f"""
SELECT relpath, CAST(k AS INT) AS ord, name, language, kind, start_line, start_line + z AS end_line, signature, docstring,
  replace(replace(replace(replace(body, '¤', name), '¶', chr(10)), '«', chr(123)), '»', chr(125)) AS body,
  1 + z % 13 AS cyclomatic, (z * 7 + k) % 37 AS cognitive, k % 6 AS nesting, k % 4 AS nargs, k % 6 <> 0 AS is_public,
  k % 17 = 0 OR name = 'main' AS is_entry, k % 19 = 0 OR folder = 'tests' AS is_test
FROM (SELECT *, folder || '/' || brand || ext AS relpath,
    CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' ELSE 'rust' END AS language,
    CASE WHEN k % 50 = 7 THEN 'main' WHEN k % 23 = 3 THEN 'get' WHEN k % 5 = 0 THEN a || '_' || b WHEN k % 5 = 1 THEN 'get_' || a || '_' || b || '_' || CAST(z AS STRING)
      WHEN k % 5 = 2 THEN a || upper(substr(b, 1, 1)) || substr(b, 2) || 'Model' WHEN k % 5 = 3 THEN b || '_' || a || '_with_' || t || '_of_' || brand ELSE a || 'HTTPServer' || CAST(z AS STRING) END AS name,
    CASE WHEN k % 13 = 0 THEN 'struct' WHEN k % 2 = 0 THEN 'function' ELSE 'method' END AS kind,
    (k % 40) * 10 + 1 AS start_line,
    CASE k % 4 WHEN 0 THEN 'def f(path, url: str = None, self)' WHEN 1 THEN 'fn f(&self, x: i32, n: Ledger) -> i32' WHEN 2 THEN 'function f()' ELSE 'class C: def f(cls, key = 1, *args)' END AS signature,
    CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'Short.' WHEN 2 THEN '{_LONG_DOC}' ELSE b END AS docstring,
    {_BODY} AS body
  FROM (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS z, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(replace(p_brand, '#', '')) AS brand, lower(p_type) AS t,
      CASE p_size % 7 WHEN 0 THEN 'core' WHEN 1 THEN 'ui' WHEN 2 THEN 'docs' WHEN 3 THEN 'io/db' WHEN 4 THEN 'tests' WHEN 5 THEN 'app' ELSE 'sim' END AS folder,
      CASE p_size % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.rs' END AS ext FROM {{part}}) x) y
"""

FILES = f"""
SELECT relpath, language, relpath LIKE 'tests/%' AS is_test, CAST(sum(end_line - start_line + 1) AS BIGINT) AS loc, count(*) * 7 AS tokens, max(cyclomatic) AS churn,
  CAST(count(*) % 3 AS DOUBLE) / 2 AS profile_total, CAST(count(*) % 3 AS DOUBLE) / 2 AS profile_self
FROM ({SYMBOLS}) s GROUP BY relpath, language
"""

_STEPS = """
SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM {lineitem}
"""

CALLS = f"""
SELECT a.relpath, a.ord, b.name AS callee FROM ({_STEPS}) c JOIN ({SYMBOLS}) a ON a.ord = c.src JOIN ({SYMBOLS}) b ON b.ord = c.dst
"""

IMPORTS = f"""
SELECT DISTINCT a.relpath, '"../lib/' || replace(replace(replace(b.relpath, '.py', ''), '.ts', ''), '.rs', '') || '.x"' AS module_hint
FROM ({_STEPS}) c JOIN ({SYMBOLS}) a ON a.ord = c.src JOIN ({SYMBOLS}) b ON b.ord = c.dst WHERE a.relpath <> b.relpath
"""

#: {seconds} is the engine's way from a timestamp to Unix seconds.
LOG = """
SELECT CAST(CAST(floor(o_orderkey / 3.0) AS BIGINT) AS STRING) AS commit, CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'dev' || CAST(o_custkey % 23 AS STRING) END AS author, CAST({seconds} AS BIGINT) AS ts,
  CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted,
  CASE WHEN p_type < 'M' THEN 'core/' ELSE 'lib/' END || lower(p_type) || '.py' AS path
FROM {lineitem} l JOIN {orders} o ON o_orderkey = l_orderkey JOIN {part} p ON p_partkey = l_partkey
"""

#: Pairs of files that change together: in docs, in one folder, or far apart.
PAIRED_LOG = """
SELECT CAST(o_orderkey AS STRING) AS commit, 'dev' AS author, CAST({seconds} AS BIGINT) AS ts, CAST(1 AS BIGINT) AS added, CAST(0 AS BIGINT) AS deleted,
  CASE side WHEN 0 THEN CASE o_custkey % 5 WHEN 0 THEN 'docs/a' ELSE 'core/a' END || CAST(o_custkey % 61 AS STRING) || '.py'
    ELSE CASE o_custkey % 3 WHEN 0 THEN 'core/b' WHEN 1 THEN 'web/b' ELSE 'lib/b' END || CAST(o_custkey % 61 AS STRING) || CASE o_custkey % 7 WHEN 0 THEN '.md' ELSE '.py' END END AS path
FROM {orders} CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1 AS side) sides
"""

_TEMPLATES = {
    "python": ("import os¶from pkg.¦ import thing¶¶def ¤(x, y=1):¶    \"\"\"Adds.\"\"\"¶    if x and y:¶        for i in x:¶            foo(i)¶", "    if x > 1:¶        foo(1)¶", "    return obj.bar(y)¶¶class Box:¶    def _hid(self, z):¶        return Box()¶"),
    "rust": ("use std::io;¶¶/// Adds.¶pub fn ¤(x: i32, y: i32) -> i32 «¶    if x > 1 «¶        for i in 0..y «¶            foo(i);¶        »¶    »¶", "    if x > 2 «¶        foo(1);¶    »¶", "    obj.bar(y)¶»¶¶struct Box « a: i32 »¶¶#[test]¶fn checks() «¶    assert!(¤(1, 2) == 3);¶»¶"),
    "typescript": ("import « a » from \"../lib/¦\";¶¶export function ¤(x: number, y: number) «¶  if (x && y) «¶    foo(x);¶  »¶", "  if (x > 1) «¶    foo(1);¶  »¶", "  return obj.bar(y);¶»¶¶class Box «¶  run(q) « return this.go(q); »¶»¶"),
}
_CONTENT = "CASE language " + " ".join(f"WHEN '{k}' THEN '{head}' || repeat('{part}', m) || '{tail}'" for k, (head, part, tail) in _TEMPLATES.items()) + " END"
#: A source file a part; its name n, and m more branches, tell what a parser must find.
SOURCES = f"""
SELECT relpath, language, n, m, a, replace(replace(replace(replace(replace({_CONTENT}, '¤', n), '¦', a), '¶', chr(10)), '«', chr(123)), '»', chr(125)) AS content
FROM (SELECT 'src/p' || CAST(p_partkey AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' ELSE '.ts' END AS relpath, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE 'typescript' END AS language,
  split_part(p_name, ' ', 1) || '_' || split_part(p_name, ' ', 2) AS n, split_part(p_name, ' ', 1) AS a, CAST(p_size % 4 AS INT) AS m FROM {{part}}) x
"""

DOCUMENTS = """
SELECT source AS relpath, CAST(d.doc_id AS INT) AS ord, 'doc_' || lang AS name, lang AS language, text AS body, '' AS signature, '' AS docstring, coalesce(toxic, 0) = 1 AS is_test
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

PAGES = "SELECT CASE page_id % 4 WHEN 0 THEN 'web/tests/p' WHEN 1 THEN 'web/p' WHEN 2 THEN 'p' ELSE 'web/test_p' END || CAST(page_id AS STRING) || CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' WHEN 2 THEN '.rs' WHEN 3 THEN '.md' ELSE '_test.py' END AS relpath, html AS content FROM {pages}"

VECTORS = """
SELECT 'v.py' AS relpath, CAST(a.vec_id AS INT) AS ord, 'vec_' || CAST(a.label AS STRING) AS name, CASE WHEN a.label % 3 = 0 THEN '' ELSE 'doc' END AS docstring,
  a.embedding AS embed_body, b.embedding AS embed_doc, c.embedding AS embed_sig
FROM {embeddings} a LEFT JOIN {embeddings} b ON b.vec_id = a.vec_id + 1 LEFT JOIN {embeddings} c ON c.vec_id = a.vec_id + 2
"""


def rows(spark: SparkSession, sf_dir: str, sql: str, spread: bool = False) -> DataFrame:
    """A binding in Spark. spread: its tables are dealt to all cores first, where little data makes much work."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    if spread:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
        used = {t: df.repartition(parts) for t, df in used.items()}
    return spark.sql(sql.replace("{seconds}", "unix_timestamp(o_orderdate)"), **used)


def duck(sql: str) -> str:
    """The same binding in DuckDB."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{seconds}", "epoch(o_orderdate)").replace("AS STRING", "AS VARCHAR").replace("commit", '"commit"')
