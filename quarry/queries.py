"""Queries over the driver's tables, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import bindings as B
from quarry.functions import names, paths, tags, vectors
from quarry.operators import clones, dead, embed, graph, history, index, issues, metrics, profile, rank, slices
from quarry.operators import names as name_health
from quarry.plans import review
from quarry.sources import tree
from quarry.sources.shared import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- shared parts of the Spark side ---------------------------------------------------------------


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return B.rows(spark, d, B.SYMBOLS).drop("language")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return B.rows(spark, d, B.FILES)


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_calls(B.rows(spark, d, B.CALLS), _symbols(spark, d), _files(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Resolved calls, written once for the query, as an index has them."""
    return materialize(_resolved(spark, d), "edges")


def _full(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    """Symbols with effects, cost and fans."""
    tagged = _symbols(spark, d).withColumns({"effects": tags.effects("body"), "cost_hint": tags.cost_hint("body")})
    return graph.with_fans(tagged, _edges(spark, d) if edges is None else edges)


def _ranked(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    return rank.compute_rank(_files(spark, d), _symbols(spark, d), _edges(spark, d) if edges is None else edges)


def _order(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return rank.reading_order(_full(spark, d, edges), _ranked(spark, d, edges))


def _prints(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return name_health.with_fingerprints(_full(spark, d, edges), edges)


def _log(spark: SparkSession, d: str) -> DataFrame:
    return B.rows(spark, d, B.LOG)


def _history_files(log: DataFrame) -> DataFrame:
    return log.select(F.col("path").alias("relpath")).distinct().withColumn("is_test", F.lit(False))


def _all_issues(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    files = _files(spark, d).select("relpath", "is_test").unionByName(_history_files(log))
    full = materialize(_full(spark, d).drop("body", "docstring", "signature"), "full")
    return issues.find_issues(full, files, history.coupling(log))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return B.rows(spark, d, B.VECTORS)


# --- shared parts of the SQL side -----------------------------------------------------------------

_GENERIC = ", ".join(f"'{x}'" for x in sorted(names.GENERIC))


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


S = f"s AS MATERIALIZED ({B.duck(B.SYMBOLS)})"
FI = f"f AS MATERIALIZED ({B.duck(B.FILES)})"
C = f"c AS MATERIALIZED ({B.duck(B.CALLS)})"
LOG = f"log AS MATERIALIZED ({B.duck(B.LOG)})"
V = f"v AS ({B.duck(B.VECTORS)})"
D = f"d AS ({B.duck(B.DOCUMENTS)})"


def _pick(own: str, near: str, wide: str) -> str:
    return f"CASE WHEN nf.n = 1 THEN {own} WHEN nf.n > 1 OR lower(c.callee) IN ({_GENERIC}) THEN NULL WHEN nl.n = 1 THEN {near} WHEN nl.n > 1 OR nn.n > 1 THEN NULL ELSE {wide} END"


EDGES = f"""nf AS (SELECT name, relpath, count(*) AS n, min(ord) AS o FROM s GROUP BY ALL), nl AS (SELECT name, language, count(*) AS n, min(relpath) AS r, min(ord) AS o FROM s GROUP BY ALL),
nn AS (SELECT name, count(*) AS n, min(relpath) AS r, min(ord) AS o FROM s GROUP BY ALL),
e AS MATERIALIZED (SELECT c.relpath AS src_relpath, c.ord AS src_ord, {_pick("c.relpath", "nl.r", "nn.r")} AS dst_relpath, {_pick("nf.o", "nl.o", "nn.o")} AS dst_ord, c.callee AS dst_name
  FROM c JOIN f ON f.relpath = c.relpath LEFT JOIN nf ON nf.name = c.callee AND nf.relpath = c.relpath LEFT JOIN nl ON nl.name = c.callee AND nl.language = f.language LEFT JOIN nn ON nn.name = c.callee)"""


def _hits(pairs, text: str, first: str | None = None) -> str:
    cases = [f"CASE WHEN regexp_matches({text}, '{p}'){' OR ' + first if first and i == 0 else ''} THEN '{t}' END" for i, (t, p) in enumerate(pairs)]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


_BOUND = tags._OPEN_BOUND.removeprefix("(?U)")
_OPEN = f"(list_has_any(regexp_extract_all({{t}}, '{tags._OPEN_CALL.removeprefix('(?U)')}', 1), ['.', ':']) OR (len(regexp_extract_all({{t}}, '{tags._OPEN_CALL.removeprefix('(?U)')}', 1)) > 0 AND NOT regexp_matches({{t}}, '{_BOUND}')))"


def _effects(t: str) -> str:
    return _hits(tags.EFFECTS, t, _OPEN.format(t=t))


def _cost(t: str) -> str:
    return f"len(regexp_extract_all({t}, '{tags.LOOPS}')) + len(regexp_extract_all({t}, '{tags.ALLOCATIONS}')) + 2 * len(regexp_extract_all({t}, '{tags.IO_CALLS}'))"


FULL = f"""fo AS (SELECT src_relpath AS relpath, src_ord AS ord, count(*) AS fan_out FROM e GROUP BY ALL), fin AS (SELECT dst_relpath AS relpath, dst_ord AS ord, count(*) AS fan_in FROM e WHERE dst_ord IS NOT NULL GROUP BY ALL),
t AS MATERIALIZED (SELECT s.*, {_effects("s.body")} AS effects, {_cost("s.body")} AS cost_hint, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out
  FROM s LEFT JOIN fo USING (relpath, ord) LEFT JOIN fin USING (relpath, ord))"""

_TOKENS = "list_filter([lower(x) for x in regexp_extract_all({n}, '[0-9]+|[a-z]+|[A-Z][a-z]+|[A-Z]+')], lambda x: x NOT IN ('get', 'set', 'the', 'a'))"


def _tokens(n: str) -> str:
    """RE2 has no lookahead: 'HTTPServer' is split before its last capital first."""
    return _TOKENS.format(n=f"regexp_replace({n}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')")


_LINES = "list_filter([trim(x) for x in string_split({b}, chr(10))], lambda x: x <> '' AND x NOT IN ('}}', '{{', '):', ') {{', ') -> None:', ') -> None {{') AND NOT regexp_matches(x, '^(#|//|/\\*|\"\"\"|''''''|def |fn |pub fn |export |function )'))"


def _hollow(b: str, doc: str) -> str:
    core = _LINES.format(b=b)
    joined = f"array_to_string({core}, ' ')"
    return f"""CASE WHEN len({core}) = 0 OR regexp_matches(lower(trim({joined})), '^(pass|\\.\\.\\.|return|return none|return;|return \\(\\)| \\{{\\s*\\}}|;\\s*)$') THEN 'empty_body'
      WHEN strlen({doc}) > 80 AND strlen({joined}) < 40 THEN 'doc_oversells'
      WHEN len({core}) <= 2 AND len(list_filter({core}, lambda x: NOT (x IN ('pass', '...', 'return', 'return None', 'return;', 'NotImplemented') OR starts_with(x, 'raise NotImplemented')))) = 0 THEN 'stub' ELSE '' END"""


def _pagerank(rounds: int = 40) -> str:
    """node(id, base) and edge(src, dst, n) to pr(id, p), one CTE a round."""
    out = ["deg AS (SELECT src, sum(n) AS k FROM edge GROUP BY src)", "w AS MATERIALIZED (SELECT src, dst, n / k AS w FROM edge JOIN deg USING (src))", "r0 AS (SELECT id, base AS p FROM node)"]
    for i in range(1, rounds + 1):
        out.append(f"r{i} AS MATERIALIZED (SELECT node.id, 0.15 * base + 0.85 * coalesce(x.p, 0) AS p FROM node LEFT JOIN (SELECT dst, sum(p * w) AS p FROM w JOIN r{i - 1} ON id = src GROUP BY dst) x ON x.dst = node.id)")
    return ", ".join([*out, f"pr AS (SELECT id, p FROM r{rounds})"])


RANK = f"""cog AS (SELECT relpath, sum(cognitive)::BIGINT AS cognitive, sum(cyclomatic)::BIGINT AS cyclomatic, count(*) AS symbols FROM s GROUP BY relpath),
edge AS (SELECT src_relpath AS src, dst_relpath AS dst, count(*) AS n FROM e WHERE dst_relpath IS NOT NULL AND dst_relpath <> src_relpath GROUP BY ALL),
pers AS (SELECT relpath, 5.0 * count(*) AS w FROM s WHERE is_entry GROUP BY relpath), node AS (SELECT f.relpath AS id, coalesce(w, 0) / greatest((SELECT sum(w) FROM pers), 1) AS base FROM f LEFT JOIN pers USING (relpath)),
{_pagerank()},
k AS MATERIALIZED (SELECT f.*, coalesce(cognitive, 0) AS cognitive, coalesce(cyclomatic, 0) AS cyclomatic, coalesce(symbols, 0) AS symbols, p AS pagerank,
  (1.0 + churn) * (1.0 + coalesce(cognitive, 0) / 10) * CASE WHEN profile_total <> 0 THEN 1 + profile_total ELSE 1 END AS hotspot FROM f JOIN pr ON pr.id = f.relpath LEFT JOIN cog USING (relpath))"""

PRINTS = """cl AS (SELECT src_relpath AS relpath, src_ord AS ord, list_sort(list(dst_name))[1:20] AS callees FROM e GROUP BY ALL),
g AS MATERIALIZED (SELECT t.*, list_sort(effects) AS fe, coalesce(callees, []) AS fc FROM t LEFT JOIN cl USING (relpath, ord))"""


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def _overlap(a: str, b: str) -> str:
    return f"(0.4 * {_jac(a + '.fe', b + '.fe')} + 0.4 * {_jac(a + '.fc', b + '.fc')} + 0.2 * (1 - least(abs({a}.cyclomatic - {b}.cyclomatic) / 20, 1)))"


COUPLING = """touch AS (SELECT DISTINCT "commit", path FROM log), small AS (SELECT "commit" FROM touch GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), rev AS (SELECT path, count(*) AS n FROM log GROUP BY path),
cp AS MATERIALIZED (SELECT file_a, file_b, shared, shared / least(a.n, b.n) AS strength FROM (SELECT x.path AS file_a, y.path AS file_b, count(*) AS shared FROM touch x JOIN touch y ON x."commit" = y."commit" AND x.path < y.path
  WHERE x."commit" IN (FROM small) GROUP BY ALL) JOIN rev a ON a.path = file_a JOIN rev b ON b.path = file_b WHERE a.n >= 3 AND b.n >= 3 AND shared >= 2 AND shared / least(a.n, b.n) >= 0.3)"""

_DOCS = "regexp_matches(lower({p}), '(^|/)(docs?)(/|$)')"
ISSUES = f"""pf AS (SELECT relpath FROM f WHERE NOT is_test), q AS (SELECT t.*, greatest(end_line - start_line + 1, 1) AS loc FROM t JOIN pf USING (relpath) WHERE NOT t.is_test),
q2 AS (SELECT *, cognitive * (1 + fan_out / 5) * (1 + ln(loc) / ln(80)) AS god FROM q),
i AS MATERIALIZED (SELECT relpath, ord, 'god_function' AS kind, printf('god function cognitive=%d fan_out=%d loc=%d', cognitive, fan_out, loc) AS detail, god::DOUBLE AS score FROM q2 WHERE (cognitive >= 15 OR god >= 40) AND NOT {_DOCS.format(p="relpath")}
  UNION ALL SELECT relpath, ord, 'effect_in_core', 'I/O ["' || array_to_string(list_filter(effects, lambda x: x IN ('filesystem', 'network', 'db', 'process')), '", "') || '"] mixed into core (fan_in=' || fan_in || ')', fan_in FROM q
    WHERE fan_in >= 2 AND len(list_filter(effects, lambda x: x IN ('filesystem', 'network', 'db', 'process'))) > 0 AND NOT regexp_matches(relpath, 'cli\\.py|store\\.py|profile\\.py|git_hist\\.py|/io/|/db/|http') AND NOT regexp_matches(lower(relpath), '(^|/)(ui|scripts|tools|bin|docs?)(/|$)')
  UNION ALL SELECT relpath, NULL, 'god_module', 'god module symbols=' || count(*) || ' cognitive=' || sum(cognitive), sum(cognitive) FROM s JOIN pf USING (relpath) WHERE NOT {_DOCS.format(p="relpath")} GROUP BY relpath HAVING sum(cognitive) >= 40 OR count(*) >= 20
  UNION ALL SELECT file_a, NULL, 'shotgun_surgery', file_a || ' <-> ' || file_b || ' shared=' || shared, strength FROM cp WHERE strength >= 0.4 AND split_part(file_a, '/', 1) <> split_part(file_b, '/', 1))"""

CODE = (S, FI, C, EDGES)


# --- files, inventory, paths ----------------------------------------------------------------------


@query(_with(FI) + "SELECT language, count(*) AS n, sum(loc)::BIGINT AS loc FROM f GROUP BY language")
def inventory_languages(spark, d):
    return metrics.languages(_files(spark, d))


@query(
    _with(S, FI)
    + """SELECT count(*) FILTER (NOT is_test) AS prod_files, count(*) FILTER (is_test) AS test_files, coalesce(sum(loc) FILTER (NOT is_test), 0)::BIGINT AS prod_loc, coalesce(sum(loc) FILTER (is_test), 0)::BIGINT AS test_loc,
    coalesce(sum(tokens) FILTER (NOT is_test), 0)::BIGINT AS tokens, (SELECT count(*) FROM s WHERE is_public AND NOT is_test) AS public_symbols, round(coalesce(sum(loc) FILTER (is_test), 0) / greatest(sum(loc) FILTER (NOT is_test), 1), 3) AS test_to_code FROM f"""
)
def inventory_scalars(spark, d):
    return metrics.inventory(_files(spark, d), _symbols(spark, d))


@query(_with(S, FI) + "SELECT name, signature, relpath, start_line FROM s WHERE is_entry AND relpath IN (SELECT relpath FROM f WHERE NOT is_test)")
def entry_points(spark, d):
    return metrics.entry_points(_files(spark, d), _symbols(spark, d))


@query(
    f"""SELECT relpath, CASE lower(regexp_extract(relpath, '\\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'tsx' THEN 'typescript' END AS language, sha256(content) AS digest,
    len(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''))::BIGINT AS loc, strlen(content)::BIGINT AS size,
    regexp_matches(relpath, '(^|/)tests/|(^|/)test_[^/]*$|_test\\.py$') AS is_test, len(regexp_extract_all(translate(content, '/.', '  '), '[^\\s\\x{{a0}}\\x{{85}}\\x0b]+'))::BIGINT AS tokens FROM ({B.duck(B.PAGES)})"""
)
def file_metrics(spark, d):
    return metrics.with_file_metrics(B.rows(spark, d, B.PAGES))


@query(f"SELECT relpath FROM ({B.duck(B.PAGES)}) WHERE NOT regexp_matches(relpath, '(^|/)[^/]*\\.rs$') AND NOT regexp_matches(relpath, '^web/p.?\\.py$') AND NOT regexp_matches(relpath, '(^|/)p[13579][^/]*$')")
def gitignore_filter(spark, d):
    patterns = paths.ignore_patterns("# generated\n*.rs\nweb/p?.py/\n\np[13579]*\n")
    pages = B.rows(spark, d, B.PAGES).select("relpath")
    return pages.filter(~paths.is_ignored(F.col("relpath"), patterns))


@query("SELECT p_type AS relpath, p_brand AS name, p_size::BIGINT AS n FROM part WHERE contains(lower(p_type || ' ' || p_brand || ' ' || p_size), 'm brand#1')")
def row_search(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("relpath"), F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("n"))
    return metrics.search_rows(part, "M brand#1")


@query(_with(S) + "SELECT relpath, ord, cognitive FROM s ORDER BY cognitive DESC, relpath, ord LIMIT 200 OFFSET 200")
def explorer_page(spark, d):
    rows = _symbols(spark, d).select("relpath", "ord", "cognitive")
    return metrics.page(rows, [F.desc("cognitive"), "relpath", "ord"], 1)


@query(_with(*CODE) + "SELECT 'files' AS name, count(*) AS n FROM f UNION ALL SELECT 'symbols', count(*) FROM s UNION ALL SELECT 'edges', count(*) FROM e")
def scan_summary(spark, d):
    return metrics.table_counts(files=_files(spark, d), symbols=_symbols(spark, d), edges=_edges(spark, d))


@query(_with(S) + "SELECT name, count(*) AS n FROM s GROUP BY name")
def name_occurrences(spark, d):
    return metrics.name_occurrences(_symbols(spark, d))


@query(
    """WITH a AS (SELECT doc_id % 400 AS k, md5(text) AS h, doc_id FROM documents), n AS (SELECT 'd' || doc_id AS relpath, md5(text) AS digest FROM documents WHERE doc_id % 7 <> 0),
    o AS (SELECT 'd' || doc_id AS relpath, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE md5(text) END AS digest FROM documents WHERE doc_id % 3 <> 0)
    SELECT coalesce(n.relpath, o.relpath) AS relpath, CASE WHEN n.relpath IS NULL THEN 'removed' WHEN n.digest = o.digest THEN 'reused' ELSE 'dirty' END AS state FROM n FULL JOIN o ON n.relpath = o.relpath"""
)
def index_changes(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("relpath"), F.md5("text").alias("digest"))
    stored = docs.filter("doc_id % 3 <> 0").withColumn("digest", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("digest")))
    return index.changes(docs.filter("doc_id % 7 <> 0"), stored)


@query(
    "SELECT CAST(k AS VARCHAR) AS key, v AS value FROM (SELECT c_custkey AS k, coalesce(s_name, c_name) AS v FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer))"
)
def meta_upsert(spark, d):
    old = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    new = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("value"))
    return index.upsert(old, new)


@query(_with(*CODE, "gone AS (SELECT relpath FROM f WHERE churn >= 12)") + "SELECT src_relpath, src_ord, dst_name FROM e WHERE src_relpath NOT IN (FROM gone) AND (dst_relpath IS NULL OR dst_relpath NOT IN (FROM gone))")
def cascade_delete(spark, d):
    gone = _files(spark, d).filter("churn >= 12").select("relpath")
    return index.without_files(_edges(spark, d), gone, "src_relpath", "dst_relpath").select("src_relpath", "src_ord", "dst_name")


@query(_with(S) + "SELECT relpath, arg_max(name, ord) AS name FROM s GROUP BY relpath")
def dedupe_last(spark, d):
    return index.dedupe_files(_symbols(spark, d).select("relpath", "name", "ord"), "ord").select("relpath", "name")


# --- tags -----------------------------------------------------------------------------------------


@query(_with(S) + f"SELECT relpath, ord, array_to_string({_effects('body')}, ',') AS effects FROM s")
def effect_tags(spark, d):
    return _symbols(spark, d).select("relpath", "ord", F.array_join(tags.effects("body"), ",").alias("effects"))


@query(_with(S) + f"SELECT relpath, ord, array_to_string({_hits(tags.RISKS, 'name || chr(10) || signature || chr(10) || body')}, ',') AS risks FROM s WHERE len({_hits(tags.RISKS, 'name || chr(10) || signature || chr(10) || body')}) > 0")
def risk_tags(spark, d):
    rows = _symbols(spark, d).withColumn("risks", tags.risks("name", "signature", "body"))
    return rows.filter(F.size("risks") > 0).select("relpath", "ord", F.array_join("risks", ",").alias("risks"))


@query(_with(S) + f"SELECT relpath, ord, ({_cost('body')})::BIGINT AS cost_hint FROM s")
def cost_hints(spark, d):
    return _symbols(spark, d).select("relpath", "ord", tags.cost_hint("body").alias("cost_hint"))


@query(_with(S, FI) + f"SELECT relpath, ord, reason FROM (SELECT s.relpath, ord, {_hollow('body', 'docstring')} AS reason FROM s JOIN f USING (relpath) WHERE NOT s.is_test AND NOT f.is_test) WHERE reason <> ''")
def hollow_symbols(spark, d):
    return dead.hollow_symbols(_symbols(spark, d), _files(spark, d)).select("relpath", "ord", "reason")


@query(f"SELECT page_id, array_to_string({_effects('html')}, ',') AS effects, array_to_string({_hits(tags.RISKS, 'html')}, ',') AS risks, ({_cost('html')})::BIGINT AS cost_hint FROM pages")
def page_tags(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    # RE2's word boundaries are ASCII; the pages' markup is what matches, and it is ASCII
    return pages.select("page_id", F.array_join(tags.effects("html"), ",").alias("effects"), F.array_join(tags.risks(F.lit(""), F.lit(""), "html"), ",").alias("risks"), tags.cost_hint("html").alias("cost_hint"))


# --- graph ----------------------------------------------------------------------------------------


@query(_with(*CODE) + "SELECT src_relpath, src_ord, dst_relpath, dst_ord, dst_name FROM e")
def call_edges(spark, d):
    return _resolved(spark, d).drop("kind")


@query(
    _with(S, FI, f"h AS ({B.duck(B.IMPORTS)})")
    + """SELECT h.relpath AS src_relpath, f.relpath AS dst_relpath, stem AS dst_name FROM (SELECT relpath, split_part(list_extract(string_split(trim(module_hint, '"'), '/'), -1), '.', 1) AS stem FROM h) h
    JOIN f ON stem <> '' AND (ends_with(f.relpath, '/' || stem || '.py') OR ends_with(f.relpath, '/' || stem || '.ts') OR ends_with(f.relpath, '/' || stem || '.rs') OR f.relpath = stem || '.py')"""
)
def import_edges(spark, d):
    return graph.resolve_imports(B.rows(spark, d, B.IMPORTS), _files(spark, d)).select("src_relpath", "dst_relpath", "dst_name")


@query(_with(*CODE, FULL) + "SELECT relpath, ord, fan_in, fan_out FROM t")
def fan_counts(spark, d):
    return graph.with_fans(_symbols(spark, d), _edges(spark, d)).select("relpath", "ord", "fan_in", "fan_out")


@query(_with(S, C) + "SELECT s.relpath, s.ord, o.callee FROM (SELECT c.relpath, a.name AS owner, c.callee FROM c JOIN s a ON a.relpath = c.relpath AND a.ord = c.ord) o JOIN s ON s.relpath = o.relpath AND s.name = o.owner")
def owner_calls(spark, d):
    symbols = _symbols(spark, d)
    calls = B.rows(spark, d, B.CALLS).join(symbols.select("relpath", "ord", F.col("name").alias("owner")), ["relpath", "ord"]).select("relpath", "owner", "callee")
    return graph.attach_calls(symbols, calls)


@query(_with(*CODE, FULL) + "SELECT relpath, ord, name FROM t WHERE fan_in = 0 AND NOT is_entry AND NOT is_test AND name NOT IN ('app', 'cli', 'main', 'run', 'setup') AND relpath IN (SELECT relpath FROM f WHERE NOT is_test)")
def dead_symbols(spark, d):
    return dead.dead_symbols(graph.with_fans(_symbols(spark, d), _edges(spark, d)), _files(spark, d)).select("relpath", "ord", "name")


@query(_with(*CODE) + "SELECT relpath, loc FROM f WHERE NOT is_test AND NOT EXISTS (SELECT 1 FROM e WHERE e.dst_relpath = f.relpath) AND NOT EXISTS (SELECT 1 FROM s WHERE s.is_entry AND s.relpath = f.relpath)")
def dead_files(spark, d):
    return dead.dead_files(_files(spark, d), _symbols(spark, d), _edges(spark, d)).select("relpath", "loc")


_NATIONS = """nat AS MATERIALIZED (SELECT 'n' || c_nationkey AS src, 'n' || s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
edge AS (SELECT src, dst, n FROM nat), node AS (SELECT 'n' || n_nationkey AS id, 1 / (SELECT count(*) FROM nation) AS base FROM nation)"""


@query("WITH " + _NATIONS + ", " + _pagerank() + " SELECT id AS relpath, round(p, 9) AS pagerank FROM pr")
def pagerank_nations(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    lines = read("lineitem").join(read("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(read("customer"), F.col("c_custkey") == F.col("o_custkey")).join(read("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    edges = lines.select(node("c_nationkey").alias("src_relpath"), node("s_nationkey").alias("dst_relpath"))
    scores = graph.pagerank(read("nation").select(node("n_nationkey").alias("relpath")), graph.file_graph(edges))
    return scores.select("relpath", F.round("pagerank", 9).alias("pagerank"))


@query(_with(*CODE, RANK) + "SELECT relpath, round(pagerank, 9) AS pagerank, round(hotspot, 6) AS hotspot, cognitive, cyclomatic, symbols FROM k")
def file_rank(spark, d):
    return rank.file_order(_ranked(spark, d)).select("relpath", F.round("pagerank", 9).alias("pagerank"), F.round("hotspot", 6).alias("hotspot"), "cognitive", "cyclomatic", "symbols")


_READING = f"""top AS (SELECT t.*, pagerank, t.is_entry::INT * 3.0 + pagerank * 10 + t.cognitive * 0.2 + fan_in * 0.3 AS sc FROM t JOIN k ON k.relpath = t.relpath WHERE NOT k.is_test AND NOT t.is_test ORDER BY sc DESC, t.relpath, t.ord LIMIT 300),
one AS (SELECT *, row_number() OVER (PARTITION BY relpath, name ORDER BY sc DESC, relpath, ord) AS u FROM top WHERE lower(name) NOT IN ({_GENERIC}) OR is_entry),
ro AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sc DESC, relpath, ord) AS position, * FROM one WHERE u = 1 ORDER BY sc DESC, relpath, ord LIMIT 15)"""


@query(
    _with(*CODE, FULL, RANK, _READING)
    + """SELECT position::INT AS position, relpath, ord, name, coalesce(nullif(array_to_string(list_filter([CASE WHEN is_entry THEN 'entry point' END, CASE WHEN fan_in > 2 THEN 'used by ' || fan_in || ' callers' END, CASE WHEN cognitive >= 8 THEN 'cognitive complexity ' || cognitive END,
    CASE WHEN pagerank > 0.05 THEN 'high graph centrality' END], lambda x: x IS NOT NULL), ', '), ''), 'ranked by PageRank and complexity') AS why FROM ro"""
)
def reading_order(spark, d):
    return _order(spark, d).select("position", "relpath", "ord", "name", "why")


# --- names ----------------------------------------------------------------------------------------


@query(_with(S) + f"SELECT relpath, ord, array_to_string({_tokens('name')}, ' ') AS tokens, len({_tokens('name')})::INT AS n FROM s")
def name_tokens(spark, d):
    t = names.tokenize(F.col("name"))
    return _symbols(spark, d).select("relpath", "ord", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


_STEM = "CASE WHEN len(k) = 0 THEN '' WHEN len(k) = 1 OR k[-1] IN ('model', 'dto', 'service', 'handler', 'repo', 'view') THEN k[-1] ELSE k[1] END"


@query(_with(S) + f"SELECT {_STEM} AS stem, count(*) AS n FROM (SELECT {_tokens('name')} AS k FROM s) GROUP BY ALL")
def name_stems(spark, d):
    return _symbols(spark, d).select(names.stem(names.tokenize(F.col("name"))).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query(
    _with(*CODE, FULL, PRINTS, """j AS (SELECT relpath, ord, '{"callees": [' || array_to_string(['"' || x || '"' for x in fc], ', ') || '], "cognitive": ' || cognitive || ', "cyclomatic": ' || cyclomatic || ', "effects": [' || array_to_string(['"' || x || '"' for x in fe], ', ')
    || '], "fan_in": ' || fan_in || ', "fan_out": ' || fan_out || ', "name_len": ' || strlen(name) || '}' AS p FROM g)""")
    + "SELECT relpath, ord, sha1(p)[1:16] || '|' || p AS fingerprint FROM j"
)
def fingerprints(spark, d):
    return _prints(spark, d).select("relpath", "ord", "fingerprint")


@query(_with(S) + f"SELECT relpath, ord, len({_tokens('name')})::DOUBLE AS score FROM s WHERE len({_tokens('name')}) >= 5 AND cognitive >= 8")
def long_names(spark, d):
    return name_health.long_names(_symbols(spark, d)).select("relpath", "ord", "score")


@query(_with(*CODE, FULL, PRINTS) + f"SELECT a.relpath, a.ord, round(1 - {_overlap('a', 'b')}, 6) AS score FROM g a JOIN g b ON lower(a.name) = lower(b.name) AND (a.relpath < b.relpath OR (a.relpath = b.relpath AND a.ord < b.ord)) WHERE {_overlap('a', 'b')} < 0.35")
def homonyms(spark, d):
    counted = name_health.counted_homonyms(_prints(spark, d)).select("relpath", "ord", F.round("score", 6).alias("score"), "n")
    return name_health.repeated(counted)


@query(
    _with(*CODE, FULL, PRINTS, f"n AS MATERIALIZED (SELECT *, {_STEM} AS stem, coalesce(k[-1], '') AS last FROM (SELECT g.*, {_tokens('name')} AS k FROM g))")
    + f"""SELECT relpath, ord, stem FROM n WHERE stem IN (SELECT a.stem FROM n a JOIN n b ON a.stem = b.stem AND a.ord < b.ord WHERE a.stem <> '' AND a.stem NOT IN (SELECT stem FROM n WHERE last IN ('model', 'dto', 'service', 'handler', 'repo'))
    GROUP BY a.stem HAVING avg({_overlap('a', 'b')}) < 0.5)"""
)
def same_stem(spark, d):
    # at the usual 0.3 no stem of these tables stands out; 0.5 does
    rows = name_health.same_stem(_prints(spark, d), 0.5)
    return rows.select("relpath", "ord", F.regexp_extract("detail", "'(.*)'", 1).alias("stem"))


# --- clones and vectors ---------------------------------------------------------------------------

_WORDS = "list_filter(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{L}\\p{N}_]+'), lambda x: x NOT IN ('self', 'return', 'the', 'a'))"
_LEADS = ", ".join(f"'{x}'" for x in names._SKIPPED_LEADS)
TOKENS = f"""tk AS (SELECT relpath, ord, name, {_WORDS} AS k FROM d WHERE length(body) > 80),
sh AS MATERIALIZED (SELECT relpath, ord, substr(coalesce(list_filter(k, lambda x: x NOT IN ({_LEADS}))[1], name), 1, 12) AS bucket,
  CASE WHEN len(k) >= 5 THEN list_distinct([array_to_string(k[i:i + 4], ' ') for i in range(1, len(k) - 3)]) ELSE [array_to_string(k, ' ')] END AS s FROM tk WHERE len(k) > 0)"""


@query(_with(D, TOKENS) + "SELECT relpath, ord, bucket, len(s)::INT AS n, md5(array_to_string(list_sort(s), chr(10))) AS digest FROM sh")
def clone_shingles(spark, d):
    rows = clones.token_sets(B.rows(spark, d, B.DOCUMENTS))
    return rows.select("relpath", "ord", "bucket", F.size("shingles").alias("n"), F.md5(F.array_join(F.sort_array("shingles"), "\n")).alias("digest"))


@query(
    _with(D, TOKENS)
    + """SELECT a.relpath AS a_relpath, a.ord AS a_ord, b.relpath AS b_relpath, b.ord AS b_ord, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 9) AS score
    FROM sh a JOIN sh b ON a.bucket = b.bucket AND (a.relpath < b.relpath OR (a.relpath = b.relpath AND a.ord < b.ord)) WHERE len(list_intersect(a.s, b.s)) >= 0.55 * len(list_distinct(list_concat(a.s, b.s)))"""
)
def token_clones(spark, d):
    return clones.token_clones(B.rows(spark, d, B.DOCUMENTS)).withColumn("score", F.round("score", 9)).drop("method")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35")
def vector_clones(spark, d):
    # these vectors reach 0.51 at most, so the threshold is lower than the usual 0.92
    pairs = clones.vector_pairs(spark.read.parquet(f"{d}/embeddings.parquet"), 0.35, "vec_id", "embedding")
    return pairs.withColumn("score", F.round("score", 6))


@query("SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id = 7 AND b.vec_id <> 7 ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id LIMIT 10")
def similar_to(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return clones.similar_to(rows, rows.filter("vec_id = 7"), ["vec_id"], "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query(
    _with(V, "w AS (SELECT unnest(regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]+')) AS t FROM v WHERE embed_body IS NOT NULL)", "l AS (SELECT t, count(*) AS n FROM w GROUP BY t ORDER BY n DESC, t LIMIT 3)")
    + "SELECT 0 AS id, (SELECT string_agg(t, ' ' ORDER BY n DESC, t) FROM l) AS label, count(*) AS size, (SELECT string_agg(relpath || '::' || name, ',' ORDER BY relpath, ord) FROM (SELECT * FROM v ORDER BY relpath, ord LIMIT 12)) AS members FROM v WHERE embed_body IS NOT NULL"
)
def cluster_label(spark, d):
    return clones.label_cluster(_vectors(spark, d)).withColumn("members", F.array_join("members", ","))


_COS = "coalesce(list_cosine_similarity({a}::DOUBLE[], embed_body::DOUBLE[]), 0)"


def _mismatch(a: str, kind: str, ok: str) -> str:
    return f"SELECT relpath, ord, '{kind}' AS kind, round(x, 6) AS score FROM (SELECT *, {_COS.format(a=a)} AS x, row_number() OVER (ORDER BY {_COS.format(a=a)}) AS r FROM v) WHERE {ok} AND x <= (SELECT x FROM (SELECT {_COS.format(a=a)} AS x, row_number() OVER (ORDER BY {_COS.format(a=a)}) AS r FROM v) WHERE r = 1 + floor((SELECT count(*) - 1 FROM v) * 0.15 + 0.5))"


@query(_with(V) + _mismatch("embed_doc", "doc_body_mismatch", "docstring <> ''") + " UNION ALL " + _mismatch("embed_sig", "signature_body_mismatch", "true"))
def mismatches(spark, d):
    return clones.mismatches(_vectors(spark, d)).select("relpath", "ord", "kind", F.round("score", 6).alias("score"))


_BYTES = "[('0x' || substr(sha256(html), (i % 32) * 2 + 1, 2))::INT for i in range(0, 64)]"


@query(f"SELECT page_id, array_to_string([printf('%.3f', x / sqrt(list_sum([y * y for y in b]))) for x in b], ' ') AS vector FROM (SELECT page_id, {_BYTES} AS b FROM pages)")
def stub_vectors(spark, d):
    rows = embed.embed_symbols(spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.lit("n").alias("name"), F.col("html").alias("signature"), F.lit("").alias("docstring"), F.lit("").alias("body")), vectors.stub_doubles)
    return rows.select("page_id", F.array_join(F.transform("embed_sig", vectors.three_decimals), " ").alias("vector"))


# --- history --------------------------------------------------------------------------------------

HISTORY = """day AS (SELECT path, max(n) AS bursts FROM (SELECT path, ts // 86400 AS dd, count(*) AS n FROM log WHERE ts <> 0 GROUP BY ALL) GROUP BY path),
h AS MATERIALIZED (SELECT path, sum(added + deleted)::BIGINT AS churn, count(*) AS revisions, count(DISTINCT nullif(author, '')) AS authors, min(nullif(ts, 0)) AS first_ts, max(nullif(ts, 0)) AS last_ts FROM log GROUP BY path)"""


@query(_with(LOG, HISTORY) + "SELECT path, churn, revisions, authors, least(authors, 9) AS bus_factor, bursts, first_ts, last_ts, (((SELECT max(ts) FROM log) - first_ts) // 86400)::BIGINT AS age_days FROM h JOIN day USING (path)")
def file_history(spark, d):
    return history.file_history(_log(spark, d))


@query("SELECT event_type AS path, sum(x)::BIGINT AS churn, count(DISTINCT user_id) AS authors, (SELECT max(n) FROM (SELECT count(*) AS n FROM events e2 WHERE e2.event_type = e.event_type GROUP BY date_trunc('day', ts))) AS bursts FROM (SELECT *, 1 + event_id % 3 AS x FROM events) e GROUP BY event_type")
def event_history(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    log = e.select(F.col("event_id").cast("string").alias("commit"), F.col("user_id").cast("string").alias("author"), F.unix_timestamp("ts").alias("ts"), F.lit(1).alias("added"), (F.col("event_id") % 3).alias("deleted"), F.col("event_type").alias("path"))
    return history.file_history(log).select("path", "churn", "authors", "bursts")


@query(_with(LOG, COUPLING) + "SELECT file_a, file_b, shared, round(strength, 9) AS strength FROM cp")
def coupling(spark, d):
    return history.coupling(_log(spark, d)).withColumn("strength", F.round("strength", 9))


@query(_with(LOG) + 'SELECT count(DISTINCT "commit") AS commits FROM log')
def commit_count(spark, d):
    return history.commit_count(_log(spark, d))


@query(_with(LOG, HISTORY) + "SELECT path AS relpath, churn, authors, least(authors, 9) AS bus_factor, bursts FROM h JOIN day USING (path) ORDER BY churn DESC, path LIMIT 20")
def hot_files(spark, d):
    log = _log(spark, d)
    files = history.with_history(_history_files(log), log).withColumn("hotspot", F.lit(0.0))
    return history.hot_files(files).select("relpath", "churn", "authors", "bus_factor", "bursts")


# --- profiles -------------------------------------------------------------------------------------

_FRAMES = "w AS (SELECT 'mod.' || split_part(p_name, ' ', 1) || '::' || replace(p_name, ' ', '_') AS name, sum(l_quantity) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


def _frames(spark, d):
    part, line = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("part", "lineitem"))
    name = F.concat(F.lit("mod."), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("::"), F.translate("p_name", " ", "_"))
    return line.join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy(name.alias("name")).agg(F.sum("l_quantity").alias("weight"))


@query(_with(S, FI, _FRAMES) + "SELECT relpath, round(profile_total + coalesce(x, 0), 6) AS profile_total FROM f LEFT JOIN (SELECT relpath, sum(weight) AS x FROM s JOIN w ON s.name = split_part(w.name, '::', 2) GROUP BY relpath) USING (relpath)")
def profile_overlay(spark, d):
    return profile.overlay(_files(spark, d), _symbols(spark, d), _frames(spark, d)).select("relpath", F.round("profile_total", 6).alias("profile_total"))


@query(_with(S, _FRAMES) + "SELECT (SELECT count(*) FROM w) AS frames, (SELECT count(*) FROM s JOIN w ON s.name = split_part(w.name, '::', 2)) AS mapped")
def profile_mapped(spark, d):
    return profile.mapped(_symbols(spark, d), _frames(spark, d))


@query("SELECT event_type AS name, round(sum(value), 6) AS weight FROM events GROUP BY event_type")
def speedscope_profile(spark, d):
    """Each event is a profile of one sample, so that its JSON passes through the reader."""
    e = spark.read.parquet(f"{d}/events.parquet")
    frame = F.struct(F.array(F.struct(F.lit("root").alias("name")), F.struct(F.col("event_type").alias("name"))).alias("frames"))
    doc = F.to_json(F.struct(frame.alias("shared"), F.array(F.struct(F.array(F.array(F.lit(0), F.lit(1))).alias("samples"), F.array("value").alias("weights"))).alias("profiles")))
    return profile.speedscope_weights(e.select(doc.alias("json"))).withColumn("weight", F.round("weight", 6))


@query("SELECT event_type AS name, sum(user_id % 5)::DOUBLE AS weight FROM events GROUP BY event_type")
def cpuprofile_profile(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    node = F.struct(F.struct(F.col("event_type").alias("functionName")).alias("callFrame"), (F.col("user_id") % 5).alias("hitCount"))
    empty = F.struct(F.struct(F.lit("").alias("functionName")).alias("callFrame"), F.lit(9).cast("long").alias("hitCount"))
    return profile.cpuprofile_weights(e.select(F.to_json(F.struct(F.array(node, empty).alias("nodes"))).alias("json")))


# --- issues ---------------------------------------------------------------------------------------

_ISSUE_CTES = (*CODE, FULL, LOG, COUPLING, ISSUES)


@query(_with(*_ISSUE_CTES) + "SELECT relpath, ord, kind, detail, round(score, 6) AS score FROM i")
def all_issues(spark, d):
    return _all_issues(spark, d).withColumn("score", F.round("score", 6))


@query(_with(*_ISSUE_CTES) + "SELECT kind, count(*) AS n FROM i GROUP BY kind")
def issue_kinds(spark, d):
    return metrics.kind_counts(_all_issues(spark, d))


_LISTED = """fl AS (SELECT relpath, min(start_line) AS fl FROM s GROUP BY relpath), li AS MATERIALIZED (SELECT i.kind, detail, score, i.relpath, i.ord, coalesce(s.name, list_extract(string_split(i.relpath, '/'), -1)) AS name, coalesce(s.start_line, fl, 1) AS start_line
  FROM i LEFT JOIN s ON s.relpath = i.relpath AND s.ord = i.ord LEFT JOIN fl ON fl.relpath = i.relpath QUALIFY row_number() OVER (PARTITION BY i.kind ORDER BY score DESC, i.relpath, i.ord, detail) <= 5)"""


@query(_with(*_ISSUE_CTES, _LISTED) + "SELECT kind, detail, round(score, 6) AS score, relpath, name, start_line FROM li")
def listed_issues(spark, d):
    return issues.list_issues(_all_issues(spark, d), _symbols(spark, d), 5).withColumn("score", F.round("score", 6))


_SHOTGUN_FILES = """hf AS (SELECT path AS relpath FROM log WHERE NOT regexp_matches(path, '/(a[0-9]*[37]|b[0-9]*[57])\\.'))"""


@query(
    _with(f"log AS MATERIALIZED ({B.duck(B.PAIRED_LOG)})", COUPLING, _SHOTGUN_FILES)
    + """SELECT relpath, file_a || ' <-> ' || file_b || ' shared=' || shared AS detail, round(strength, 6) AS score FROM (SELECT *, CASE WHEN file_a IN (FROM hf) THEN file_a WHEN file_b IN (FROM hf) THEN file_b END AS relpath FROM cp)
    WHERE relpath IS NOT NULL AND strength >= 0.4 AND split_part(file_a, '/', 1) <> split_part(file_b, '/', 1) AND NOT regexp_matches(file_a || chr(10) || file_b, '(?m)^docs/|\\.md$')"""
)
def shotgun_issues(spark, d):
    log = B.rows(spark, d, B.PAIRED_LOG)
    indexed = log.select(F.col("path").alias("relpath")).distinct().filter(~F.col("relpath").rlike(r"/(a[0-9]*[37]|b[0-9]*[57])\."))
    return issues.shotgun_surgery(history.coupling(log), indexed).select("relpath", "detail", F.round("score", 6).alias("score"))


# --- parsers --------------------------------------------------------------------------------------

SRC = f"src AS ({B.duck(B.SOURCES)})"


def _parsed(spark, d):
    raw = B.rows(spark, d, B.SOURCES, spread=True)  # a few MB of parts are hundreds of MB of files to parse
    return tree.parse_files(raw.select("relpath", F.encode("content", "UTF-8").alias("content"), "language")), raw.select("relpath", F.lit(False).alias("is_test"))


_SYMBOL_ROWS = """
SELECT relpath, 0 AS ord, n AS name, 'function' AS kind, 'def ' || n || '(x, y=1)' AS signature, 'Adds.' AS docstring, 4 AS start_line, 9 + 2 * m AS end_line, 4 + m AS cyclomatic, 4 + m AS cognitive, 2 AS nesting, 2 AS nargs, true AS is_public, false AS is_entry, false AS is_test FROM src WHERE language = 'python'
UNION ALL SELECT relpath, 1, '_hid', 'method', 'class Box: def _hid(self, z)', '', 12 + 2 * m, 13 + 2 * m, 1, 0, 0, 1, false, false, false FROM src WHERE language = 'python'
UNION ALL SELECT relpath, 0, n, 'function', 'pub fn ' || n || '(x: i32, y: i32) -> i32', 'Adds.', 4, 11 + 3 * m, 3 + m, 3 + m, 2, 2, true, false, false FROM src WHERE language = 'rust'
UNION ALL SELECT relpath, 1, 'Box', 'struct', 'struct Box', '', 13 + 3 * m, 13 + 3 * m, 1, 0, 0, 0, false, false, false FROM src WHERE language = 'rust'
UNION ALL SELECT relpath, 2, 'checks', 'function', 'fn checks()', '', 16 + 3 * m, 18 + 3 * m, 1, 0, 0, 0, false, false, true FROM src WHERE language = 'rust'
UNION ALL SELECT relpath, 0, n, 'function', 'function ' || n || '(x: number, y: number)', '', 3, 8 + 3 * m, 3 + m, 2 + m, 1, 2, true, false, false FROM src WHERE language = 'typescript'
UNION ALL SELECT relpath, 1, 'run', 'function', 'run(q)', '', 11 + 3 * m, 11 + 3 * m, 1, 0, 0, 1, true, true, false FROM src WHERE language = 'typescript'
"""


@query(_with(SRC) + _SYMBOL_ROWS)
def parsed_symbols(spark, d):
    parsed, files = _parsed(spark, d)
    return tree.symbols_table(parsed, files).drop("body")


@query(
    _with(SRC)
    + """SELECT relpath, n AS owner, 'foo' AS callee FROM src, (SELECT unnest(range(0, 4)) AS j) WHERE j <= m UNION ALL SELECT relpath, n, 'bar' FROM src
    UNION ALL SELECT relpath, CASE language WHEN 'python' THEN '_hid' WHEN 'rust' THEN 'checks' ELSE 'run' END, CASE language WHEN 'python' THEN 'Box' WHEN 'rust' THEN n ELSE 'go' END FROM src"""
)
def parsed_calls(spark, d):
    return tree.owner_calls_table(_parsed(spark, d)[0])


@query(
    _with(SRC)
    + """SELECT relpath, unnest(CASE language WHEN 'python' THEN ['os', 'pkg', 'pkg', 'thing'] WHEN 'rust' THEN ['use std::io;'] ELSE ['../lib/' || a] END) AS module_hint FROM src"""
)
def parsed_imports(spark, d):
    return tree.import_facts_table(_parsed(spark, d)[0])


# --- slices ---------------------------------------------------------------------------------------

_ROOTS = "root AS (SELECT relpath, ord, name FROM s WHERE name = 'main')"
_REACH = """st AS MATERIALIZED (SELECT DISTINCT src_relpath AS r, src_ord AS o, dst_relpath AS r2, dst_ord AS o2 FROM e WHERE dst_ord IS NOT NULL),
walk(relpath, ord, depth) AS (SELECT relpath, ord, 0 FROM root UNION SELECT r2, o2, depth + 1 FROM walk JOIN st ON r = relpath AND o = ord WHERE depth < 4), nd AS MATERIALIZED (SELECT relpath, ord, min(depth) AS depth FROM walk GROUP BY ALL)"""


def _reached(spark, d):
    return slices.reach(_symbols(spark, d).filter("name = 'main'"), _edges(spark, d))


@query(_with(*CODE, _ROOTS, _REACH) + "SELECT relpath, ord, depth::INT AS depth FROM nd")
def slice_reach(spark, d):
    return _reached(spark, d)


@query(
    _with(*CODE, FULL, _ROOTS, _REACH)
    + "SELECT count(DISTINCT relpath) AS blast_radius, count(*) AS symbols, (SELECT array_to_string(list_sort(list(DISTINCT x)), ',') FROM (SELECT unnest(effects) AS x FROM t JOIN nd USING (relpath, ord))) AS effects, sum(cost_hint)::BIGINT AS cost_hint FROM t JOIN nd USING (relpath, ord)"
)
def slice_rollup(spark, d):
    return slices.rollup(_reached(spark, d), _full(spark, d)).withColumn("effects", F.array_join("effects", ","))


@query(_with(*CODE, _ROOTS, _REACH) + "SELECT DISTINCT dst_name FROM e JOIN nd ON nd.relpath = src_relpath AND nd.ord = src_ord WHERE dst_relpath IS NULL")
def slice_unresolved(spark, d):
    return slices.unresolved(_reached(spark, d), _edges(spark, d))


_ONE = "one AS (SELECT relpath, name FROM s WHERE ord = 13)"


@query(_with(*CODE, _ONE) + "SELECT s.relpath, s.ord, s.name, s.start_line, s.is_test FROM e JOIN one ON e.dst_name = one.name AND (e.dst_relpath = one.relpath OR e.dst_relpath IS NULL) JOIN s ON s.relpath = src_relpath AND s.ord = src_ord")
def slice_callers(spark, d):
    return slices.callers(_symbols(spark, d).filter("ord = 13"), _edges(spark, d), _symbols(spark, d), True)


@query(_with(*CODE, _ONE) + "SELECT s.name, s.relpath, s.start_line FROM e JOIN one ON e.dst_name = one.name AND (e.dst_relpath = one.relpath OR e.dst_relpath IS NULL) JOIN s ON s.relpath = src_relpath AND s.ord = src_ord WHERE s.is_test ORDER BY s.relpath, s.start_line, s.name LIMIT 20")
def slice_tests(spark, d):
    return slices.tests_of(_symbols(spark, d).filter("ord = 13"), _edges(spark, d), _symbols(spark, d))


_PARAMS = "[split_part(split_part(trim(x), ':', 1), '=', 1) for x in string_split(regexp_extract(signature, '(?s)^[^(]*\\((.*)\\)[^)]*$', 1), ',')]"
_P = f"list_filter([trim(x) for x in {_PARAMS}], lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$') AND x NOT IN ('self', 'cls'))"


@query(_with(*CODE, FULL) + f"SELECT relpath, ord, array_to_string(effects, ',') AS sinks, array_to_string({_P}, ',') AS params, CASE WHEN len(effects) > 0 THEN array_to_string(list_filter({_P}, lambda x: contains(body, x)), ',') ELSE '' END AS reach FROM t")
def slice_taint(spark, d):
    rows = slices.taint(_full(spark, d), F.col("effects"))
    return rows.select("relpath", "ord", *[F.array_join(c, ",").alias(n) for c, n in (("sinks", "sinks"), ("params", "params"), ("params_may_reach_sinks", "reach"))])


@query(_with(S) + "SELECT relpath, ord, name FROM s WHERE ord <> 13 AND (regexp_matches(signature, '(^|[^A-Za-z0-9_])Ledger([^A-Za-z0-9_]|$)') OR regexp_matches(body, '(^|[^A-Za-z0-9_])Ledger([^A-Za-z0-9_]|$)')) ORDER BY relpath, ord LIMIT 40")
def slice_type_uses(spark, d):
    symbols = _symbols(spark, d)
    root = symbols.filter("ord = 13").withColumns({"name": F.lit("Ledger"), "kind": F.lit("struct")})
    return slices.type_uses(root, symbols, root).select("relpath", "ord", "name")


@query(_with(S) + "SELECT relpath, ord, name FROM s WHERE name = 'main'")
def find_symbols(spark, d):
    return slices.find_symbols(_symbols(spark, d), "main").select("relpath", "ord", "name")


# --- review, reports ------------------------------------------------------------------------------

_FOLD = """o AS MATERIALIZED (SELECT conv_id, turn, 10 + length(text) // 100 AS cost FROM conversations),
fold AS (SELECT conv_id, turn, cost, cost AS load, 0 AS session FROM o WHERE turn = (SELECT min(turn) FROM o o2 WHERE o2.conv_id = o.conv_id) UNION ALL
  SELECT o.conv_id, o.turn, o.cost, CASE WHEN load + o.cost > 45 THEN o.cost ELSE load + o.cost END, CASE WHEN load + o.cost > 45 THEN session + 1 ELSE session END FROM fold JOIN o ON o.conv_id = fold.conv_id AND o.turn = fold.turn + 1)"""


@query("WITH RECURSIVE " + _FOLD + " SELECT conv_id, turn, session::INT AS session FROM fold")
def review_sessions(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", (10 + F.expr("length(text) div 100")).alias("cost"))
    return review.sessions(rows, ["conv_id"], ["turn"], F.col("cost")).select("conv_id", "turn", "session")


@query(_with(*CODE, FULL, RANK, _READING) + "SELECT position::INT AS position, 'Which side effects has `' || relpath || '::' || name || '`, and do they belong at a boundary?' AS question FROM ro WHERE position <= 8 UNION ALL SELECT position::INT, 'Could `' || name || '` in `' || relpath || '` be divided? Its cognitive complexity is ' || cognitive || '.' FROM ro WHERE position <= 8 AND cognitive >= 10")
def review_questions(spark, d):
    return review.reading_questions(_order(spark, d)).select("position", "question")


_MAP = """m AS MATERIALIZED (SELECT relpath, greatest(loc, 1)::DOUBLE AS size, row_number() OVER (ORDER BY relpath) AS r, sum(greatest(loc, 1)) OVER (ORDER BY relpath DESC)::DOUBLE AS remain FROM f),
box AS (SELECT 0::BIGINT AS r, ''::VARCHAR AS relpath, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS w, 0.0::DOUBLE AS h, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, 960.0::DOUBLE AS cw, 640.0::DOUBLE AS ch UNION ALL
  SELECT m.r, m.relpath, cx, cy, CASE WHEN cw >= ch THEN cw * size / remain ELSE cw END, CASE WHEN cw >= ch THEN ch ELSE ch * size / remain END, CASE WHEN cw >= ch THEN cx + cw * size / remain ELSE cx END, CASE WHEN cw >= ch THEN cy ELSE cy + ch * size / remain END,
    CASE WHEN cw >= ch THEN cw - cw * size / remain ELSE cw END, CASE WHEN cw >= ch THEN ch ELSE ch - ch * size / remain END FROM box JOIN m ON m.r = box.r + 1)"""


@query(_with(S, FI, _MAP) + "SELECT relpath, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(h, 4) AS h FROM box WHERE r > 0")
def heat_rectangles(spark, d):
    files = metrics.files_with_complexity(_files(spark, d), _symbols(spark, d)).withColumn("hotspot", F.lit(1.0))
    return review.heat_rectangles(files).select("relpath", *[F.round(c, 4).alias(c) for c in "xywh"])


@query(_with(S) + "SELECT relpath, ord, printf('#%02x%02x%02x', floor(40 + 200 * t)::INT, floor(130 - 40 * t)::INT, floor(100 - 20 * t)::INT) AS fill FROM (SELECT relpath, ord, cognitive / 36 AS t FROM s)")
def heat_colors(spark, d):
    return _symbols(spark, d).select("relpath", "ord", review.color(F.col("cognitive"), F.lit(36.0)).alias("fill"))


@query(_with(*CODE, FULL, PRINTS) + f"SELECT a.name, a.relpath, 'homonym' AS kind, printf('%.4f', round(1 - {_overlap('a', 'b')}, 9)) AS score, '' AS human_label FROM g a JOIN g b ON lower(a.name) = lower(b.name) AND (a.relpath < b.relpath OR (a.relpath = b.relpath AND a.ord < b.ord)) WHERE {_overlap('a', 'b')} < 0.35")
def label_rows(spark, d):
    prints = _prints(spark, d)
    flags = name_health.counted_homonyms(prints).withColumn("score", F.round("score", 9))
    return name_health.label_rows(flags, prints)


@query(_with(D, TOKENS) + """SELECT round(score, 9) AS score, 'token' AS method, ra || '::doc_' || la AS a, rb || '::doc_' || lb AS b FROM (SELECT a.relpath AS ra, b.relpath AS rb, x.lang AS la, y.lang AS lb, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS score
    FROM sh a JOIN sh b ON a.bucket = b.bucket AND (a.relpath < b.relpath OR (a.relpath = b.relpath AND a.ord < b.ord)) JOIN documents x ON x.doc_id = a.ord JOIN documents y ON y.doc_id = b.ord) WHERE score >= 0.55""")
def clone_rows(spark, d):
    docs = B.rows(spark, d, B.DOCUMENTS)
    return clones.clone_rows(clones.token_clones(docs), docs).withColumn("score", F.round("score", 9))
