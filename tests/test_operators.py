from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators import clones, graph, history, index, issues, profile, rank
from quarry.operators import names as name_health
from quarry.plans import review


def calls_resolved(spark, callee, targets, src, languages):
    files = spark.createDataFrame([(f"f{k}", v) for k, v in languages.items()], "relpath string, language string")
    symbols = spark.createDataFrame([(f"f{f}", s, callee) for s, f in targets] + [(f"f{src}", 99, "caller")], "relpath string, ord int, name string")
    facts = spark.createDataFrame([(f"f{src}", 99, callee)], schema.CALL_FACTS)
    row = graph.resolve_calls(facts, symbols, files).first()
    return (row["dst_ord"], row["dst_relpath"]) if row["dst_ord"] is not None else None


@pytest.mark.parametrize(
    "callee,targets,src,want",
    [("new", [(7, 1), (8, 2)], 1, (7, "f1")), ("new", [(7, 1), (8, 2)], 9, None), ("find", [(9, 2)], 1, (9, "f2")), ("work", [(31, 2), (32, 2)], 1, None), ("work", [(33, 1), (34, 1)], 1, None), ("helper", [(5, 3), (6, 2)], 1, (6, "f2"))],
)
def test_call_targets(spark, callee, targets, src, want):
    assert calls_resolved(spark, callee, targets, src, {1: "python", 2: "python", 3: "rust", 9: "python"}) == want


def test_pagerank_distributed_equals_one_task(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(12)], "relpath string")
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 5 + j) % 12}", 1 + j) for i in range(10) for j in range(1, 4)], "src string, dst string, n long")
    weights = spark.createDataFrame([("n3", 5.0), ("n4", 10.0)], "relpath string, weight double")
    read = lambda df: {r["relpath"]: r["pagerank"] for r in df.collect()}
    one = read(graph.pagerank(nodes, edges, weights, rounds=7))
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", 3)
    many = read(graph.pagerank(nodes, edges, weights, rounds=7))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-12 for k in one)


def test_pagerank_of_nothing(spark):
    assert graph.pagerank(spark.createDataFrame([], "relpath string"), spark.createDataFrame([], "src string, dst string, n long")).count() == 0


def test_god_score(spark):
    row = spark.range(1).select(issues.god_score(F.lit(29), F.lit(3), F.lit(21)).alias("a"), issues.god_score(F.lit(10), F.lit(0), F.lit(80)).alias("b")).first()
    assert round(row["a"], 4) == 78.6376 and row["b"] == pytest.approx(20)


def issue_table(spark, n):
    return spark.createDataFrame([("a.py", i, "god_function", f"d{i}", float(i)) for i in range(n)] + [("a.py", None, "god_module", "m", 50.0), (None, None, "shotgun_surgery", "x/y.py <-> b.py shared=2", 0.5), ("a.py", 0, "effect_in_core", "e", 3.0)], schema.ISSUES)


@pytest.mark.parametrize("limit,count", [(40, 43), (5, 8), (-1, 53), (0, 0)])
def test_issue_limits(spark, limit, count):
    symbols = spark.createDataFrame([("a.py", i, f"f{i}", 10 + i) for i in range(50)], "relpath string, ord int, name string, start_line long")
    rows = issues.list_issues(issue_table(spark, 50), symbols, limit).collect()
    assert len(rows) == count
    named = {r["kind"]: (r["name"], r["start_line"]) for r in rows}
    if count:
        assert named["god_module"] == ("a.py", 10) and named["shotgun_surgery"] == ("y.py", 1)


def test_history(spark):
    log = spark.createDataFrame([(f"c{i}", "ann" if i else "", 86_400 * (i + 1), 2, 1, p) for i in range(3) for p in ("a.py", "lib/b.py")], schema.GIT_LOG)
    row = {r["path"]: r for r in history.file_history(log).collect()}["a.py"]
    assert (row["churn"], row["revisions"], row["authors"], row["bursts"], row["age_days"]) == (9, 3, 1, 1, 2)
    pair = history.coupling(log).first()
    assert (pair["file_a"], pair["file_b"], pair["shared"], pair["strength"]) == ("a.py", "lib/b.py", 3, 1.0)
    files = spark.createDataFrame([("a.py",), ("new.py",)], "relpath string")
    seen = {r["relpath"]: r["first_seen"] for r in history.with_history(files, log).collect()}
    assert seen == {"a.py": "86400", "new.py": ""}


def test_profiles(spark):
    text = json.dumps({"profiles": [{"weights": [4, 2], "samples": [[0]] * 2 + [[1], []]}], "shared": {"frames": [{"name": n} for n in ("m.a", "b")]}})
    rows = spark.createDataFrame([(text,)], "json string")
    assert {r["name"]: r["weight"] for r in profile.speedscope_weights(rows).collect()} == {"m.a": 6.0, "b": 1.0}
    files = spark.createDataFrame([("x.py", 0.5, 0.5), ("y.py", 0.0, 0.0)], "relpath string, profile_self double, profile_total double")
    symbols = spark.createDataFrame([("x.py", "a")], "relpath string, name string")
    laid = profile.overlay(files, symbols, profile.speedscope_weights(rows))
    assert {r["relpath"]: r["profile_total"] for r in laid.collect()} == {"x.py": 6.5, "y.py": 0.0}


def test_fingerprint_overlap_of_equals_is_one(spark):
    symbols = spark.createDataFrame([("a.py", i, 'q"x', [], 1, 2, 0, 0) for i in range(2)], "relpath string, ord int, name string, effects array<string>, cyclomatic long, cognitive long, fan_in long, fan_out long")
    made = name_health.with_fingerprints(symbols, spark.createDataFrame([], schema.EDGES))
    a, b = made.filter("ord = 0").alias("a"), made.filter("ord = 1").alias("b")
    assert a.join(b, F.lit(True)).select(name_health.overlap("a", "b")).first()[0] == 1.0
    assert made.first()["fingerprint"].endswith('"name_len": 3}')


def test_token_clones_keep_every_pair(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    bodies = [base, base, base + " tau", base.replace("pi", "qu"), "other words entirely " * 6, base[:60]]
    symbols = spark.createDataFrame([("a.py", i, "f", b) for i, b in enumerate(bodies)], "relpath string, ord int, name string, body string")
    found = {(r["a_ord"], r["b_ord"]): r["score"] for r in clones.token_clones(symbols).collect()}

    def sets(text):
        t = [w for w in text.lower().split() if w not in ("self", "return", "the", "a")]
        return {" ".join(t[i : i + 5]) for i in range(len(t) - 4)}

    want = {}
    for i in range(6):
        for j in range(i + 1, 6):
            if len(bodies[i]) > 80 and len(bodies[j]) > 80 and bodies[i].split()[0] == bodies[j].split()[0]:
                x, y = sets(bodies[i]), sets(bodies[j])
                if len(x & y) / len(x | y) >= 0.55:
                    want[i, j] = len(x & y) / len(x | y)
    assert found == pytest.approx(want) and len(want) >= 3


def test_body_cut_keeps_whole_characters(spark):
    body = "é" * 3000
    row = clones.token_sets(spark.createDataFrame([("a", 0, "n", body)], "relpath string, ord int, name string, body string"), 4095).first()
    assert row["shingles"] == ["é" * 2047]


def test_reading_order_skips_generic_and_repeats(spark):
    rows = [("a.py", 0, "get", 50, False), ("a.py", 1, "work", 20, False), ("a.py", 2, "work", 10, False), ("b.py", 0, "main", 0, True)]
    symbols = spark.createDataFrame([(p, o, n, "s", "function", c, 1, 0, 0, 1, e, False) for p, o, n, c, e in rows], "relpath string, ord int, name string, signature string, kind string, cognitive long, cyclomatic long, fan_in long, fan_out long, start_line long, is_entry boolean, is_test boolean")
    files = spark.createDataFrame([("a.py", 0.01, False), ("b.py", 0.2, False)], "relpath string, pagerank double, is_test boolean")
    got = [(r["name"], r["why"]) for r in rank.reading_order(symbols, files, 5).collect()]
    assert got == [("main", "entry point, high graph centrality"), ("work", "cognitive complexity 20")]


def test_index_changes_and_cascade(spark):
    walked = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "relpath string, digest string")
    stored = spark.createDataFrame([("a", "1"), ("b", "0"), ("d", "4")], "relpath string, digest string")
    state = {r["relpath"]: r["state"] for r in index.changes(walked, stored).collect()}
    assert state == {"a": "reused", "b": "dirty", "c": "dirty", "d": "removed"}
    assert {r["state"] for r in index.changes(walked, stored, True).collect()} == {"dirty", "removed"}


def test_sessions_fill_to_the_capacity(spark):
    items = spark.createDataFrame([("g", i, c) for i, c in enumerate([20, 20, 10, 60, 5])], "g string, position int, c int")
    got = {r["position"]: r["session"] for r in review.sessions(items, ["g"], ["position"], F.col("c")).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_quantile_cut(spark):
    scores = spark.createDataFrame([(float(i),) for i in range(21)], "x double")
    assert clones.quantile_cut(scores, "x", 0.15).first()["cut"] == 3.0
    assert clones.quantile_cut(scores.limit(0), "x", 0.15).first()["cut"] is None


def test_quantile_cut_by_counting(spark, monkeypatch):
    monkeypatch.setattr(clones, "SORTED", 5)
    monkeypatch.setattr(clones, "RANGES", 3)
    values = [((i * 37) % 101) ** 3 / 7 for i in range(300)] + [5.0] * 200 + [None] * 3
    scores = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(v for v in values if v is not None)
    for q in (0.0, 0.15, 0.5, 0.77, 1.0):
        assert clones.quantile_cut(scores, "x", q).first()["cut"] == ordered[int((len(ordered) - 1) * q + 0.5)]


def _prints(spark, n, stem="", callees=6):
    rows = [(f"f{i % 3}.py", i, f"load{stem}_{i}" if stem else "load", ["db"] if i % 3 else [], sorted(f"c{(i * 7 + k * k) % 11}" for k in range(i % callees)), 1 + i * 5 % 31) for i in range(n)]
    return spark.createDataFrame(rows, "relpath string, ord int, name string, fp_effects array<string>, fp_callees array<string>, cyclomatic int"), rows


def _overlap(a, b):
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
    return 0.4 * jac(a[3], b[3]) + 0.4 * jac(a[4], b[4]) + 0.2 * (1.0 - min(abs(a[5] - b[5]) / 20.0, 1.0))


def test_homonyms_in_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(name_health, "BLOCK", 8)
    symbols, rows = _prints(spark, 50)
    want = sorted((*min(a[:2], b[:2]), round(1.0 - _overlap(a, b), 9)) for i, a in enumerate(rows) for b in rows[:i] if _overlap(a, b) < 0.35)
    got = sorted((r["relpath"], r["ord"], round(r["score"], 9)) for r in name_health.homonyms(symbols).collect())
    assert got == want and len(want) > 50


def test_label_rows_repeat_counted_flags_in_their_place(spark):
    symbols, _ = _prints(spark, 40)
    symbols = symbols.withColumn("start_line", F.lit(1))
    counted = name_health.label_rows(name_health.counted_homonyms(symbols), symbols).collect()
    assert counted == name_health.label_rows(name_health.homonyms(symbols), symbols).collect() and len(counted) > 50
    assert [r["score"] for r in counted] == sorted((r["score"] for r in counted), reverse=True)


@pytest.mark.parametrize("threshold", [0.2, None, 0.8])
def test_same_stem_judges_pairs_only_between_its_bounds(spark, monkeypatch, threshold):
    symbols, rows = _prints(spark, 60, "x")
    mean = sum(_overlap(a, b) for i, a in enumerate(rows) for b in rows[:i]) / (60 * 59 / 2)
    monkeypatch.setattr(name_health, "BLOCK", 16)
    if threshold is None:
        assert name_health.same_stem(symbols, mean * 0.999).count() == 0
        assert name_health.same_stem(symbols, mean * 1.001).count() == 60
        return
    monkeypatch.setattr(name_health, "over_pairs", None)  # far from the mean no pair is needed
    assert name_health.same_stem(symbols, threshold).count() == (60 if mean < threshold else 0)


@pytest.mark.parametrize("bounds", [{"BLOCK": 16}, {"BLOCK_NUMBERS": 200, "PRODUCTS": 100}])
def test_vector_pairs_in_blocks_and_stripes_are_all_pairs(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(clones, name, value)
    rows = [(i, [float((i * k * k + 3 * i) % 7 - 3) for k in range(1, 6)]) for i in range(300)]
    unit = {i: [x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for i, v in rows}
    want = {(a, b) for a in unit for b in range(a + 1, 300) if sum(x * y for x, y in zip(unit[a], unit[b], strict=True)) >= 0.9 + 1e-12}
    got = [(r["a"], r["b"]) for r in clones.vector_pairs(spark.createDataFrame(rows, "id long, embedding array<float>"), 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_parsed_tables_are_dealt_to_all_cores(spark):
    from quarry import bindings, queries

    raw = bindings.rows(spark, "/root/testdata/sf0.001", bindings.SOURCES, spread=True)
    assert raw.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    parsed, _ = queries._parsed(spark, "/root/testdata/sf0.001")
    assert parsed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("bounds", [(700, 700), (10**6, 10**6)])
def test_token_clones_in_blocks_are_all_pairs(spark, monkeypatch, bounds):
    monkeypatch.setattr(clones, "SET_BOUNDS", bounds)
    monkeypatch.setattr(clones, "SET_WEIGHT", 100)
    words = [[f"w{(i % 4 + 1) * k % 53}x{k + (i // 4 if k > 30 + i % 9 else 0)}" for k in range(45)] for i in range(40)]
    rows = [(f"f{i % 3}.py", i, "f", " ".join(["lead" if i % 5 else "other", *w])) for i, w in enumerate(words)]
    sets = {r[:2]: (r[3].split()[0], {tuple(r[3].split()[k : k + 5]) for k in range(42)}) for r in rows}
    jac = lambda a, b: len(a & b) / len(a | b)
    want = {(a, b): round(jac(sets[a][1], sets[b][1]), 9) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and jac(sets[a][1], sets[b][1]) >= 0.55}
    found = clones.token_clones(spark.createDataFrame(rows, "relpath string, ord int, name string, body string")).collect()
    assert len(found) == len(want) > 20
    assert {((r["a_relpath"], r["a_ord"]), (r["b_relpath"], r["b_ord"])): round(r["score"], 9) for r in found} == want
