"""The operators' queries and the pipeline on the driver's tables."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

import __spark_entry__
from quarry.llm import oracles
from quarry.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


def test_all_ten_are_registered():
    found = {k.split("_")[0] for k in __spark_entry__.queries() if k.startswith("op")}
    assert found == {f"op{n}" for n in range(1, 11)} and "pipeline" in __spark_entry__.queries()


def test_token_query(spark, duck):
    P = pytest.importorskip("public_tokenizers")
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op3_token_files"](spark, SF).collect()}
    start = 0
    for i, text in duck.sql("select doc_id, text from documents order by doc_id").fetchall():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_sharding_query(spark, duck):
    rows = QUERIES["op7_sharding"](spark, SF).collect()
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in duck.sql("select doc_id, text from documents").fetchall()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))


def test_sharding_query_deals_whole_texts(spark, tmp_path, monkeypatch):
    """The operator gets the texts themselves, and digests are those of the texts that it returns."""
    from quarry.llm import sharding

    texts = [None, "", "same", "same", "é\n 語 😀", "long " * 20_000, *[f"text {i}" for i in range(40)]]
    table = list(enumerate(texts)) + [(3, "same"), (3, "other"), (None, "no id")]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    real, given, returned = sharding.shard, [], []

    def marked(docs, *args, **kwargs):
        given.append(docs)
        returned.append(real(docs, *args, **kwargs).withColumn("text", F.concat("text", F.lit(" é"))))
        return returned[0]

    monkeypatch.setattr(sharding, "shard", marked)
    rows = QUERIES["op7_sharding"](spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in given[0].collect()) == Counter(table)

    def digests(r):
        data = (r["text"] or "").encode()
        return r["doc_id"], len(data) + 1, zlib.crc32(data), r["shard"], r["slot"]

    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows) == Counter(map(digests, returned[0].collect()))
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(table) and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(k)) for s, k in sizes.items())


def test_quality_query_agrees_with_labels(spark, duck):
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op2_quality_model"](spark, SF).collect()}
    rows = duck.sql("select doc_id, quality from labels").fetchall()
    assert sum(kept[i] == bool(q) for i, q in rows) / len(rows) > 0.97


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small corpus with every awkward row, against the stages done one after another by plain loops."""
    import math
    import random

    import corpus_pipeline
    from quarry.llm.mixing import hash_unit
    from tests.llm.test_operators import brute_contained, brute_near, split

    rng = random.Random(4)
    stop = "the of and to in is that for with was".split()

    def prose(n, sep=" "):
        return sep.join(rng.choice(stop) if rng.random() < 0.3 else f"word{rng.randrange(4000)}" for _ in range(n))

    items = [(k, prose(20)) for k in range(6)] + [(6, None), (7, "")]
    texts = [prose(rng.randrange(60, 160)) for _ in range(60)]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en", "src1") for i in range(12)]  # copies
    rows += [(200 + i, texts[i].replace(texts[i].split()[-1], "changed"), "en", "src0") for i in range(8)]  # near copies
    rows += [(300 + i, f"{prose(50)} {items[i % 6][1]} {prose(30)}", "fr", "src2") for i in range(10)]  # benchmark passages
    rows += [(400, None, None, None), (401, "", "en", ""), (402, "too short", "en", "src0"), (403, "# $ % " * 100, "en", "src0"), (404, "the same words " * 60, "en", "src0"), (405, prose(30_000), "en", "src1")]
    rows += [(5, prose(80), "en", "src0"), rows[9], rows[9], (None, prose(90), "de", "src1"), (None, rows[20][1], "de", "src1")]  # repeated ids and rows, no ids
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, columns).withColumn("_rank", F.lit("mine")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def good(text):
        w = split(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        known = {v for x in oracles._STOP_LINES for y in x.split() for v in (y, y.capitalize())}
        return (
            len(w) >= 50 and 2 * len(covered) <= len(w) and 2 * len(w) <= sum(map(len, w)) <= 14 * len(w)
            and 10 * sum(c in "#*$%&|<>" for c in text or "") <= len(w) and 50 * sum(x in known for x in w) >= len(w) and 2 * (len(lines) - len(set(lines))) <= len(lines)
        )

    left = [r for r in rows if good(r[1])]
    assert 0 < len(left) < len(rows)
    # nodes are rows; a group keeps one row of its least id, null ids last
    groups = {}
    for k, _, c in brute_near([(k, r[1]) for k, r in enumerate(left)]):
        groups.setdefault(c, []).append(left[k])
    kept = []
    for members in groups.values():
        least = min((r[0] for r in members if r[0] is not None), default=None)
        best = {r for r in members if r[0] == least}
        assert len({r[:2] for r in best}) == 1 and len(best) == 1  # no ties but equal rows here
        kept.append(best.pop())
    tainted = {d for d, _ in brute_contained([(r[0], r[1]) for r in kept], items)}
    clean = [r for r in kept if r[0] not in tainted]
    assert len(left) > len(kept) > len(clean) > 40
    count = Counter(r[3] for r in clean)
    units = {(r["doc_id"], r["text"]): r["u"] for r in spark.createDataFrame(clean, columns).select("doc_id", "text", hash_unit(F.lit("mix-1"), F.col("doc_id"), F.md5("text")).alias("u")).collect()}
    want = Counter()
    for r in clean:
        rate = math.sqrt(count[r[3]]) / sum(map(math.sqrt, count.values())) * len(clean) / count[r[3]]
        n, p = 0, math.exp(-rate)
        total = p
        while total <= units[r[:2]]:
            n += 1
            p *= rate / n
            total += p
        want[r] += n
    want = +want
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in out) == want
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(r["law"] == "rows" and r["_rank"] == "mine" for r in out)
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(k)) for s, k in sizes.items())


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"shard", "slot", "law"} < set(out.columns)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = spark.conf.get("spark.checkpoint.dir") + f"/test-{name}"
        out.write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
        n = out.count()
        if k < 4:
            assert out.columns == columns
        if name in ("quality_rules", "near_dedup", "decontamination"):
            assert 0.5 * before < n < before
        elif name == "mixing":
            assert abs(n - before) < 0.2 * before
        else:
            sizes = Counter(r["shard"] for r in out.select("shard").collect())
            assert n == before and max(sizes.values()) - min(sizes.values()) <= 1
        docs, before = out, n
