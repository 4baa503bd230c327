"""The ten operators against brute force, on small tables with every awkward row."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import _bytes, html_extraction, mixing, near_dedup, sharding
from quarry.llm import substring_dedup as substring
from quarry.llm._kernel import hash_windows, hash_words, split_words, text_buffer, window_starts
from quarry.llm.decontamination import decontaminate, find_contained
from quarry.llm.html_extraction import extract_pages, main_text
from quarry.llm.language_id import held_out, identify, train
from quarry.llm.mixing import mix, target_rates
from quarry.llm.quality_model import classify
from quarry.llm.quality_rules import STOP_WORDS, quality_rules
from quarry.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def split(text):
    return WORD.findall(text or "")


# --- kernel ---


@given(st.lists(st.text(alphabet="ab é\t\n\x1c z", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_kernel_words_and_windows(texts):
    import pyarrow as pa

    found = split_words(*text_buffer(pa.array(texts, pa.string())))
    spans = [bytes(found.data[a:b]).decode() for a, b in zip(found.start, found.end, strict=True)]
    want = [w for t in texts for w in split(t)]
    assert spans == want
    h = hash_words(found)
    assert len(set(zip(want, h.tolist(), strict=True))) == len(set(want)) == len(set(h.tolist()))
    starts = window_starts(found, 2)
    grams = [tuple(split(t)[i : i + 2]) for t in texts for i in range(len(split(t)) - 1)]
    assert len(starts) == len(grams)
    assert len(set(zip(grams, hash_windows(h, 2)[starts].tolist(), strict=True))) == len(set(grams)) if grams else True


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=60, deadline=None)
def test_codec_round_trip(values):
    for widths in (_bytes.WIDTHS_32, _bytes.WIDTHS_64):
        control, data = _bytes.encode(np.array(values, np.uint64), widths)
        assert _bytes.decode(control, data, len(values), widths).tolist() == values
        assert _bytes.data_size(np.frombuffer(control, np.uint8), widths) == len(data)


# --- 1 ---


def brute_substring(rows, size=13):
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        w, gone = split(t), set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (math.inf if i is None else i):
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def key(row):
    return tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in row)


@pytest.mark.parametrize("block", [3_000, 1 << 20])
def test_substring_dedup(spark, docs, corpus, block):
    rows = [(r[0], r[1]) for r in corpus] + [(None, corpus[0][1]), (None, "only here " * 20)]
    table = docs.select("doc_id", "text", F.lit(1).alias("block"), F.lit("x").alias("part")).unionByName(spark.createDataFrame([(i, t, 1, "x") for i, t in rows[-2:]], "doc_id long, text string, block int, part string"))
    got = [tuple(r) for r in substring_dedup(table, block_bytes=block).collect()]
    assert sorted(got, key=key) == sorted(brute_substring(rows), key=key)
    assert sum(r[2] for r in got) > 500


def test_equal_rows_fill_no_block(spark):
    """A third of all rows are one row: it is worked on once, and comes back as often as it came."""
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(i, f"{shared} own{i} " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(40)]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    table = few.unionAll(few.filter("doc_id = 7").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(12_000)))).drop("k")).unionAll(spark.createDataFrame([(None, None)], few.schema).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9000)))).drop("k"))
    size = 20_000
    held, repeated = substring._blocks(table.withColumnRenamed("doc_id", "id"), 10, size)
    assert repeated and held.groupBy("block").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32).alias("b")).agg(F.max("b")).first()[0] < 2 * size
    got = Counter(map(tuple, substring_dedup(table, block_bytes=size).collect()))
    want = Counter({r: (12_001 if r[0] == 7 else 1) for r in brute_substring(rows)}) + Counter({(None, 0, 0, ""): 9000})
    assert got == want


def test_substring_dedup_of_nothing(none):
    assert substring_dedup(none).count() == 0


# --- 2 ---


def test_quality_model(spark, none):
    rng = random.Random(1)
    clean = "the cat of the house and a dog is on the road to that town".split()
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        text = " ".join(f"{rng.choice(clean)}###%" if bad else rng.choice(clean) for _ in range(80))
        rows.append((i, text, f"host{i % 7}" if i % 11 else None, "p"))
        if i % 2:
            labels.append((i, int(not bad)))
    rows += [(1000, None, "host1", None), (1001, "", "new", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, path string")
    labelled = spark.createDataFrame([*labels, (5000, 1), (7, None)], "doc_id long, quality int")
    out = classify(docs, labelled, F.col("source"), F.col("path")).collect()
    assert len(out) == len(rows)
    held = {r["doc_id"]: r["kept"] for r in out if r["doc_id"] < 300 and r["doc_id"] % 2 == 0}
    assert all(kept == (i % 5 != 0) for i, kept in held.items())
    rates = {r["host"]: r["host_rate"] for r in out}
    assert all(0 < v < 1 for v in rates.values()) and abs(rates["new"] - 0.8) < 0.35
    assert classify(none.withColumn("path", F.lit("")), labelled, F.col("source"), F.col("path")).count() == 0


def brute_quality(rows, labels):
    """Evidence, rates and posteriors of rows (id, text, host, path) by plain loops."""
    import unicodedata

    from quarry.llm.quality_model import BINS, LIMIT, STRENGTHS

    stop = {v for w in STOP_WORDS for v in (w, w.capitalize())}

    def feats(t):
        t, w = t or "", split(t)
        n = max(1, len(w))
        return [math.log(n), sum(c in "#*$%&|<>" for c in t) / n, sum(unicodedata.category(c) == "Lu" for c in t) / max(1, len(t)), sum(c in "!?" for c in t) / n, len(set(w)) / n, sum(x in stop for x in w) / n, (len(set(zip(w, w[1:], strict=False))) if len(w) > 2 else 0) / n]

    known = {}
    for i, y in labels:
        if i is not None and y is not None:
            known[i] = max(known.get(i, 0), int(y > 0))
    sample = [(feats(t), known[i]) for i, t, _, _ in rows if i in known]
    good = sum(y for _, y in sample)
    bad = len(sample) - good
    evidence = []
    for i, t, _, _ in rows:
        total, f = 0.0, feats(t)
        for k in range(7):
            values = sorted(x[k] for x, _ in sample)
            edges = sorted({values[len(values) * j // BINS] for j in range(1, BINS)}) if values else []
            place = lambda v: sum(v >= e for e in edges)  # noqa: B023, E731
            g = sum(y for x, y in sample if place(x[k]) == place(f[k]))
            b = sum(1 - y for x, y in sample if place(x[k]) == place(f[k]))
            total += max(-LIMIT, min(LIMIT, math.log((g + 1) / (good + len(edges) + 1)) - math.log((b + 1) / (bad + len(edges) + 1))))
        evidence.append(total)
    prior = math.log((good + 1) / (bad + 1))
    p = [1 / (1 + math.exp(-e - prior)) for e in evidence]
    by_path, by_host = defaultdict(list), defaultdict(list)
    for k, r in enumerate(rows):
        by_path[r[2], r[3]].append(k)
        by_host[r[2]].append(k)
    n = len(rows)
    overall = sum(p) / n
    mean = lambda ks: sum(p[k] for k in ks) / len(ks)
    inside = sum((p[k] - mean(ks)) ** 2 for ks in by_path.values() for k in ks) / max(1, n - len(by_path))
    between = sum(len(ks) * (mean(ks) - overall) ** 2 for ks in by_host.values())
    within = sum(len(ks) * (mean(ks) - mean(by_host[h])) ** 2 for (h, _), ks in by_path.items())
    spread = [(between - (len(by_host) - 1) * inside) / (n - sum(len(x) ** 2 for x in by_host.values()) / n), 0.0]
    rest = n - sum(len(x) ** 2 / len(by_host[h]) for (h, _), x in by_path.items())
    if rest > 1e-9:
        spread[1] = (within - (len(by_path) - len(by_host)) * inside) / rest
    k_host, k_path = (min(STRENGTHS[1], max(STRENGTHS[0], inside / v)) if v > 0 else STRENGTHS[1] for v in spread)
    out = []
    for k, (i, _, h, q) in enumerate(rows):
        host = (sum(p[j] for j in by_host[h] if j != k) + k_host * overall) / (len(by_host[h]) - 1 + k_host)
        path = (sum(p[j] for j in by_path[h, q] if j != k) + k_path * host) / (len(by_path[h, q]) - 1 + k_path)
        out.append((i, evidence[k], host, path, 1 / (1 + math.exp(-evidence[k] - math.log(path / (1 - path))))))
    return out


def test_quality_model_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "Of", "and", "Haus", "ÉTÉ", "x#", "wow!", "a", "word", "<b>", "und", "zzz", "Ω"]
    rows = [(i, " ".join(rng.choice(vocabulary[: 6 + i % 8]) for _ in range(rng.randrange(0, 60))), f"h{i % 5}" if i % 9 else None, f"p{i % 7}" if i % 4 else None) for i in range(160)]
    rows += [(200, None, "h1", "p1"), (200, "again", "h1", "p1"), (200, "again", "h1", "p1"), (None, "no id", "h2", None), (201, "very long " * 20_000, "lone", "path")]
    labels = [(i, rng.choice([0, 1, 2, -1, None])) for i in range(0, 160, 2)] + [(4, 1), (4, 0), (None, 1), (200, 1), (999, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").withColumns({c: F.lit(c) for c in ("_w", "_n", "evidence", "n", "s", "f0", "_id", "y", "id")})
    got = [(r["doc_id"], r["evidence"], r["host_rate"], r["path_rate"], r["quality"]) for r in classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()]
    want = brute_quality(rows, labels)
    order = lambda r: (r[0] is None, r[0] or 0, round(r[1], 6))
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-7)


def test_quality_model_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = classify(docs, labels.filter(~apart), F.col("source"), F.concat_ws("/", "source", "lang"))
    told = out.withColumnRenamed("quality", "posterior").join(labels.filter(apart), "doc_id").agg(F.avg((F.col("kept") == (F.col("quality") > 0)).cast("double")), F.count(F.lit(1)))
    right, n = told.first()
    assert n > 500 and right > 0.95  # 0.9616 of 990 when written


# --- 3 ---


def test_token_files(spark, docs, corpus, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from quarry.llm.token_files import read_token_files, write_token_files

    odd = [(900, "Straße ÉTÉ naïve space 'tis it's 12.5 <|endoftext|> é İ ΣΑΣ µª, 日本 x" + "y" * 200, "", "", 0), (None, "no id", "", "", 0)]
    rows = corpus + odd
    table = spark.createDataFrame(rows, docs.schema).withColumn("body", F.lit("b"))
    for name, end in (("word_bpe_49k.json", 2), ("byte_bpe_50k.json", 50256)):
        t = Tokenizer.from_file(P.path(name))
        files = write_token_files(table, P.path(name), end)
        out = read_token_files(spark, files).collect()
        want = Counter()
        for r in rows:
            ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, end], "<u4")
            want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
        assert Counter((r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in out) == want
        ordered = sorted(out, key=lambda r: r["start"])
        assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:k]) for k in range(len(ordered))]
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
        assert ids == sorted(ids)
    assert read_token_files(spark, write_token_files(none, P.path("word_bpe_49k.json"), 2)).count() == 0


# --- 4 ---


def test_language_id(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    known = docs.filter(~held_out(F.col("doc_id")))
    found = identify(docs, train(known), keep=("doc_id", "lang")).filter(held_out(F.col("doc_id")))
    row = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.min("score"), F.max("score")).first()
    assert row["right"] > 0.97 and 0 <= row[1] <= row[2] <= 1
    fold = docs.limit(50).select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in fold)


def test_language_id_edges(spark, none):
    rows = [(1, "the of and to in is that", "en"), (2, "le la les des et un une", "fr"), (3, None, "fr"), (4, "x", None), (5, "12 !", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_best", F.lit("z"))
    made = train(docs)
    assert set(made) == {"en", "fr"}
    out = {r["doc_id"]: r for r in identify(docs, made).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 5)] == ["en", "fr", "und", "und"] and out[3]["score"] == 0.0 and out[5]["rejected"]
    assert {r["lang_pred"] for r in identify(docs, train(none)).collect()} == {"und"}
    assert identify(none, made).count() == 0


def test_language_id_against_brute_force(spark):
    """Sizes of whole texts recomputed piece by piece with compressors made here."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    made = train(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.filter(held_out(F.col("doc_id"))).select("doc_id", "text").collect()[:200]
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(-1, rows[0]["text"] * 400), (-2, rows[1]["text"]), (-2, rows[1]["text"]), (-3, "ß"), (-4, "1 2 _"), (-5, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_first", "k0", "letters", "lang_pred")})
    got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9), r["_first"]) for r in identify(table, made, keep=("doc_id", "_first")).collect())
    want = Counter()
    for i, text in rows:
        body = " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode()
        sizes = {}
        for name, words in made.items():
            own = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_dict_id=False, write_checksum=False, min_match=4, strategy=zstandard.STRATEGY_GREEDY, window_log=18, hash_log=17, chain_log=17, search_log=4)
            own.precompute_compress(compression_params=params)
            coder = zstandard.ZstdCompressor(dict_data=own, compression_params=params)
            sizes[name] = sum(len(coder.compress(body[k : k + 2048])) - 4 for k in range(0, max(1, len(body)), 2048))
        first, second = sorted(sizes.values())[:2]
        score = 1 - 0.5 * math.exp(-20 * (second - first) / max(1, second))
        want[i, min(sizes, key=lambda n: (sizes[n], n)) if body else "und", round(score, 9) if body else 0.0, "x"] += 1
    assert got == want


def test_language_id_learns_from_whole_texts(spark):
    banner = "this work is licensed under the terms of the licence that comes with it " * 12
    rng = random.Random(7)
    german = ["der", "hund", "und", "die", "katze", "schlafen", "unter", "einem", "baum", "neben", "dem", "haus"]
    texts = {i: " ".join(rng.choice(german) for _ in range(300 + 40 * i)) for i in range(12)}
    rows = [(i, banner + t, "de") for i, t in texts.items()] + [(100 + i, banner * 2, "en") for i in range(12)]
    made = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert made["de"].count(b"katze") > 12 and len(made["de"]) <= 12 * 706
    out = identify(spark.createDataFrame([(1, texts[3])], "doc_id long, text string"), made).first()
    assert out["lang_pred"] == "de" and not out["rejected"]
    short = train(spark.createDataFrame([(1, "wort " * 140, "de")], "doc_id long, text string, lang string"))
    assert short == {"de": b" ".join([b"wort"] * 140)}


# --- 5 ---


def test_main_text():
    body = "The first sentence is long enough to matter here, with text. " * 3
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/x">X</a></ul></nav>
    <div class="cookie-notice">We use cookies, a lot of them, please accept all of them now.</div>
    <article><h1>A &amp; B</h1><p>{body}<p><b>Second &lt;p&gt;&nbsp;one</b> <i>it</i>alic{body}</p><aside>Related</aside><!-- no > --><form><input value="a>b">Send</form>
    <ul><li>one <li>two</ul><div class="comments"><p>{body}</p></div></article><div class="sidebar">{body}</div><footer>&copy; x</footer>"""
    want = ["A & B", " ".join(body.split()), "Second <p> one italic" + " ".join(body.split()), "one", "two"]
    assert main_text(page).split("\n") == want


def split_article(rng, counts, wrap="{}", part="div"):
    """Blocks of an article of several parts, and a page that holds it between a menu and a footer."""
    parts = [[" ".join("word" + "x" * rng.randrange(8) for _ in range(rng.randrange(25, 40))) + "." for _ in range(n)] for n in counts]
    inner = "".join(f"<{part}>" + "".join(f"<p>{p}</p>" for p in ps) + f"</{part}>" for ps in parts)
    page = f'<body><div><a href="/a">Home</a> <a href="/b">About us</a></div>{wrap.format(inner)}<footer>end</footer></body>'
    return [p for ps in parts for p in ps], page


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>", '<div id="page"><div>{}</div></div>', "<article><div>{}</div></article>", "<main><div>{}</div></main>", "<div><span>{}</span></div>"])
@pytest.mark.parametrize("counts", [(3, 3), (4, 2, 3), (2, 10, 2), (10, 1), (1, 10, 1)])
def test_main_text_of_split_articles(wrap, counts):
    want, page = split_article(random.Random(4), counts, wrap)
    assert main_text(page).split("\n") == want


def test_main_text_of_several_articles():
    a, b = "First text with words. " * 12, "Second text, other words. " * 9
    page = f"<body><div><article><h1>One</h1><p>{a}</p><p>{a}</p></article><div><a href='/'>next page</a></div><article><h2>Two</h2><p>{b}</p></article></div></body>"
    assert main_text(page).split("\n") == ["One", a.strip(), a.strip(), "Two", b.strip()]


def test_main_text_keeps_blocks_whole_and_in_order():
    t = "Some words that make a line of text. " * 5
    page = f"<body><div><p>{t}</p><p>{t}</p><p>{t}</p></div><div>Lead <span>with <b>bold words</b> and <i>more</i></span> tail. {t}</div></body>"
    assert main_text(page).split("\n") == [t.strip()] * 3 + [f"Lead with bold words and more tail. {t}".strip()]


@pytest.mark.parametrize("wrapper", ['div class="content has-sidebar"', 'div id="page" class="no-comments"', 'section class="legal"', 'div class="related-work"', 'div class="post with-banner share-enabled"', "div class=tags"])
@pytest.mark.parametrize("advert", ["ad", "cookie-notice", "top_banner", "x sidebar", "related-posts"])
def test_main_text_in_wrappers_with_boilerplate_names(wrapper, advert):
    t = "Some words that make a line of text. " * 5
    page = f'<body><div class="{advert}"><p>Buy this thing, and buy it now, in all our shops.</p></div><{wrapper}><p>{t}</p><p class="notice">{t}</p><p>A <span class="tag">marked</span> word. {t}</p></{wrapper.split()[0]}><footer>end</footer></body>'
    assert main_text(page).split("\n") == [t.strip(), t.strip(), f"A marked word. {t}".strip()]


def test_main_text_is_not_emptied_by_names():
    t = "Some words that make a line of text. " * 5
    page = "<body>" + f'<section class="legal"><p>{t}</p></section>' * 3 + "</body>"
    assert main_text(page).split("\n") == [t.strip()] * 3


def brute_density(node, body):
    """Composite text density of a node by its definition, walking its whole subtree for every number."""
    import html

    def walk(n, linked):
        linked = linked or n.tag == "a"
        for x in n.parts:
            if isinstance(x, str):
                yield "link" if linked else "text", len(re.sub(r"\s+", "", html.unescape(x)))
            elif not x.skipped:
                yield "linktag" if x.tag == "a" else "tag", 1
                yield from walk(x, linked)

    def sums(n):
        found = Counter()
        for kind, k in walk(n, False):
            found[kind] += k
        return found["text"] + found["link"], found["tag"] + found["linktag"], found["link"], found["linktag"]

    chars, tags, link_chars, link_tags = sums(node)
    all_chars, _, all_links, _ = sums(body)
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + all_links / max(1, all_chars) * chars + math.e)
    value = math.log(chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))
    if base == 1:  # no links at all; there is no logarithm to the base 1
        return chars / max(1, tags) * max(0.0, value)
    return chars / max(1, tags) * max(0.0, value / math.log(max(base, 1.0001)))


@pytest.mark.parametrize("seed", range(6))
def test_densities_against_brute_force(seed):
    rng = random.Random(seed)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            text = " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 30)))
            return text if rng.random() < 0.6 else f'<a href="/x">{text} &amp; co</a>'
        tag = rng.choice(["div", "p", "span", "section", "b", "ul"])
        return f"<{tag}>" + "".join(made(depth - 1) for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    root = html_extraction.parse(made(6) + made(6))
    for node in html_extraction._measure(root):
        assert node.density == pytest.approx(brute_density(node, root))
        assert node.total == pytest.approx(sum(brute_density(x, root) for x in node.parts if not isinstance(x, str) and not x.skipped))


def test_the_threshold_adds_what_the_best_subtree_lacks(monkeypatch):
    want, page = split_article(random.Random(4), (2, 10, 2))
    assert main_text(page).split("\n") == want
    monkeypatch.setattr(html_extraction, "_chosen", lambda root: [max(html_extraction._measure(root), key=lambda n: n.total)])
    assert main_text(page).split("\n") != want


def test_an_article_with_a_misleading_class_stays():
    t = "Some words that make a line of text. " * 9
    page = f'<body><div><a href="/">Home</a></div><div class="share price"><p>{t}</p><p>{t}</p></div><footer>end</footer></body>'
    assert main_text(page).split("\n") == [t.strip(), t.strip()]


@pytest.mark.parametrize("page", ["<div>{0}" + "</b>{0}", "<span>{0}" + "<p>{0}", "<li><ul>" + "<b>{0}" + "<li></li>{0}", "<noscript>{0}", "<table>" + "<td><tr>{0}", "<a x='{0}", "<dl>" + "<dd><div>{0}"])
def test_badly_nested_pages_take_linear_time(page):
    n = 20_000
    page = "".join(re.sub(r"((?:<[^>]*>)|(?:<a x=')){0}".replace("{0}", r"\{0\}"), lambda m: m.group(1) * n, page).split("{0}"))
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 3


@given(st.text(alphabet="<>/ab p=\"'!-&;", max_size=60))
@settings(max_examples=200, deadline=None)
def test_main_text_survives_anything(page):
    text = main_text(page)
    assert text == text.strip() and "\n\n" not in text


def test_extract_pages(spark):
    rows = [(1, "u", "<p>plain text</p>", "t"), (2, None, None, "t"), (3, "v", "", "t"), (3, "v", "", "t"), (4, "w", "<div>" * 3000 + "deep" + "</div>" * 3000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract_pages(pages).collect())
    assert out == [(1, "plain text", 10), (2, "", 0), (3, "", 0), (3, "", 0), (4, "deep", 4)]
    assert extract_pages(pages.limit(0)).count() == 0


def test_driver_pages_give_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", r["html"], re.S).group(1)
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert main_text(r["html"]) == "\n".join(b for b in blocks if b)


# --- 6 ---


def brute_contained(docs, items, t=0.8):
    def grams(words, size):
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}

    out = {}
    for item, text in items:
        w = split((text or "").lower())
        size = min(5, len(w))
        want = grams(w, size) if w else set()
        for i, x in docs:
            have = grams(split((x or "").lower()), size) if want else set()
            if want and len(want & have) + 1e-9 >= t * len(want):
                out[i, item] = max(out.get((i, item), (0, 1)), (len(want & have), len(want)), key=lambda v: v[0] / v[1])
    return out


def test_decontamination(spark, docs, corpus, none):
    rng = random.Random(3)
    texts = [r[1] for r in corpus if r[1] and len(r[1].split()) > 40]
    items = [(k, " ".join(texts[k].split()[5 : 5 + n])) for k, n in enumerate([3, 4, 5, 6, 9, 14, 20, 33, 25])]
    for k in range(9, 15):  # items that are mostly, or not quite, in a text
        w = texts[k].split()[3:33]
        w[rng.randrange(5)] = "strange"
        if k % 2:
            w[20] = "odd"
        items.append((k, " ".join(w)))
    items += [(50, None), (51, " "), (52, "nowhere to be found at all in here"), (53, texts[0].upper()[:90]), (50, texts[1][:80])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    table = docs.withColumns({c: F.lit(1) for c in ("item", "_tainted", "_id", "_w", "h", "c0")})
    assert decontaminate(table, bench).columns == table.columns
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in find_contained(table, bench).collect()}
    want = brute_contained([(r[0], r[1]) for r in corpus], items)
    assert got == want and len(want) > 20
    clean = {r["doc_id"] for r in decontaminate(table, bench).collect()}
    assert clean == {r[0] for r in corpus} - {d for d, _ in want}
    assert find_contained(none, bench).count() == 0 and find_contained(docs, bench.limit(0)).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == len(corpus)


# --- 7 ---


def test_hypergeometric_draws():
    rng = np.random.Generator(np.random.PCG64(1))
    draws = np.array([sharding.draw_hypergeometric(rng, 30, 50, 20) for _ in range(4000)])
    assert abs(draws.mean() - 7.5) < 0.15 and abs(draws.var() - 20 * 0.375 * 0.625 * 60 / 79) < 0.35
    assert sharding.draw_hypergeometric(rng, 5, 0, 3) == 3 and sharding.draw_hypergeometric(rng, 0, 5, 3) == 0
    big = sharding.draw_hypergeometric(rng, 10**10, 15 * 10**10, 10**9)
    assert abs(big - 10**9 / 16) < 10**5
    matrix = sharding.communication_matrix([10, 0, 7, 40], 5, 3)
    assert matrix.sum(1).tolist() == [10, 0, 7, 40] and sorted(matrix.sum(0).tolist()) == [11, 11, 11, 12, 12]


@pytest.mark.parametrize("rank_rows", [200_000, 4])
def test_sharding(spark, docs, corpus, none, monkeypatch, rank_rows):
    monkeypatch.setattr(sharding, "RANK_ROWS", rank_rows)
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 29, docs.schema)
    table = docs.unionAll(docs.limit(5)).unionAll(nulls).withColumn("slot", F.lit(-1))
    mine = ("_h", "_g", "_part", "_id", "_rank", "_local", "_final", "_bin", "_row", "_n", "_parts", "_shard", "_before", "Shard", "c0")
    n = table.count()
    out = sharding.shard(table.withColumns({c: F.lit(c) for c in mine}), 7)
    assert [c for c in out.columns if c.lower() not in ("shard", "slot")] == [*docs.columns, *[c for c in mine if c != "Shard"]]
    out = out.collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == n and len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, k in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(k))
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out) == Counter((r["doc_id"], r["text"], r["source"]) for r in table.collect())
    assert all(r[c] == c for r in out for c in mine if c != "Shard")
    assert sharding.shard(none, 7).count() == 0


@pytest.mark.parametrize("rank_rows", [200_000, 40, 4])
def test_sharding_depends_on_rows_alone(spark, docs, monkeypatch, rank_rows, tmp_path):
    monkeypatch.setattr(sharding, "RANK_ROWS", rank_rows)
    table = docs.unionAll(docs.limit(5)).unionAll(spark.createDataFrame([(1, "t", None, None, None), (1, "t", None, "", None)] * 20, docs.schema))
    found = []
    for files in (1, 16):
        table.orderBy(F.rand(files)).repartition(files).write.parquet(f"{tmp_path}/{files}")
        found.append(sorted(map(str, sharding.shard(spark.read.parquet(f"{tmp_path}/{files}"), 7).collect())))
    assert found[0] == found[1]


@pytest.mark.parametrize("rank_rows", [200_000, 10])
def test_sharding_against_a_deal_by_hand(spark, monkeypatch, rank_rows):
    """Recomputes the deal: the matrix says how many, local and final hashes say which."""
    monkeypatch.setattr(sharding, "RANK_ROWS", rank_rows)
    docs = spark.range(150).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    own = docs.toDF("c0", "c1")
    h, g = sharding.row_hashes(own)
    parts = max(sharding.PARTITIONS, -(-150 // rank_rows))
    rows = [tuple(r) for r in own.select("c0", h.alias("h"), g.alias("g"), F.pmod(F.xxhash64(F.lit(7), h), F.lit(parts)).cast("int").alias("p")).collect()]
    members = defaultdict(list)
    for i, a, b, p in rows:
        members[p].append((a, b, i))
    matrix = sharding.communication_matrix([len(members[p]) for p in range(parts)], 5, 7)

    def hashes(kind, pairs):
        table = spark.createDataFrame(pairs, "p int, k long")
        return {(r["p"], r["k"]): r["x"] for r in table.select("p", "k", F.xxhash64(F.lit(f"7:{kind}"), "p", "k").alias("x")).collect()}

    pairs = [(p, k) for p in members for k in range(len(members[p]))]
    local, final = hashes("local", pairs), hashes("final", pairs)
    dealt = defaultdict(list)
    for p, own_rows in members.items():
        order = sorted(range(len(own_rows)), key=lambda k: (local[p, k], k))
        for rank, k in enumerate(order):
            s = int(np.searchsorted(np.cumsum(matrix[p]), rank, "right"))
            dealt[s].append((final[p, rank], sorted(own_rows)[k][2]))
    want = {(i, s, slot) for s, got in dealt.items() for slot, (_, i) in enumerate(sorted(got))}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs, 5).collect()} == want


def test_sharding_is_uniform(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    near = [sum(a == b for a, b in zip(s, s[1:], strict=False)) for s in ([r["shard"] for r in sorted(sharding.shard(docs, 4, seed=k).collect(), key=lambda r: r["doc_id"])] for k in range(6))]
    assert abs(np.mean(near) - 399 * 99 / 399) < 15


# --- 8 ---


def test_quality_rules(spark, docs, corpus, none):
    out = quality_rules(docs.withColumns({"n_lines": F.lit(-1), "kept": F.lit("x")}))
    rows = out.collect()
    assert len(rows) == len(corpus)
    for r in rows:
        w = split(r["text"])
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (r["text"] or "").split("\n") if split(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert out.filter("kept").count() == sum(r["kept"] for r in rows)
    mine = {n: F.lit(f"{n} of mine") for n in ("_w", "_l", "_s", "_p", "_v", "c0", "c1", "measures")}
    again = quality_rules(docs.withColumns(mine))
    assert Counter((r["doc_id"], r["kept"], r["n_words"]) for r in again.collect()) == Counter((r["doc_id"], r["kept"], r["n_words"]) for r in rows)
    assert all(r[n] == f"{n} of mine" for r in again.collect() for n in mine)
    assert quality_rules(none).count() == 0
    foreign = " ".join(f"szczegolny{i} wyraz{i}" for i in range(40))
    told = quality_rules(spark.createDataFrame([(1, foreign, "pl"), (2, foreign, "en"), (3, foreign, None)], "doc_id long, text string, lang string"))
    assert {r["doc_id"]: r["kept"] for r in told.collect()} == {1: True, 2: False, 3: False}
    clean = "It is the work of a man and that of the town with which we are on good terms, as said. " * 4
    junk = [" | ".join(f"w{i}" for i in range(90)), " ".join(f"w{i}%%%" for i in range(90)), " ".join(f"W{i}!!" for i in range(90))]
    varied = " ".join(f"{w}{'' if i % 3 else i}" for i, w in enumerate(clean.split()))
    judged = quality_rules(spark.createDataFrame([(i, t) for i, t in enumerate([varied, *junk])], "doc_id long, text string"))
    assert {r["doc_id"]: r["kept"] for r in judged.collect()} == {0: True, 1: False, 2: False, 3: False}


# --- 9 ---


def test_mixing(spark, docs, corpus, none, monkeypatch):
    weights = {"src0": 1.0, "src1": 3.0}
    table = docs.withColumns({"copy": F.lit("mine"), "_u": F.lit(0)}).unionByName(spark.createDataFrame([(None, None, None, None, None, "mine", 0)], "doc_id long, text string, lang string, source string, n_chars long, copy string, _u int"))
    rates = {r["source"]: r["rate"] for r in target_rates(table, weights, 1.0, "source").collect()}
    counts = Counter(r["source"] for r in table.collect())
    total = 3.0 + len(counts) - 1
    assert all(rates[s] == pytest.approx(weights.get(s, 1.0) / total * sum(counts.values()) / n) for s, n in counts.items())
    plain = docs.withColumn("mark", F.lit("m"))
    out = Counter((r["doc_id"], r["source"]) for r in mix(plain, weights).collect())
    assert mix(plain, weights).columns == plain.columns

    def drawn(i, source, text):
        unit = int(hashlib.md5(f"mix-1:{'' if i is None else i}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, acc = 0, 0.0, 0.0
        rate = dict((r["source"], r["rate"]) for r in rated)[source]
        p = acc = math.exp(-rate)
        while acc <= unit and acc < 1 - 1e-15:
            k += 1
            p *= rate / k
            acc += p
        return k

    rated = target_rates(plain, weights, 1.0, "source").collect()
    want = Counter()
    for r in corpus:
        if n := drawn(r[0], r[3], r[1]):
            want[r[0], r[3]] += n
    assert out == want
    clash = {n: F.lit(f"{n} of mine") for n in ("_n", "_u", "_key", "_copy", "_cdf", "_source", "_rate", "_parts", "_rows", "n", "rate", "Copy", "c0", "c1")}
    same = mix(docs.withColumns(clash), weights).collect()
    assert Counter((r["doc_id"], r["source"]) for r in same) == want and all(r[n] == f"{n} of mine" for r in same for n in clash)
    told = mix(docs.withColumn("copy", F.lit("mine")), weights, tell=True)
    assert told.columns == [*docs.columns, "copy", "n_copies", "mix_key"] and {r["copy"] for r in told.collect()} >= {0}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)  # as with more sources than may be broadcast
    assert Counter((r["doc_id"], r["source"]) for r in mix(docs, weights).collect()) == want
    assert mix(none).count() == 0 and mix(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"))).columns == ["doc_id", "source"]


def test_mixing_moves_texts_once(docs):
    plan = mix(docs)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_mixing_reaches_its_shares(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("source"))
    got = {r["source"]: r["count"] for r in mix(docs, {"rare": 1.0, "common": 1.0}).groupBy("source").count().collect()}
    assert abs(got["rare"] - 10_000) < 600 and abs(got["common"] - 10_000) < 500


def test_mixing_reaches_shares_of_rare_sources(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.when(F.col("id") % 200 == 0, "rare").when(F.col("id") == 1, None).otherwise("common").alias("source"))
    weights = {"rare": 1.0, "common": 1.0}
    rates = {r["source"]: r["rate"] for r in target_rates(docs, {**weights}, 1.0, "source").collect()}
    assert rates["rare"] == pytest.approx(60_000 / 3 / 300) and rates[None] == pytest.approx(20_000)
    rows = mix(docs, weights, tell=True).select("doc_id", "source", "copy", "n_copies").collect()
    got = Counter(r["source"] for r in rows)
    assert all(abs(got[s] - 20_000) < 800 for s in ("rare", "common", None))
    counts = Counter(r["doc_id"] for r in rows if r["source"] == "rare")
    assert all(r["n_copies"] == counts[r["doc_id"]] for r in rows if r["source"] == "rare")
    n = [counts[i] for i in range(0, 60_000, 200)]
    mean = sum(n) / 300  # Poisson: the variance is the mean
    assert 0.7 < sum((x - mean) ** 2 for x in n) / 299 / mean < 1.4
    assert sorted(r["copy"] for r in rows if r["doc_id"] == 1) == list(range(got[None]))


# --- 10 ---


def brute_near(rows, percent=85):
    def grams(text):
        w = split(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()

    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i) if s else i) for i, s in sets)


def chain(rng):
    """Neighbours are alike and ends are not, so a star around the least id can't see every link."""
    words_ = [f"c{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(12):
        rows.append(" ".join(words_))
        at = k * 9
        words_[at : at + 2] = [f"n{k}a", f"n{k}b"]
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark, docs, corpus, none):
    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in corpus[:-1]]
    taken = {i for i, _ in rows}
    rows += [(5000 + k, t) for k, t in enumerate(chain(rng))]
    base = [f"b{rng.randrange(10**6)}" for _ in range(70)]
    for k in range(60):  # a crowd around the threshold
        w = base.copy()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(70)] = f"r{rng.randrange(10**6)}"
        rows.append((6000 + k, " ".join(w)))
    assert 3 in taken
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = near_dedup.near_duplicates(table).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    left = near_dedup.drop_near_duplicates(table)
    assert left.columns == table.columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.drop_near_duplicates(none).count() == 0


def test_one_row_of_each_group_of_copies_stays(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(30)) for k in "abcd")
    e = d.replace(d.split()[29], "other")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, a), (None, d), (None, d), (8, e), (8, e + " "), (None, "only null"), (None, "only null"), (2, ""), (2, ""), (None, None), (3, " ")]
    table = spark.createDataFrame([(i, t, k % 2) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _id int").withColumn("_t1", F.lit("x"))
    left = near_dedup.drop_near_duplicates(table)
    assert left.columns == table.columns
    assert Counter((r["doc_id"], (r["text"] or "").strip()) for r in left.collect()) == Counter([(1, a), (5, b), (7, c), (8, e), (None, "only null"), (2, ""), (2, ""), (None, ""), (3, "")])
    ids = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(table).collect())
    assert ids == Counter([(1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (7, 7, True), (None, 1, False), (None, 8, False), (None, 8, False), (8, 8, True), (8, 8, True), (None, None, True), (None, None, True), (2, 2, True), (2, 2, True), (None, None, True), (3, 3, True)])


def test_unlike_members_of_a_bucket_give_few_pairs(spark, monkeypatch):
    """One band of one value puts all texts with a common passage into one bucket; few of their pairs are compared."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, f"{passage} " + " ".join(f"r{rng.randrange(10**9)}" for _ in range(25))) for k in range(2000)]
    rows += [(5000 + k, rows[k][1].rsplit(" ", 1)[0] + " changed") for k in range(0, 2000, 40)]  # linked with one text each
    compared = []
    real = near_dedup._links
    monkeypatch.setattr(near_dedup, "_links", lambda pairs, texts: compared.append(pairs.count()) or real(pairs, texts))
    monkeypatch.setattr(near_dedup, "signatures", lambda sets, bands, rows: np.ones((len(sets), bands), np.uint64))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=1).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    assert sum(compared) < 3 * len(rows)


def test_signatures_estimate_similarity():
    rng = np.random.Generator(np.random.PCG64(2))
    agree = defaultdict(list)
    for n in (3, 40, 900):
        for _ in range(60):
            shared, rest = rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            a, b = np.unique(np.concatenate([shared, rest[:n]])), np.unique(np.concatenate([shared, rest[n:]]))
            s = near_dedup.signatures([a, b], 128, 1)
            agree[n].append((s[0] == s[1]).mean())
    assert all(abs(np.mean(v) - 1 / 3) < 0.08 for v in agree.values())
