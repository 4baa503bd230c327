from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, start=0, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, blanks, repeated ids and one very long text."""
    rng = random.Random(5)
    rows, i = [], 0
    passage = words(rng, 60)

    def add(text, source="src0", lang="en"):
        nonlocal i
        rows.append((i, text, lang, source, len(text or "")))
        i += 1

    base = [words(rng, rng.randrange(30, 200)) for _ in range(20)]
    for k, t in enumerate(base):
        add(t, f"src{k % 4}")
    for k in range(8):
        add(base[k])
        w = base[k].split()
        w[len(w) // 2] = "changed"
        add(" ".join(w))
        add(f"{words(rng, 20)}\n{passage}\t{words(rng, 25)}", "src1")
    add(None)
    add("")
    add(" \n\t ")
    add("one two")
    add("ONE two")
    add("  lead and trail  ")
    add(words(rng, 30_000, size=5000), "src2")
    add("a b c d e " * 300)
    rows.append((3, base[3], "en", "src9", 1))  # a repeated row but for its source
    rows.append((4, "another text for an id that is taken " + words(rng, 40), "en", "src9", 1))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
