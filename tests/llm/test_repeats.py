"""Repeat removal against brute force, on given documents and spliced ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storeline.llm.substring_rlz import remove_repeated_passages
from storeline.llm.suffix_array import remove_repeated_bytes

DOCS = "/root/testdata/sf0.001/documents.parquet"


def brute(rows, unit):
    units = [(d, (t or "").encode().split() if unit == "words" else (t or "").encode()) for d, t in rows]
    first = {}
    for d, u in units:
        for s in range(len(u) - 49):
            k = tuple(u[s:s + 50])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, u in units:
        gone = [False] * len(u)
        for s in range(len(u) - 49):
            if first[tuple(u[s:s + 50])] < d:
                gone[s:s + 50] = [True] * 50
        kept = [x for x, g in zip(u, gone) if not g]
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = len(u), sum(gone), runs, b" ".join(kept) if unit == "words" else bytes(kept)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(DOCS).select("doc_id", "text").collect()][:120]
    rng, base = random.Random(3), [t for _, t in rows[:20]]
    for i in range(80):
        a, b = rng.choice(base), rng.choice(base)
        x, y = rng.randrange(len(a)), rng.randrange(len(b))
        rows.append((rng.randrange(1000, 10**6) * 1000 + i, f"{a[x:x + rng.randrange(900)]} z{i} {b[y:y + 400]}"))
    return rows + [(10**12, None), (10**12 + 1, ""), (10**12 + 2, base[0] * 8), (10**12 + 3, base[1]),
                   (10**12 + 4, "word " * 300)]


@pytest.mark.parametrize("hot", [2000, 3])
@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_removed_units(spark, rows, unit, hot):
    f, n = (remove_repeated_passages, "n_words") if unit == "words" else (remove_repeated_bytes, "n_bytes")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("blk", F.lit("x"))
    got = {r.doc_id: (r[n], r.n_removed, len(r.spans), r.kept.encode() if unit == "words" else bytes(r.kept))
           for r in f(docs, block_bytes=60_000, hot=hot).collect()}
    assert got == brute(rows, unit)


def test_empty_null_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in remove_repeated_passages(docs).collect())
    assert got == [(-1, 0), (5, 80), (5, 80), (7, 80)]  # a null id is the smallest
    assert remove_repeated_passages(docs.limit(0)).count() == 0
    assert remove_repeated_bytes(docs.limit(0)).count() == 0


def test_layout_keeps_white_space(spark):
    same = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, same), (2, f"a\n\nb {same}  c")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in remove_repeated_passages(docs, layout=True).collect()}
    assert got == {1: same, 2: "a\n\nb c"}


def test_greedy_factors_by_longest_match():
    from storeline.llm.substring_rlz import factor, longest_matches

    rng = np.random.RandomState(7)
    passage = rng.randint(0, 40, 300)
    texts, ids = [], []
    for i in range(60):
        a = rng.randint(0, 220)
        t = passage[a:a + rng.randint(50, 85)].copy()
        if rng.rand() < .5:
            t[rng.randint(len(t))] = rng.randint(0, 40)
        texts.append(t)
        ids.append(int(rng.randint(0, 25)) if rng.rand() < .9 else -(2**63))
    sizes, ids = np.array([len(t) for t in texts]), np.array(ids)
    units = np.concatenate(texts).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    match = longest_matches(units, ids, starts, sizes)
    want = []
    for t, i in zip(texts, ids):
        earlier = [list(u) for u, j in zip(texts, ids) if j < i]
        for p in range(len(t)):
            best = 0
            for u in earlier:
                for q in range(len(u)):
                    k = 0
                    while p + k < len(t) and q + k < len(u) and t[p + k] == u[q + k]:
                        k += 1
                    best = max(best, k)
            want.append(best)
    assert match.tolist() == want
    hits = factor(units, ids, sizes)
    at = np.concatenate([s + np.arange(n - 49) for s, n in zip(starts, sizes)])
    assert hits.tolist() == (match[at] >= 50).tolist() and 0 < hits.sum() < len(hits)
