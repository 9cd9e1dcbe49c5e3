"""Nulls, repeated rows and clashing columns in operators and pipeline stages; even key ranges."""

import numpy as np

import corpus_pipeline
from storeline.llm import blocks, cotraining, mixing, repeats

SF = "/root/testdata/sf0.001"


def test_anchors_fill_the_key_ranges_evenly():
    rng = np.random.RandomState(0)
    text = bytes(rng.choice(list(b"abcdefgh jklm "), 400_000).astype(np.uint8)).decode()
    h = np.sort(repeats.Picks(*repeats.UNITS["bytes"]([text])).h)
    counts = np.diff(blocks.bucket_cuts(h, 500))
    assert counts.max() <= 3 * counts.mean()


def test_span_hashes_in_pieces_equal_one_piece(monkeypatch):
    data = np.frombuffer(b"the quick brown fox " * 50 + b"x" * 300, np.uint8)
    at, end, _ = blocks.word_spans(data, np.array([0, len(data)]))
    whole = blocks.span_hashes(data, at, end)
    monkeypatch.setattr(blocks, "_PIECE", 16)
    assert (blocks.span_hashes(data, at, end) == whole).all()
    assert len(blocks.span_hashes(data, at[:0], end[:0])) == 0


def test_mix_of_rows_without_ids_meets_its_budget(spark):
    rows = [(None, "one two three four", "b" if i % 10 else "a") for i in range(400)]
    rows = [(d, f"{t} {i}", s) for i, (d, t, s) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs, repetitions=1.5).toPandas()
    assert 0.95 * 2000 <= got["n_tokens"].sum() <= 2000 and set(got["source"]) == {"a", "b"}
    twice = mixing.mixed(docs.union(docs), repetitions=1.5).toPandas()
    assert 0.95 * 4000 <= twice["n_tokens"].sum() <= 4000


def test_classifier_with_clashing_columns_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = docs.selectExpr("*", "1 AS y", "'k' AS keep_0", "2 AS source_bin", "3 AS chars")
    plain, clash = cotraining.fit(docs, labels), cotraining.fit(odd, labels)
    want = {r.doc_id: r.score for r in cotraining.score_documents(docs, plain).collect()}
    got = cotraining.score_documents(odd, clash, keep=("doc_id", "keep_0", "chars")).collect()
    assert {r.doc_id: r.score for r in got} == want and all((r.keep_0, r.chars) == ("k", 3) for r in got)
    nulls = spark.createDataFrame([(None, None, None, None), (1, "", None, "en")], "doc_id long, text string, source string, lang string")
    assert cotraining.score_documents(nulls, plain).count() == 2
    assert cotraining.score_documents(nulls.limit(0), plain).count() == 0


def test_stages_keep_extra_columns_and_one_of_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    odd = docs.selectExpr("*", "doc_id * 1000000007 AS extra", "named_struct('a', array(doc_id)) AS nested", "'b' AS block")
    once = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    twice = corpus_pipeline.near_dedup(spark, odd.union(odd), SF)
    assert twice.columns == odd.columns
    ids = [r.doc_id for r in twice.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == once and len(ids) < n
    passages = corpus_pipeline.passage_dedup(spark, odd, SF)
    assert passages.columns == odd.columns
    rows = passages.collect()
    assert all(r.extra == r.doc_id * 1000000007 and r.nested.a == [r.doc_id] and r.n_chars == len(r.text) for r in rows)
    mix = corpus_pipeline.mix(spark, odd, SF)
    assert mix.columns == odd.columns and mix.where("block is not null").count() == 0 and mix.count() > 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_dedup, corpus_pipeline.passage_dedup, corpus_pipeline.mix):
        assert stage(spark, docs, SF).count() == 0


def test_every_round_hands_over_documents_that_were_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    unlabelled = docs.join(labels, "doc_id", "left_anti").count()
    was = cotraining.EXCHANGED
    cotraining.EXCHANGED = max(5, unlabelled // 20)
    try:
        fitted = np.array(cotraining.fit(docs, labels)["fitted"])
    finally:
        cotraining.EXCHANGED = was
    assert len(fitted) == cotraining.ROUNDS + 1
    assert (np.diff(fitted, axis=0) > 0).all()


def test_a_third_of_the_rows_with_one_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = docs.unionByName(docs.selectExpr("1L AS doc_id", "text", "lang", "source", "n_chars"))
    a, b = cotraining.fit(odd, labels), cotraining.fit(odd.repartition(5), labels)
    assert all((x == y).all() for x, y in zip(a["views"], b["views"]))


def test_mix_equals_a_plain_loop(spark):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    rng = np.random.RandomState(3)
    rows = [(i, " ".join(["w"] * int(rng.randint(0, 30))), rng.choice(["big", "big", "big", "mid", "small", None]))
            for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    row = F.xxhash64("doc_id", "text", F.coalesce("source", F.lit("")))
    place = {r.doc_id: r.p for r in docs.select("doc_id", F.xxhash64(row, F.lit(17)).alias("p")).collect()}
    groups = {}
    for i, t, s in rows:
        groups.setdefault(s or "", []).append((place[i], i, len(t.split())))
    tokens = {s: sum(n for _, _, n in g) for s, g in groups.items()}
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items()}

    def most(a):
        z = sum(p ** a for p in share.values())
        return max(p ** a / z / p for p in share.values())

    low, high = 0.0, 1.0   # the smallest exponent that reads no source more than twice
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if most(mid) <= 2.0 else (mid, high)
    got = mixing.mixed(docs, repetitions=2.0).toPandas()
    z = sum(p ** high for p in share.values())
    want = Counter()
    for s, g in groups.items():
        quota = share[s] ** high / z * total
        full, rest = int(quota // tokens[s]), math.floor(quota - quota // tokens[s] * tokens[s])
        used = 0
        for _, i, n in sorted(g):
            want[i] += full
            if used is not None and used + n <= rest:
                used += n
                want[i] += 1
            else:
                used = None
    # the exponent is bisected to 1 / 32^5: a source's cut may move by a document
    have = Counter(got["doc_id"])
    off = {i: have[i] - want[i] for i in set(have) | set(want) if have[i] != want[i]}
    assert len(off) <= len(groups) and set(off.values()) <= {-1, 1}
    for _, g in got.groupby(["source", "block"], dropna=False):
        assert g["doc_id"].is_unique


def test_fingerprints_of_every_text_and_its_edited_one(spark, tmp_path):
    import hashlib

    from storeline.llm import winnowing

    rows = [(5, "a b c d e f g h i j k l m n"), (9, None), (2, "x"), (7, "a b c d e f g h i j k l m n"), (-3, "né " * 40),
            (10**15, "some other words here, quite a few of them to fill two windows or more")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, own string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in winnowing.op7_winnowing(spark, str(tmp_path)).collect()}
    order = sorted(rows)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == t:
            assert got[i].near_edited == 1 and got[i].fingerprint == got[i].edited_fingerprint
    assert got[5].fingerprint == got[7].fingerprint != got[10**15].fingerprint and got[5].near_next == 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert winnowing.op7_winnowing(spark, f"{tmp_path}/none").count() == 0


def test_winnowing_equals_a_plain_loop_over_windows(spark):
    from pyspark.sql import functions as F

    from storeline.llm import winnowing

    rng = np.random.RandomState(1)
    texts = [" ".join(rng.choice(list("abcdef"), int(n))) for n in (1, 3, 4, 10, 11, 12, 200)]
    k, w = winnowing.K, winnowing.W
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", winnowing.selected(F.col("text")).alias("s"))
    for r in df.collect():
        words = r.text.split()
        n = max(1, len(words) - k + 1)
        picked = {((1 << 24) - 1) - (x & ((1 << 24) - 1)): x >> 24 for x in r.s}
        assert all(0 <= p < n for p in picked)
        if n < w:
            assert len(r.s) == 1
            continue
        # every window has a selected gram, and none of its grams is smaller
        for a in range(n - w + 1):
            assert any(a <= p < a + w for p in picked)
        assert list(picked) == sorted(picked)
