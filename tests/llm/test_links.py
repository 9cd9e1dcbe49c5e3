"""Near-duplicate documents and vectors against brute force, and the pipeline."""

import re

import numpy as np
import pandas as pd

from storeline.llm import blocks, components as graphs, entry, multi_index, superminhash
from storeline.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark):
    base = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rng = np.random.RandomState(0)
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(150):
        w = base[i % 30].split()
        for j in rng.randint(0, len(w), rng.randint(0, 1 + len(w) // 25)):
            w[j] = f"x{i}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(5000, None), (5001, " "), (5002, "One two"), (5003, "one TWO")]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    links = [(a, b) for a in sets for b in sets
             if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got["component_id"].to_dict() == components(sets, links)
    assert got["n_shingles"].to_dict() == {d: len(s) for d, s in sets.items()}
    assert (got["kept"] == (got["component_id"] == got.index)).all()


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "a b c d")],
                                 "doc_id long, text string")
    got = superminhash.near_duplicates(docs).toPandas()
    assert sorted(got["component_id"].fillna(-1)) == [-1, 2, 2, 2] and got["kept"].sum() == 2
    assert superminhash.near_duplicates(docs.limit(0)).count() == 0


def test_estimates_of_similarity():
    a, b = np.arange(1, 2001, dtype=np.uint64), np.arange(201, 2201, dtype=np.uint64)
    from storeline.llm.blocks import mix
    e = mix(np.concatenate([a, b]))
    sig = superminhash.signatures(e, np.array([0, 2000, 4000]), 224)
    assert abs((sig[0] == sig[1]).mean() - 1800 / 2200) < 0.08


def test_near_vectors(spark):
    rng = np.random.RandomState(2)
    centre = rng.randn(12, 16)
    rows = [(i, (centre[i % 12] + 0.17 * rng.randn(16)).astype(float).tolist(), int(i % 12) % 5) for i in range(900)]
    rows += [(1000 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(700)]  # copies
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, rows[0][1], None),
             (5004, [1.0] + [None] * 15, 0), (5005, [1.0], 0)]
    got = multi_index.near_vectors(spark.createDataFrame(
        rows, "vec_id long, embedding array<float>, label int")).toPandas().set_index("vec_id")
    fine = [r for r in rows if r[0] < 5000]
    x = np.array([r[1] for r in fine], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = np.array([r[2] for r in fine])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    ids = np.array([r[0] for r in fine])
    assert (got.loc[ids, "n_links"].to_numpy() == link.sum(1)).all()
    want = components(ids.tolist(), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link))])
    assert got.loc[ids, "component_id"].to_dict() == want
    odd = got.loc[5000:]
    assert (odd["n_links"] == 0).all() and (odd["component_id"] == odd.index).all() and odd["kept"].all()


def test_pipeline_runs_all_stages(spark):
    out = entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    assert 0 < len(out) and set(out["doc_id"]) <= set(docs["doc_id"])
    assert (out["n_tokens"] == out["ids"].map(len)).all()


def test_blocks_of_a_cell_are_bounded(spark, monkeypatch):
    rng = np.random.RandomState(6)
    x = rng.randn(8) + 0.02 * rng.randn(3000, 8)  # one label, one dense cell and its neighbours
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    largest = spark.sparkContext.accumulator(0)
    pairs = spark.sparkContext.accumulator(0)
    links = multi_index._links

    def counted(pdf, least):
        pairs.add(len(pdf) > 3 * multi_index.BLOCK)
        largest.add(1)
        return links(pdf, least)
    monkeypatch.setattr(multi_index, "_links", counted)
    monkeypatch.setattr(multi_index, "CODEWORDS", 2)
    got = multi_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    assert (got["n_links"] == 2999).all() and (got["component_id"] == 0).all()
    assert largest.value > 1 and pairs.value == 0


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text)] * 200 + [(2, text + " end")]
    many = spark.sparkContext.accumulator(0)
    links = superminhash._links

    def counted(pdf, percent):
        many.add(len(pdf) > 2)
        return links(pdf, percent)
    monkeypatch.setattr(superminhash, "_links", counted)
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == 201 and (got["component_id"] == 1).all() and many.value == 0


def test_rows_without_id_lie_in_several_blocks(spark):
    docs = spark.createDataFrame([(None, f"text number {i}") for i in range(400)], "doc_id long, text string")
    texts, n = blocks.with_blocks(docs, 1000, ["doc_id", "text"])
    assert n > 3 and texts.groupBy("blk").count().agg({"count": "max"}).first()[0] < 200


def test_edges_do_not_grow_with_the_pairs_of_a_group(spark, monkeypatch):
    rng = np.random.RandomState(8)
    base = [f"w{i}" for i in range(120)]
    links = superminhash._links
    per_document = []
    for size in (200, 800):
        edges = spark.sparkContext.accumulator(0)

        def counted(pdf, percent, edges=edges):
            out = links(pdf, percent)
            edges.add(len(out))
            return out
        monkeypatch.setattr(superminhash, "_links", counted)
        monkeypatch.setattr(superminhash, "BLOCK_DOCS", 20)
        rows = []
        for i in range(size):
            w = list(base)
            w[rng.randint(120)] = f"x{i}"
            rows.append((i, " ".join(w)))
        got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
        assert (got["component_id"] == 0).all()
        per_document.append(edges.value / size)
    assert max(per_document) < 1.5


def test_the_target_recall_is_met_and_visits_stay_few():
    rng = np.random.RandomState(3)
    x = multi_index._unit(rng.randn(6000, 32))
    books = multi_index.codebook(x[:, :16]), multi_index.codebook(x[:, 16:])
    limit = multi_index.reach(x[:500], books, 0.93, 0.99)
    assert limit < 576 / 4
    fresh = x[3000:3600]
    u = rng.randn(*fresh.shape)
    u = multi_index._unit(u - (u * fresh).sum(1, keepdims=True) * fresh)
    y = 0.93 * fresh + np.sqrt(1 - 0.93 ** 2) * u
    (i, a), (j, b) = (multi_index.border_bounds(h, c) for h, c in zip((fresh[:, :16], fresh[:, 16:]), books))
    (p, _), (q, _) = (multi_index.border_bounds(h, c) for h, c in zip((y[:, :16], y[:, 16:]), books))
    met = sum(p[r] * 24 + q[r] in multi_index.traverse(a[r], b[r], np.inf, limit) for r in range(len(y)))
    assert met / len(y) > 0.97
    whole = multi_index.traverse(a[0], b[0], np.inf, 576)
    assert sorted(whole) == list(range(576)) and (multi_index.traverse(a[0], b[0], np.inf, 50) == whole[:50]).all()


def test_rounds_of_a_small_graph_have_few_tasks(spark):
    own = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = connected_components(spark.range(0, 300).selectExpr("id a", "id + 3 b"))
        assert found.rdd.getNumPartitions() <= 4
        assert {tuple(r) for r in found.collect()} == {(v, v % 3) for v in range(303)}
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def test_components_of_a_small_graph_take_few_jobs(spark):
    edges = spark.range(0, 3000).selectExpr("id a", "id + 7 b").checkpoint()
    spark.sparkContext.setJobGroup("small graph", "")
    try:
        found = connected_components(edges)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("small graph"))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert {tuple(r) for r in found.collect()} == {(v, v % 7) for v in range(3007)} and jobs <= 8


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = np.random.RandomState(5)
    a, b = rng.randint(-3000, 3000, (2, 2500))
    links = [(int(x), int(y)) for x, y in zip(a, b) if x != y] + [(i, i + 1) for i in range(10_000, 10_500)]
    want = components({v for e in links for v in e}, links)
    edges = spark.createDataFrame(links + [(77_777, 77_777)], "a long, b long").repartition(6)
    for together, of_task in ((graphs.EDGES_TOGETHER, 100_000), (10, 50)):
        monkeypatch.setattr(graphs, "EDGES_TOGETHER", together)
        monkeypatch.setattr(graphs, "EDGES_OF_TASK", of_task)
        got = [tuple(r) for r in connected_components(edges).collect()]
        assert len(got) == len(want) and dict(got) == want
