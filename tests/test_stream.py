"""The event stream: stock changes between receipt lines, entries of the map state, alerts, restarts."""

import random

import pandas as pd

from storeline.schemas import SPECS
from storeline.streaming import stock_stream as S
from storeline.streaming.arrivals import ChunkReader, planned_chunks, stage_by_arrival

EVENT = ("kind string, seq long, sale_id long, product_upc long, store_id int, quantity int, reorder_threshold int")
ORDER = ("seq",)


def loop(levels, events):
    """Plain loop: {seq: (decision, level after)}, alerts, and what is left."""
    have, out, alerts = dict(levels), {}, set()
    for kind, seq, _, upc, store, q, th in sorted(events, key=lambda e: e[1]):
        k = (upc, store)
        if kind == "STOCK":
            if q is None or q < 0:
                d = "CHECK_LEVEL"
            else:
                d = "CORRECTED" if k in have else "LISTED"
                have[k] = (q, th)
        elif k not in have:
            d = "NO_STOCK_ROW"
        elif kind == "DELIST":
            d = "DELISTED"
            del have[k]
        elif q is None or q <= 0:
            d = "CHECK_QUANTITY"
        elif kind == "RESTOCK":
            d = "RESTOCKED"
            have[k] = (have[k][0] + q, have[k][1])
        elif q <= have[k][0]:
            d = "OK"
            have[k] = (have[k][0] - q, have[k][1])
            if have[k][1] is not None and have[k][0] < have[k][1]:
                alerts.add(seq)
        else:
            d = "SHORT"
        out[seq] = (d, have[k][0] if k in have else None)
    return out, alerts, have


def stock_of(spark, rows):
    return spark.createDataFrame(rows, SPECS["stock"].schema)


def seqs(df, events):
    """Decisions by seq: sale_id carries it here."""
    return {r.sale_id: (r.decision, r.level_after) for r in df.collect()}


def test_list_a_product_and_correct_a_level_half_way(spark, tmp_path):
    stock = stock_of(spark, [(1, 10, 5, 3, 1)])
    first = [("LINE", 1, 1, 1, 10, 3, None), ("LINE", 2, 2, 1, 10, 3, None), ("LINE", 3, 3, 2, 10, 1, None)]
    then = [("STOCK", 4, 4, 2, 10, 4, 2), ("STOCK", 5, 5, 1, 10, 9, 1), ("LINE", 6, 6, 2, 10, 3, None), ("LINE", 7, 7, 1, 10, 3, None),
            ("RESTOCK", 8, 8, 2, 10, 5, None), ("DELIST", 9, 9, 1, 10, None, None), ("LINE", 10, 10, 1, 10, 1, None),
            ("STOCK", 11, 11, 1, 10, -1, None)]
    sink, ckpt = f"file://{tmp_path}/sink", f"file://{tmp_path}/ckpt"
    folder = f"file://{tmp_path}/in"
    stage_by_arrival(spark.createDataFrame(first, EVENT), ORDER, 2, path=folder)
    run = dict(sink_dir=sink, checkpoint_dir=ckpt, n_buckets=2)
    frame = spark.createDataFrame(first, EVENT)
    out = S.replay(frame, stock, ORDER, staged=(folder, 2), **run)
    assert seqs(out.decisions(), first) == loop({(1, 10): (5, 3)}, first)[0]
    assert planned_chunks(spark, ckpt) == 2
    # the second half arrives as further chunks, after a restart on the same checkpoint
    import os
    more, k = stage_by_arrival(spark.createDataFrame(then, EVENT), ORDER, 4, path=f"file://{tmp_path}/more")
    for i in range(k):
        os.rename(f"{tmp_path}/more/chunk={i}", f"{tmp_path}/in/chunk={2 + i}")
    out = S.replay(frame, stock, ORDER, staged=(folder, 2 + k), **run)
    want, alerts, _ = loop({(1, 10): (5, 3)}, first + then)
    assert seqs(out.decisions(), first + then) == want
    assert {r.sale_id for r in out.alerts().collect()} == alerts and alerts
    assert want[4] == ("LISTED", 4) and want[5] == ("CORRECTED", 9) and want[10] == ("NO_STOCK_ROW", None)
    # nothing new: nothing is processed twice
    again = S.replay(frame, stock, ORDER, staged=(folder, 2 + k), **run)
    assert again.decisions().count() == len(want)


def test_random_events_over_many_micro_batches(spark):
    rnd = random.Random(4)
    stock = [(u, 10, rnd.randint(0, 30), rnd.choice([None, 5]), 1) for u in range(1, 6)]
    kinds = ["LINE"] * 8 + ["STOCK", "RESTOCK", "DELIST"]
    events = [(rnd.choice(kinds), i, i, 1 if rnd.random() < .4 else rnd.randint(1, 7), 10,
               rnd.choice([None, -1, 0]) if rnd.random() < .05 else rnd.randint(1, 9), rnd.choice([None, 3, 8])) for i in range(400)]
    frame = spark.createDataFrame(events, EVENT).repartition(3)
    out = S.replay(frame, stock_of(spark, stock), ORDER, rows_per_chunk=70, n_buckets=3)
    want, alerts, _ = loop({(u, st): (lv, th) for u, st, lv, th, _ in stock}, events)
    assert seqs(out.decisions(), events) == want
    assert {r.sale_id for r in out.alerts().collect()} == alerts


class FakeMap:
    def __init__(self):
        self.entries, self.reads, self.writes = {}, [], []

    def getValue(self, k):
        self.reads.append(k)
        return self.entries.get(k)

    def updateValue(self, k, v):
        self.writes.append(k)
        self.entries[k] = v

    def removeKey(self, k):
        self.writes.append(k)
        del self.entries[k]


def test_a_micro_batch_touches_the_pages_of_its_keys_only():
    keeper = S.StockKeeper(ORDER)
    keeper.state = FakeMap()
    keeper.handleInitialState(0, pd.DataFrame({"product_upc": range(1000), "store_id": 1, "inventory_level": 5,
                                               "reorder_threshold": [None, 3] * 500}), None)
    assert sorted(keeper.state.writes) == [(p,) for p in range(S.PAGES)]
    assert max(len(v[0]) for v in keeper.state.entries.values()) < 3 * 1000 / S.PAGES
    keeper.state.writes.clear()
    keeper.state.reads.clear()
    rows = pd.DataFrame([("LINE", 1, 1, 7, 1, 2, None), ("LINE", 2, 2, 7, 1, 9, None), ("LINE", 3, 3, 8, 1, 9, None),
                         ("LINE", 4, 4, 5000, 1, 1, None), ("LINE", 5, 5, 9, None, 1, None)],
                        columns=["kind", "seq", "sale_id", "product_upc", "store_id", "quantity", "reorder_threshold"])
    out = pd.concat(list(keeper.handleInputRows((0,), iter([rows.iloc[:2], rows.iloc[2:]]), None)))
    page = {u: (S.Pages.of((u, 1)),) for u in (7, 8, 5000)}
    assert sorted(keeper.state.reads) == sorted(set(page.values()))
    assert keeper.state.writes == [page[7]]   # the others are as they were
    assert dict(zip(out["sale_id"], out["decision"])) == {1: "OK", 2: "SHORT", 3: "SHORT", 4: "NO_STOCK_ROW", 5: "NO_STOCK_ROW"}
    level = dict(zip(*keeper.state.entries[page[7]][:3:2]))
    assert level[7] == 3 and sum(len(v[0]) for v in keeper.state.entries.values()) == 1000


def test_a_micro_batch_run_again_writes_its_rows_once(spark, tmp_path):
    sinks = S.Sinks(spark, f"file://{tmp_path}/out")
    row = (1, 1, 10, 2, "OK", 1, "LINE", 3, True)
    df = spark.createDataFrame([row], S.DECISION_SCHEMA)
    sinks.write(df, 0)
    sinks.write(df, 0)
    sinks.write(df.limit(0), 1)
    assert [tuple(r) for r in sinks.decisions().collect()] == [row] == [tuple(r) for r in sinks.alerts().collect()]


def test_offsets_are_chunk_numbers(tmp_path):
    (tmp_path / "chunk=1").mkdir()
    (tmp_path / "chunk=1" / "part-0.parquet").write_bytes(b"")
    reader = ChunkReader(str(tmp_path), 3, 1, ["a"])
    assert [reader.latestOffset()["chunks"] for _ in range(4)] == [2, 3, 3, 3]
    assert reader.initialOffset() == {"chunks": 0}
    assert [p.path for p in reader.partitions({"chunks": 0}, {"chunks": 3})] == [str(tmp_path / "chunk=1" / "part-0.parquet")]
    assert reader.partitions({"chunks": 2}, {"chunks": 2}) == []


def test_keys_of_a_bucket_are_folded_together(monkeypatch):
    """Short runs are decided a row of every key at a time: keys that are folded alone are few."""
    alone = []
    lines = S.Shelf.lines
    monkeypatch.setattr(S.Shelf, "lines", lambda self, q: alone.append(len(q)) or lines(self, q))
    rnd = random.Random(7)
    levels = {(u, 1): (rnd.randint(0, 30), rnd.choice([None, 5])) for u in range(1500)}
    kinds = ["LINE"] * 12 + ["STOCK", "RESTOCK", "DELIST"]
    events = [(rnd.choice(kinds), i, i, 3 if rnd.random() < .1 else rnd.randint(0, 1999), 1,
               rnd.choice([None, -1, 0]) if rnd.random() < .05 else rnd.randint(1, 12), rnd.choice([None, 3, 8])) for i in range(6000)]
    keeper = S.StockKeeper(ORDER)
    keeper.state = FakeMap()
    stock = pd.DataFrame([(*k, *v) for k, v in levels.items()], columns=["product_upc", "store_id", "inventory_level", "reorder_threshold"])
    keeper.handleInitialState(0, stock, None)
    names = ["kind", "seq", "sale_id", "product_upc", "store_id", "quantity", "reorder_threshold"]
    got, low = {}, set()
    for a in range(0, len(events), 2000):
        out = pd.concat(list(keeper.handleInputRows((0,), iter([pd.DataFrame(events[a:a + 2000], columns=names)]), None)))
        got |= {s: (d, None if pd.isna(v) else v) for s, d, v in zip(out["sale_id"], out["decision"], out["level_after"])}
        low |= set(out["sale_id"][out["low"]])
    want, alerts, have = loop(levels, events)
    assert got == want and low == alerts
    kept = S.Pages(keeper.state)
    for k in (page for (page,) in list(keeper.state.entries)):
        kept.page(k)
    assert {k: v for page in kept.pages.values() for k, v in page.items()} == have
    assert len(alone) < 200  # one call for each key and micro-batch, or more, otherwise


def test_larger_chunks_have_more_files(spark, tmp_path):
    frame = spark.range(40).selectExpr("id", "id AS seq")
    _, k = stage_by_arrival(frame, ORDER, 2_000_000, path=f"{tmp_path}/in")
    assert k == 1 and len(list((tmp_path / "in" / "chunk=0").glob("*.parquet"))) == 8


def test_chunks_grow_with_the_tables(spark, monkeypatch):
    """A history is replayed in as many micro-batches at every size, unless one owner of keys has most of it."""
    from storeline.plans import workloads as W
    from storeline.streaming import arrivals

    monkeypatch.setattr(arrivals, "ROWS_PER_CHUNK", 10)
    monkeypatch.setattr(W, "LARGEST_CHUNK", 40)

    def events(n, upc):
        return spark.range(n).selectExpr(f"{upc} AS product_upc", "1 AS store_id")
    chunks = {n: -(-n // W._rows_per_chunk(events(n, "id"), events(n, "id"))) for n in (80, 320, 1280)}
    assert chunks == {n: W.KEYS_PER_EVENT for n in chunks}
    assert W._rows_per_chunk(events(1280, "7"), events(1280, "id")) == 40


def test_the_rows_of_a_bucket_are_seeded_in_any_number_of_calls():
    stock = pd.DataFrame({"product_upc": range(3000), "store_id": 2, "inventory_level": range(3000), "reorder_threshold": [None, 3] * 1500})
    keeper = S.StockKeeper(ORDER)
    keeper.state = FakeMap()
    for a in (0, 1000, 2000):
        keeper.handleInitialState(0, stock.iloc[a:a + 1000], None)
    pages = S.Pages(keeper.state)
    assert [pages.get((u, 2)) for u in range(3000)] == [(u, (None, 3)[u % 2]) for u in range(3000)]
    assert len(keeper.state.writes) <= 3 * S.PAGES
