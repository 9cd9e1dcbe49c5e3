"""Stock deduction as a stateful Structured Streaming job.

Events arrive as a stream: receipt lines (an item plus its sale's store and time) and changes of stock. They
are grouped by a hash bucket of (product, store); a stateful processor holds level and threshold of each key in a
map state of the bucket, whose entries are pages of some thousand keys, seeded from the ``stock`` table. Lines
follow the row-by-row rule of ``operators.deduction``: NO_STOCK_ROW when the
key has no stock, CHECK_QUANTITY for a non-positive quantity, SHORT when
the level is too low (nothing consumed), else OK and the level drops.
Changes of stock (``kind``):

* ``STOCK`` — the shelf's level becomes ``quantity`` and its threshold ``reorder_threshold``: a product is
  listed (LISTED) or its level corrected (CORRECTED); a level below 0 is refused (CHECK_LEVEL);
* ``RESTOCK`` — ``quantity`` more (RESTOCKED; NO_STOCK_ROW, CHECK_QUANTITY);
* ``DELIST`` — the row goes (DELISTED; NO_STOCK_ROW).

Order: micro-batches in arrival order; inside a micro-batch the rows of one
key are sorted by the arrival columns. A micro-batch reads the pages of the keys that
it touches and writes those that it changes, no others. State lives in the RocksDB state
store under the query's checkpoint, so a lost executor or a restarted query
resumes from the last committed batch. Each decision carries the remaining
level and says whether it left the level below the threshold: the reorder alert on the
stream, written by the same job to a sink of its own.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storeline.operators import fold
from storeline.operators.deduction import BAD_QTY, NO_STOCK, OK, SHORT
from storeline.operators.fold import KEY, take_in_order
from storeline.session import scratch_path, ship_package
from storeline.streaming import arrivals

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"

KEYS_PER_BUCKET = 16384
MIN_BUCKETS = 64
PAGES = 16  # of a bucket: an entry for each key would cost two calls a key, one for all rewrites untouched ones
NO_THRESHOLD = -2 ** 31  # in a page, whose bytes are pickled whole, lists value by value
FEW_RUNS = 4  # keys left in a round from which each goes on alone

LINE, STOCK, RESTOCK, DELIST = "LINE", "STOCK", "RESTOCK", "DELIST"
LISTED, CORRECTED, RESTOCKED, DELISTED, BAD_LEVEL = "LISTED", "CORRECTED", "RESTOCKED", "DELISTED", "CHECK_LEVEL"

DECISION_SCHEMA = T.StructType([
    T.StructField("sale_id", T.LongType()),
    T.StructField("product_upc", T.LongType()),
    T.StructField("store_id", T.IntegerType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("decision", T.StringType()),
    T.StructField("level_after", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("reorder_threshold", T.IntegerType()),
    T.StructField("low", T.BooleanType()),
])


class Shelf:
    """Level and threshold of one key while a micro-batch passes; no level, no stock row."""

    def __init__(self, level: int | None, threshold: int | None):
        self.level, self.threshold = level, threshold

    def lines(self, quantity: pd.Series) -> tuple[np.ndarray, list]:
        """Decisions and levels after each of a run of receipt lines."""
        n = len(quantity)
        if self.level is None:
            return np.full(n, NO_STOCK, dtype=object), [None] * n
        q = quantity.fillna(0).to_numpy(np.int64)
        valid = q > 0
        before, self.level = take_in_order(q, valid, self.level)
        ok = valid & (q <= before)
        return np.where(ok, OK, np.where(valid, SHORT, BAD_QTY)).astype(object), (before - np.where(ok, q, 0)).tolist()

    def change(self, kind: str, quantity: int | None, threshold: int | None) -> str:
        if kind == STOCK:
            if quantity is None or quantity < 0:
                return BAD_LEVEL
            done = LISTED if self.level is None else CORRECTED
            self.level, self.threshold = quantity, threshold
            return done
        if self.level is None:
            return NO_STOCK
        if kind == DELIST:
            self.level = self.threshold = None
            return DELISTED
        if quantity is None or quantity <= 0:
            return BAD_QTY
        self.level += quantity
        return RESTOCKED


class Pages:
    """The shelves of one bucket while a micro-batch passes: pages are read when first asked for, and
    written when changed."""

    def __init__(self, state):
        self.state, self.pages, self.changed = state, {}, set()

    @staticmethod
    def of(key: tuple[int, int]) -> int:
        return (key[0] * 2654435761 + key[1] * 40503 >> 8) % PAGES

    def page(self, at: int) -> dict:
        if at not in self.pages:
            kept = self.state.getValue((at,))
            upc, store, level, limit = kept or ((), b"", (), b"")
            limit = [None if th == NO_THRESHOLD else th for th in array("i", bytes(limit))]
            self.pages[at] = dict(zip(zip(upc, array("i", bytes(store))), zip(level, limit)))
        return self.pages[at]

    def get(self, key: tuple[int, int]) -> tuple | None:
        return self.page(self.of(key)).get(key)

    def set(self, key: tuple[int, int], value: tuple | None) -> None:
        page = self.page(self.of(key))
        if value is None:
            page.pop(key, None)
        else:
            page[key] = value
        self.changed.add(self.of(key))

    def write(self) -> None:
        for at in self.changed:
            page = self.pages[at]
            if page:
                (upc, store), (level, limit) = zip(*page), zip(*page.values())
                self.state.updateValue((at,), (
                    list(upc), array("i", store).tobytes(), list(level),
                    array("i", [NO_THRESHOLD if th is None else th for th in limit]).tobytes()))
            else:
                self.state.removeKey((at,))


def _values(column: pd.Series) -> list:
    """Whole numbers of a column, None where missing."""
    c = column.astype("Int64")
    return [None if m else v for v, m in zip(c.fillna(0).tolist(), c.isna().tolist())]


def _numbers(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of a column and whether each is set."""
    c = column.astype("Int64")
    return c.fillna(0).to_numpy(np.int64), c.notna().to_numpy(bool)


class Runs:
    """The rows of a micro-batch in runs of one key each. The first rows of all runs are decided together, then
    the second rows, and so on; when few runs are left, each goes on alone (``Shelf``)."""

    def __init__(self, pdf: pd.DataFrame, starts: np.ndarray, had: list, placed: np.ndarray):
        n = len(pdf)
        self.pdf, self.starts, self.placed = pdf, starts, placed
        self.size = np.append(starts[1:], n) - starts
        self.kind = pdf["kind"].to_numpy(dtype=object)
        self.quantity, self.quantity_set = _numbers(pdf["quantity"])
        self.new, self.new_set = _numbers(pdf["reorder_threshold"])
        level, limit = [h and h[0] for h in had], [h and h[1] for h in had]
        # of each run: whether the key has a stock row, its level, whether it has a threshold, which
        self.state = [np.array([v is not None for v in level], dtype=bool), np.array([v or 0 for v in level], dtype=np.int64),
                      np.array([v is not None for v in limit], dtype=bool), np.array([v or 0 for v in limit], dtype=np.int64)]
        self.before = [v.copy() for v in self.state]
        # of each row: its decision, and the state that it left
        self.decision = np.empty(n, dtype=object)
        self.left = [np.zeros(n, dtype=v.dtype) for v in self.state]

    def fold(self) -> None:
        # a type for each row: line, new level, no more stock row, more stock
        line, stock, delist = (self.kind == k for k in (LINE, STOCK, DELIST))
        active, r = np.arange(len(self.starts)), 0
        while len(active) > FEW_RUNS:
            i = self.starts[active] + r
            has, level, limited, limit = (v[active] for v in self.state)
            q, q_set = self.quantity[i], self.quantity_set[i]
            valid = q_set & (q > 0)
            fits = has & valid & (q <= level)
            to = stock[i] & self.placed[active] & q_set & (q >= 0)
            gone = delist[i] & has
            more = ~line[i] & ~stock[i] & ~delist[i] & has & valid
            self.decision[i] = np.select(
                [~self.placed[active], to & has, to, stock[i], ~has, gone, ~valid, more, fits],
                [NO_STOCK, CORRECTED, LISTED, BAD_LEVEL, NO_STOCK, DELISTED, BAD_QTY, RESTOCKED, OK], SHORT).astype(object)
            level = np.where(to, q, level + np.where(more, q, 0) - np.where(line[i] & fits, q, 0))
            limited, limit = np.where(to, self.new_set[i], limited & ~gone), np.where(to, self.new[i], limit)
            for all_runs, rows, now in zip(self.state, self.left, ((has | to) & ~gone, level, limited, limit)):
                all_runs[active] = rows[i] = now
            r += 1
            active = active[self.size[active] > r]
        for run in active:
            self._alone(run, self.starts[run] + r, self.starts[run] + self.size[run], line)

    def _alone(self, run: int, a: int, b: int, line: np.ndarray) -> None:
        shelf = Shelf(*(self.shelf(run) or (None, None)))
        after, threshold = [], []
        i = a
        while i < b:
            if not line[i]:
                whole = [int(v[i]) if s[i] else None for v, s in ((self.quantity, self.quantity_set), (self.new, self.new_set))]
                self.decision[i] = shelf.change(self.kind[i], *whole) if self.placed[run] else NO_STOCK
                after.append(shelf.level)
                j = i + 1
            else:
                stop = np.flatnonzero(~line[i:b])
                j = i + int(stop[0]) if len(stop) else b
                self.decision[i:j], left = shelf.lines(self.pdf["quantity"].iloc[i:j])
                after += left
            threshold += [shelf.threshold] * (j - i)
            i = j
        for values, (given, value) in ((after, (0, 1)), (threshold, (2, 3))):
            self.left[given][a:b] = [v is not None for v in values]
            self.left[value][a:b] = [v or 0 for v in values]
        for all_runs, rows in zip(self.state, self.left):
            all_runs[run] = rows[b - 1]

    def shelf(self, run: int) -> tuple | None:
        """Level and threshold that a run left, None without a stock row."""
        has, level, limited, limit = (v[run] for v in self.state)
        return (int(level), int(limit) if limited else None) if has else None

    def changed(self) -> list[int]:
        """Runs of keys whose stock row is not as it was."""
        (h0, l0, t0, v0), (h, l, t, v) = self.before, self.state
        return np.flatnonzero(self.placed & ((h != h0) | (h & ((l != l0) | (t != t0) | (t & (v != v0)))))).tolist()

    def after(self) -> pd.array:
        return pd.arrays.IntegerArray(self.left[1].astype(np.int32), ~self.left[0])

    def threshold(self) -> pd.array:
        return pd.arrays.IntegerArray(self.left[3].astype(np.int32), ~(self.left[0] & self.left[2]))


class StockKeeper(StatefulProcessor):
    """Levels of one bucket of (product, store) keys.

    The grouping key is a hash bucket of (product, store), so one Python
    call serves every key of the bucket that a micro-batch touches, instead of
    one call per key.
    """

    def __init__(self, order_by: Sequence[str] = ("date_time", "sale_id")):
        self.order_by = tuple(order_by)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("shelves", "page int",
                                        "upc array<long>, store binary, level array<int>, threshold binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        # the rows of a bucket may come in several calls: each adds to the pages that there are
        pages = Pages(self.state)
        columns = [_values(initialState[c]) for c in (*KEY, "inventory_level", "reorder_threshold")]
        keys = list(zip(*columns[:2]))
        inside: dict[int, dict] = {}
        for at, key, value in zip(map(Pages.of, keys), keys, zip(*columns[2:])):
            inside.setdefault(at, {})[key] = value
        for at, found in inside.items():
            pages.page(at).update(found)
        pages.changed |= inside.keys()
        pages.write()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        # same order as Spark's ascending sort: missing values first
        pdf = pdf.sort_values([*KEY, *self.order_by], kind="stable", ignore_index=True,
                              na_position="first")
        store = pdf["store_id"].fillna(-1)
        edge = (pdf["product_upc"] != pdf["product_upc"].shift()) | (store != store.shift())
        starts = np.flatnonzero(edge)
        pages = Pages(self.state)
        at = [None if st is None else (u, st) for u, st in zip(*[_values(pdf[c].iloc[starts]) for c in KEY])]
        had = [pages.get(k) if k else None for k in at]
        runs = Runs(pdf, starts, had, np.array([k is not None for k in at], dtype=bool))
        runs.fold()
        for i in runs.changed():
            pages.set(at[i], runs.shelf(i))
        pages.write()
        after, threshold = runs.after(), runs.threshold()
        low = pd.Series(after < threshold).fillna(False).to_numpy(bool) & (runs.decision == OK)
        yield pd.DataFrame({
            "sale_id": pdf["sale_id"].astype("Int64"), "product_upc": pdf["product_upc"].astype("int64"),
            "store_id": pdf["store_id"].astype("Int32"), "quantity": pdf["quantity"].astype("Int32"),
            "decision": runs.decision, "level_after": after, "kind": pdf["kind"],
            "reorder_threshold": threshold, "low": low})

    def close(self) -> None:
        pass


def _pickle_processor_by_value() -> None:
    """Ship this module's code inside the pickled processor.

    The stateful operator also unpickles the processor in a driver-side
    Python runner that does not see files added with ``addPyFile``; pickled
    by value, the processor needs nothing but pyspark, pandas and numpy.
    """
    for module in (sys.modules[__name__], fold):
        cloudpickle.register_pickle_by_value(module)


def ensure_state_store(spark: SparkSession) -> None:
    """The stateful processor API needs the RocksDB state store; with state as
    large as the stock table, each commit should upload only the changes of
    its micro-batch (changelog checkpointing) unless configured otherwise."""
    if spark.conf.get(STATE_PROVIDER, None) != ROCKSDB:
        spark.conf.set(STATE_PROVIDER, ROCKSDB)
    if spark.conf.get(CHANGELOG, None) is None:
        spark.conf.set(CHANGELOG, "true")


def state_bucket(n_buckets: int):
    """Hash bucket of (product, store): the grouping key of the state."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in KEY]), F.lit(n_buckets)).alias("bucket")


def default_buckets(stock: DataFrame) -> int:
    """About ``KEYS_PER_BUCKET`` stock keys per state bucket (one count of stock)."""
    return max(MIN_BUCKETS, stock.count() // KEYS_PER_BUCKET)


def as_events(items: DataFrame) -> DataFrame:
    """Receipt lines as events; frames that have ``kind`` stay as they are."""
    if "kind" in items.columns:
        return items
    return items.withColumn("kind", F.lit(LINE)).withColumn("reorder_threshold", F.lit(None).cast("int"))


def deduct_stock_stream(items: DataFrame, stock: DataFrame, sale: DataFrame | None = None,
                        order_by: Sequence[str] = ("date_time", "sale_id"),
                        n_buckets: int | None = None) -> DataFrame:
    """Streaming decisions for a streaming ``items`` frame.

    ``items`` is a stream of receipt lines: ``sale_id, product_upc, quantity``
    plus ``store_id`` and the arrival columns; or of events, with ``kind`` and ``reorder_threshold`` too. Lines that do not carry their
    store are looked up in the static ``sale`` table (a stream-static join
    that re-reads ``sale`` every micro-batch, so prefer lines that carry it).
    Stock is loaded into the state once, as initial state; afterwards a
    micro-batch touches only its own keys. Returns a streaming DataFrame of
    ``DECISION_SCHEMA`` rows (append mode).
    """
    ensure_state_store(items.sparkSession)
    ship_package(items.sparkSession)
    _pickle_processor_by_value()
    # the state is found by bucket: the number must not change with the stock table
    n_buckets = n_buckets or MIN_BUCKETS
    items = as_events(items)
    missing = [c for c in ("store_id", *order_by) if c not in items.columns]
    if missing:
        if sale is None:
            raise ValueError(f"items lack {missing} and no sale table was given")
        s = sale.select("sale_id", *[c for c in missing if c != "sale_id"])
        items = items.join(s, "sale_id", "left")
    keyed = items.withColumn("bucket", state_bucket(n_buckets))
    init = (stock.select(*KEY, "inventory_level", "reorder_threshold")
            .withColumn("bucket", state_bucket(n_buckets)).groupBy("bucket"))
    return keyed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=StockKeeper(order_by), outputStructType=DECISION_SCHEMA,
        outputMode="Append", timeMode="None", initialState=init)


def kept_buckets(stock: DataFrame, checkpoint_dir: str, n_buckets: int | None) -> int:
    """The number of state buckets of a checkpoint: chosen at its first start, written beside it,
    and read back at every later one, whatever the stock table's size is by then."""
    spark, path = stock.sparkSession, f"{checkpoint_dir.rstrip('/')}-buckets"
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        kept = spark.read.parquet(path).first()["n_buckets"]
        if n_buckets not in (None, kept):
            raise ValueError(f"the checkpoint has {kept} state buckets, not {n_buckets}")
        return kept
    n_buckets = n_buckets or default_buckets(stock)
    spark.range(1).select(F.lit(n_buckets).cast("int").alias("n_buckets")).write.parquet(path)
    return n_buckets


class Sinks:
    """Decisions and reorder alerts of a stream: one Parquet folder for each micro-batch and sink, written over
    when a micro-batch is run again. Alerts are read from the written decisions, so the stateful operator runs
    once a micro-batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/decisions/batch={batch_id}")
        (batch.sparkSession.read.schema(DECISION_SCHEMA).parquet(f"{self.root}/decisions/batch={batch_id}")
         .filter("low").write.mode("overwrite").parquet(f"{self.root}/alerts/batch={batch_id}"))

    def _read(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], DECISION_SCHEMA)
        return self.spark.read.schema(DECISION_SCHEMA).parquet(f"{self.root}/{name}").select(*DECISION_SCHEMA.names)

    def decisions(self) -> DataFrame:
        return self._read("decisions")

    def alerts(self) -> DataFrame:
        return self._read("alerts")


def _drain(out: DataFrame, sinks: Sinks, checkpoint_dir: str, available_now: bool) -> None:
    writer = out.writeStream.foreachBatch(sinks.write).option("checkpointLocation", checkpoint_dir)
    q = (writer.trigger(availableNow=True) if available_now else writer).start()
    try:
        if available_now:
            q.awaitTermination()
        else:
            q.processAllAvailable()
    finally:
        q.stop()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_to_completion(items_dir: str, items_schema: T.StructType | str, stock: DataFrame,
                      sale: DataFrame | None = None,
                      order_by: Sequence[str] = ("date_time", "sale_id"),
                      files_per_batch: int | None = None, sink_dir: str | None = None,
                      checkpoint_dir: str | None = None,
                      n_buckets: int | None = None) -> DataFrame:
    """Drain every file under ``items_dir`` through the job and return the
    decisions as a batch DataFrame (``availableNow`` trigger, checkpoint in the shared folder)."""
    spark = stock.sparkSession
    reader = spark.readStream.schema(items_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    sinks = Sinks(spark, sink_dir or scratch_path(spark, "stock-stream-out"))
    checkpoint_dir = checkpoint_dir or scratch_path(spark, "stock-stream-ckpt")
    out = deduct_stock_stream(reader.parquet(items_dir), stock, sale, order_by,
                              kept_buckets(stock, checkpoint_dir, n_buckets))
    _drain(out, sinks, checkpoint_dir, available_now=True)
    return sinks.decisions()


def replay(events: DataFrame, stock: DataFrame, order_by: Sequence[str] = ("date_time", "sale_id"),
           rows_per_chunk: int = arrivals.ROWS_PER_CHUNK, sink_dir: str | None = None,
           checkpoint_dir: str | None = None, n_buckets: int | None = None, staged: tuple[str, int] | None = None) -> Sinks:
    """Stream a history of events through the job in arrival order, one chunk a micro-batch.

    ``events`` carry their store and the arrival columns. ``staged``: folder and number of chunks when
    they are staged already. A run on the ``checkpoint_dir`` of an earlier one goes on
    after the chunks that it read. Returns the sinks.
    """
    spark = stock.sparkSession
    events = as_events(events)
    folder, chunks = staged or arrivals.stage_by_arrival(events, order_by, rows_per_chunk)
    sinks = Sinks(spark, sink_dir or scratch_path(spark, "stock-stream-out"))
    checkpoint_dir = checkpoint_dir or scratch_path(spark, "stock-stream-ckpt")
    stream = arrivals.read_arrivals(spark, folder, chunks, events.schema, checkpoint_dir)
    out = deduct_stock_stream(stream, stock, order_by=order_by, n_buckets=kept_buckets(stock, checkpoint_dir, n_buckets))
    _drain(out, sinks, checkpoint_dir, available_now=False)
    return sinks
