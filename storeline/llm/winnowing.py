"""Document fingerprints by winnowing, with built-in functions only.

Units are words. Every run of K words is hashed; of every W consecutive
hashes the smallest is selected, the rightmost on ties, with its position. Texts that share
W + K - 1 consecutive words share a selected hash. A text with fewer than K words
is one gram; with fewer than W grams, one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K, W = 4, 8
_LOW = (1 << 24) - 1
RUN_IDS = 4096
BROADCAST_RUNS = 100_000  # rows of 16 bytes


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def selected(text: Column, k: int = K, w: int = W) -> Column:
    """The selected grams in order of position, as longs: 40 bits of the gram's hash, then
    24 bits that count positions down (``position`` and ``hash40`` take them apart).

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text, or one without words, has none.
    """
    words = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")), " ")
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]"), _with(
        hashes, lambda h: _with(_grams(h, k), lambda g: F.array_distinct(_least(g, w))))).otherwise(
            F.array().cast("array<bigint>"))


def _grams(h: Column, k: int) -> Column:
    """One long for each run of k words, the smallest value being the one to select first."""
    whole = F.array(F.xxhash64(h).bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.lit(_LOW)))
    return F.when(F.size(h) < k, whole).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(h) - k),
        lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]).bitwiseAND(F.lit(~_LOW)).bitwiseOR(
            F.lit(_LOW) - i)))


def _least(g: Column, w: int) -> Column:
    """The minimum of each window of w grams, by doubling; of all, when there are fewer."""
    def pairs(x: Column, span: int) -> Column:
        n = F.size(x) - span
        return F.zip_with(F.slice(x, 1, n), F.slice(x, span + 1, n), lambda a, b: F.least(a, b))

    span = 1
    steps = []
    while span * 2 <= w:
        steps.append(span)
        span *= 2
    if w > span:
        steps.append(w - span)

    def go(x: Column, rest: list[int]) -> Column:
        return _with(pairs(x, rest[0]), lambda y: go(y, rest[1:])) if rest else x

    return F.when(F.size(g) < w, F.array(F.array_min(g))).otherwise(go(g, steps))


def position(x: Column) -> Column:
    """Index of the gram's first word."""
    return F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))


def hash40(x: Column) -> Column:
    return F.shiftright(x, 24)


def likeness(a: Column, b: Column) -> Column:
    """Common share of the distinct selected hashes (Jaccard); 1 for two texts without words."""
    x, y = (F.array_distinct(F.transform(c, hash40)) for c in (a, b))
    return _with(F.struct(F.size(F.array_intersect(x, y)).alias("both"), F.size(F.array_union(x, y)).alias("any")),
                 lambda n: F.when(n["any"] == 0, F.lit(1.0)).otherwise(n["both"] / n["any"]))


def fingerprint(picked: Column) -> Column:
    """A hex digest of the selected hashes and positions."""
    return F.sha2(F.concat_ws(",", picked.cast("array<string>")), 256)


def with_next(docs: DataFrame, run_ids: int = RUN_IDS) -> DataFrame:
    """doc_id, text, own (``selected``), and next_text and next_own: those of the next document by
    doc_id, of the first after the last. Repeated ids follow each other in the order of
    their texts; null ids come first.

    Ids are cut into runs of ``run_ids`` numbers, one window each. A run's last document is
    followed by the first of the next run that isn't empty: one row for each run
    finds it, and these few documents join the runs as extra rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "run", F.coalesce(F.floor(F.col("doc_id") / run_ids), F.lit(-(2**62))))
    firsts = docs.groupBy("run").agg(F.min("doc_id").alias("doc_id"))
    after = Window.orderBy("run")
    firsts = firsts.select("doc_id", F.coalesce(F.lag("run").over(after),
                                                F.max("run").over(Window.partitionBy())).alias("to_run"))
    if docs.select("run").distinct().count() <= BROADCAST_RUNS:
        firsts = F.broadcast(firsts)
    heads = docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["doc_id"])).groupBy("to_run").agg(
        F.min("text").alias("text")).select(
        F.col("to_run").alias("run"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("extra"))
    rows = docs.select("run", "doc_id", "text", F.lit(0).alias("extra")).unionByName(heads)
    order = Window.partitionBy("run").orderBy("extra", F.asc_nulls_first("doc_id"), "text")
    return rows.withColumn("own", selected(F.col("text"))).select(
        "extra", "doc_id", "text", "own", F.lead("text").over(order).alias("next_text"),
        F.lead("own").over(order).alias("next_own")).where("extra = 0").drop("extra")


def op7_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    out = docs.select("doc_id", n.cast("long").alias("n_chars"), "own", F.col("next_own").alias("next"),
                      F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                               F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                     "own", selected(F.col("edited")).alias("other"), "next")
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
                      fingerprint(F.col("other")).alias("edited_fingerprint"),
                      likeness(F.col("own"), F.col("other")).alias("near_edited"),
                      likeness(F.col("own"), F.col("next")).alias("near_next"))
