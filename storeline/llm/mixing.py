"""Mixing sources to target weights, with built-in functions only.

Temperature mixing: a source's weight is its share of all tokens to the power of an
exponent, normalised. An exponent of 1 keeps the shares, 0 makes sources equal. The exponent is bisected
(32 subintervals a step) until the weights reach a target entropy, or as flat a mix as a limit on
repetitions allows. Weights are realised as blocks: each block of a source is one permutation of its
documents; the last block ends where the source's token budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

BIN_ROWS = 2000
STEPS, PIECES = 5, 32


def n_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def find_exponent(shares: DataFrame, budget_factor: float, entropy: float | None,
                  repetitions: float | None) -> float:
    """The exponent (0 to 1) for ``shares`` (share > 0).

    ``entropy``: of the weights, in nats; reached by bisection, or the nearer end of the range.
    ``repetitions``: the smallest exponent at which no source is read more often than that,
    for a budget of ``budget_factor`` times all tokens; 1 when none allows it.
    """
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        points = [low + (high - low) * i / PIECES for i in range(PIECES + 1)]
        at = shares.select("share", F.explode(F.array(*map(F.lit, points))).alias("a"))
        power = F.pow("share", F.col("a"))
        rows = at.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("share") * F.col("a")).alias("s"),
                                   F.max(power / F.col("share")).alias("most")).collect()  # PIECES + 1 rows
        met = {}
        for r in rows:
            if entropy is not None:  # falls as the exponent grows
                met[r["a"]] = math.log(r["z"]) - r["s"] / r["z"] <= entropy
            else:
                met[r["a"]] = r["most"] / r["z"] * budget_factor <= repetitions
        good = [p for p in points if met.get(p)]
        if not good:
            return high
        high = good[0]
        low = max([p for p in points if p < high], default=high)
        if low == high:
            return high
    return high


def mixed(docs: DataFrame, source: str = "source", budget: int | None = None, entropy: float | None = None,
          repetitions: float | None = None, seed: int = 17) -> DataFrame:
    """``docs`` realised as a mix: every column, plus block (0, 1, ...), order_key and n_tokens.

    A row appears once for each block that reads it; within (source, block) ``order_key`` is the
    permutation. ``budget``: tokens of the mix (default: those of ``docs``). Give ``entropy`` (nats) or
    ``repetitions``. No source exceeds its budget; a document is taken whole or not at all.
    A null source counts as the empty name. Documents without words cost nothing and are read as often as their
    source; a source without any words gets weight 0 and no rows. The place in the permutation comes from
    doc_id, text and source, so rows without an id, or of one id, have places of their own; rows that repeat all three
    share theirs. Columns block, order_key, n_tokens and names that start with
    mix_ are replaced if present. An empty table gives an empty result.
    """
    docs = docs.drop("block", "order_key", "n_tokens", *[c for c in docs.columns if c.startswith("mix_")])
    named = docs.withColumn("mix_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    named = named.withColumn("n_tokens", n_tokens(F.col("text")))
    # place in the last block's permutation: a fraction of the range of longs
    row = F.xxhash64("doc_id", "text", "mix_source")
    place = F.xxhash64(row, F.lit(seed))
    sized = named.select("mix_source", "n_tokens", place.alias("mix_place")).checkpoint()
    totals = sized.groupBy("mix_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).where(
        "tokens > 0").checkpoint()
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return named.drop("mix_source").limit(0).select("*", F.lit(0).alias("block"), F.lit(0).cast("long").alias("order_key"))
    budget = total if budget is None else budget
    shares = totals.withColumn("share", F.col("tokens") / F.lit(total))
    a = find_exponent(shares, budget / total, entropy, repetitions)
    z = shares.agg(F.sum(F.pow("share", F.lit(a)))).first()[0]
    quota = F.pow("share", F.lit(a)) / F.lit(z) * F.lit(budget)
    plan = shares.withColumn("mix_full", F.floor(quota / F.col("tokens"))).withColumn(
        "rest", F.floor(quota - F.col("mix_full") * F.col("tokens"))).withColumn(
        "bins", F.ceil(F.col("rows") / BIN_ROWS)).select("mix_source", "mix_full", "rest", "bins")
    # where the last block ends: first the bin of the permutation, then the place in it
    share_of_range = (F.col("mix_place") / F.lit(2.0**64) + F.lit(0.5))
    binned = sized.join(F.broadcast(plan) if _few(totals) else plan, "mix_source").withColumn(
        "bin", F.least(F.floor(share_of_range * F.col("bins")), F.col("bins") - 1))
    before = Window.partitionBy("mix_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("mix_source", "bin").agg(F.sum("n_tokens").alias("in_bin"), F.first("rest").alias("rest"))
    bins = bins.withColumn("so_far", F.coalesce(F.sum("in_bin").over(before), F.lit(0)))
    last = bins.where("so_far <= rest and so_far + in_bin > rest").select("mix_source", "bin", "so_far")
    inside = Window.partitionBy("mix_source").orderBy("mix_place")
    cut = (binned.join(last, ["mix_source", "bin"])
           .withColumn("upto", F.col("so_far") + F.sum("n_tokens").over(inside))
           .groupBy("mix_source").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.col("mix_place"))).alias("mix_cut")))
    plan = plan.join(cut, "mix_source", "left").select("mix_source", "mix_full", "mix_cut").checkpoint()
    out = named.withColumn("mix_place", place).join(F.broadcast(plan) if _few(totals) else plan, "mix_source")
    copies = F.col("mix_full") + F.when(F.col("mix_place") < F.col("mix_cut"), 1).otherwise(0)
    out = out.withColumn("block", F.explode(F.when(copies > 0, F.sequence(F.lit(0), (copies - 1).cast("int")))))
    # the last, partial block reads the permutation up to the cut
    return out.withColumn("order_key", F.when(F.col("block") == F.col("mix_full"), F.col("mix_place")).otherwise(
        F.xxhash64(row, F.lit(seed), F.col("block") + 1))).drop("mix_source", "mix_place", "mix_full", "mix_cut")


def _few(totals: DataFrame) -> bool:
    """Whether the table of sources (some 60 bytes a row) is small enough to broadcast."""
    return totals.count() <= 100_000


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs, repetitions=2.0).select("doc_id", "source", "block", "order_key", "n_tokens")
