"""Near-duplicate documents by SuperMinHash, banding, verification and connected components.

SuperMinHash (Ertl): element by element, a random permutation of the signature's
slots is drawn step by step; the element offers its j-th slot the value j plus a
random fraction. Values of different slots are correlated so that the estimate varies
less than with independent hashes, and a set stops as soon as no slot can improve.

Documents with equal shingle sets are one vertex. Vertices that share the signature of a
band are candidates; candidate components are cut into blocks by set size and hash, and pairs
of blocks whose sizes admit a link are compared on the full sets. A pair of blocks
holds a bounded number of sets however large its component, and returns a spanning forest of
its links, not the links. Components of those are the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from storeline.functions.sizing import bounded_broadcast, in_few_tasks
from storeline.llm import blocks as B
from storeline.llm.components import connected_components
from storeline.llm.ranks import stored

U = np.uint64
BLOCK_DOCS, BLOCK_SHINGLES = 256, 150_000
PIECE = 1 << 18
BROADCAST_IDS = 2_000_000
SETS_OF_TASK = 50_000  # names of sets, not their shingles


def shingles(texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``words``-word shingles of each text (ASCII lower case), all
    texts after one another, and where each starts. Fewer words make one shingle, none none."""
    data, starts = B.joined_bytes(texts)
    data = B.lower_ascii(data)
    at, end, first = B.word_spans(data, starts)
    h = B.span_hashes(data, at, end)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    pos = np.arange(count.sum()) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    left = np.minimum(first[doc + 1] - pos, words)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    s = np.zeros(len(pos), np.uint64)
    for i in range(words):
        s = np.where(left > i, B.mix(s * U(3) + padded[pos + i]), s)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def signatures(elements: np.ndarray, starts: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash values (documents, slots) of the sets; infinite for an empty set."""
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(n)), n)
    values = np.full(len(n) * slots, np.inf)
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))  # each element's permutation so far
    active = np.arange(len(elements))
    for j in range(slots):
        draw = B.mix(elements[active] + U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + ((draw & U(0xFFFFFF)) % U(slots - j)).astype(np.int64)
        slot = order[active, k]
        order[active, k] = order[active, j]
        order[active, j] = slot
        fraction = (draw >> U(24)).astype(np.float64) / 2.0**40
        np.minimum.at(values, doc[active] * slots + slot, j + fraction)
        if j % 4 == 3 or j < 3:
            open_docs = values.reshape(-1, slots).max(1) > j + 1 if len(n) else np.zeros(0, bool)
            active = active[open_docs[doc[active]]]
            if not len(active):
                break
    return values.reshape(-1, slots)


def _set_keys(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that name each set."""
    total = np.concatenate([np.zeros((2, 1), np.uint64),
                            np.cumsum(np.stack([B.mix(s), B.mix(s ^ B.MIX)]), axis=1)], 1)
    return (total[:, starts[1:]] - total[:, starts[:-1]]).view(np.int64)


def _described(batches, words: int, bands: int, rows: int):
    for part in (p for pdf in batches for p in B.pieces(pdf, PIECE)):
        s, starts = shingles(part["text"], words)
        bits = signatures(s, starts, bands * rows).view(np.uint64).reshape(len(part), bands, rows)
        keys = np.zeros((len(part), bands), np.uint64)
        for r in range(rows):
            keys = B.mix(keys * U(3) + bits[:, :, r])
        keys = B.mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
        n = np.diff(starts)
        a, b = _set_keys(s, starts)
        yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n": n, "set_a": a, "set_b": b,
                            "bands": [k if m else k[:0] for k, m in zip(keys, n)]})


def _sets(batches, words: int):
    for part in (p for pdf in batches for p in B.pieces(pdf, PIECE)):
        s, starts = shingles(part["text"], words)
        a, b = _set_keys(s, starts)
        s = s.view(np.int64)
        yield pd.DataFrame({"rep": part["doc_id"].to_numpy(), "n": np.diff(starts), "set_a": a, "set_b": b,
                            "shingles": [s[i:j] for i, j in zip(starts[:-1], starts[1:])]})


def _links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest (a, b) over components (``comp``) of the links in one block, or between two
    blocks (``side`` 0 and 1)."""
    side = pdf["side"].to_numpy()
    names, comp = np.unique(pdf["comp"].to_numpy(np.int64), return_inverse=True)
    none = pd.DataFrame({"a": names[:0], "b": names[:0]})
    if len(names) < 2:
        return none
    n = pdf["shingles"].map(len).to_numpy()
    doc = np.repeat(np.arange(len(n)), n)
    _, col = np.unique(np.concatenate(pdf["shingles"].tolist()), return_inverse=True)
    often = np.bincount(col)[col] > 1
    _, col = np.unique(col[often], return_inverse=True)
    doc = doc[often]
    order = np.argsort(col, kind="stable")
    col, doc = col[order], doc[order]
    both = np.zeros((len(n), len(n)), np.float32)
    width = 4096
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [c, c + width])
        m = np.zeros((len(n), width), np.float32)
        m[doc[i:j], col[i:j] - c] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    link &= comp[:, None] != comp[None, :]
    if side.any() and not side.all():
        link &= side[:, None] != side[None, :]
    a, b = np.nonzero(link)
    pairs = np.unique(comp[a] * len(names) + comp[b])
    a, b = pairs // len(names), pairs % len(names)
    label = np.arange(len(names))
    while True:  # smallest label among neighbours until nothing changes
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(names)))
    return pd.DataFrame({"a": names[far], "b": names[label[far]]}) if len(far) else none


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, bands: int = 32, rows: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept of every row.

    Linked are documents with 100 * intersection >= percent * union of their shingle sets.
    A pair at the threshold shares a band with probability above 0.99999 by default. Texts
    without words (null included) link with nothing. Rows with equal sets are in one component,
    repeated rows included: all rows that carry its smallest doc_id are kept. Rows with a null
    doc_id are not compared: their component is null, and they are kept. Other columns are
    ignored; an empty table gives an empty result.
    """
    known = docs.where("doc_id is not null").select("doc_id", "text")

    def describe(frame):
        return frame.mapInPandas(lambda b: _described(b, words, bands, rows),
                                 "doc_id long, n long, set_a long, set_b long, bands array<long>")

    described = describe(known).checkpoint()
    key = ["n", "set_a", "set_b"]
    reps = described.where("n > 0").groupBy(*key).agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands")).checkpoint()
    # candidates: the members of a bucket with its smallest
    member = reps.select("rep", F.explode("bands").alias("band"))
    least = member.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("m")).where("m > 1")
    candidate = member.join(least, "band").where("rep <> least").select(
        F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    group = connected_components(candidate).select(F.col("v").alias("rep"), F.col("component").alias("grp"))
    # blocks by size class: sizes of linked sets are at most one class apart
    ratio = float(np.log(100 / percent))
    placed = group.join(reps.drop("bands"), "rep").withColumn(
        "class", F.floor(F.log("n") / ratio + 1e-9)).checkpoint()
    # what holds names of sets only goes on in as many tasks as they fill
    placed, n_tasks = in_few_tasks(placed, SETS_OF_TASK)
    parts = placed.groupBy("grp", "class").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    placed = placed.join(parts, ["grp", "class"]).select(
        "rep", *key, "grp", F.struct("class", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part")).alias("block"))
    # every block of a class meets the blocks of its own class and of the next
    other = parts.select("grp", F.col("class").alias("other"), F.col("parts").alias("others"))
    zero = F.lit(0).cast("long")
    meets = parts.join(other, "grp").where("other between class and class + 1").withColumn(
        "part", F.explode(F.sequence(zero, F.col("parts") - 1))).withColumn(
        "other_part", F.explode(F.sequence(zero, F.col("others") - 1)))
    meets = meets.select("grp", F.struct("class", "part").alias("low"),
                         F.struct(F.col("other").alias("class"), F.col("other_part").alias("part")).alias("high")).where(
        F.col("low") <= F.col("high")).checkpoint()
    meets, _ = in_few_tasks(meets, SETS_OF_TASK)

    # the texts of all candidates are kept once; other texts are not moved while the candidates' ids are few (8 bytes each)
    few, _ = bounded_broadcast(placed.select(F.col("rep").alias("doc_id")).distinct(), BROADCAST_IDS)
    texts = stored(known.join(few, "doc_id"), "candidates")

    def sets(of):
        return texts.join(of.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").mapInPandas(
            lambda b: _sets(b, words), "rep long, n long, set_a long, set_b long, shingles array<long>").dropDuplicates(["rep", *key])

    # first each block for itself, then a chain of the blocks of one class (only large groups have several), then the other
    # pairs: what is one component by then isn't compared again, and an edge joins two components, so that the edges of
    # a large group do not grow with the pairs of its blocks
    placed = placed.withColumn("comp", F.col("rep")).coalesce(n_tasks).checkpoint()
    same = F.col("low") == F.col("high")
    chain = (F.col("low.class") == F.col("high.class")) & (F.col("high.part") == F.col("low.part") + 1)
    for turn in (same, chain, ~same & ~chain):
        held = placed.groupBy("grp", "block").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
        first = held.select("grp", F.col("block").alias("low"), F.col("least").alias("l0"), F.col("most").alias("m0"))
        second = held.select("grp", F.col("block").alias("high"), F.col("least").alias("l1"), F.col("most").alias("m1"))
        apart = F.least("l0", "l1") != F.greatest("m0", "m1")
        pairs = meets.where(turn).join(first, ["grp", "low"]).join(second, ["grp", "high"]).where(apart)
        ends = F.when(same, F.array(F.struct(F.col("low").alias("block"), F.lit(0).alias("side")))).otherwise(
            F.array(F.struct(F.col("low").alias("block"), F.lit(0).alias("side")),
                    F.struct(F.col("high").alias("block"), F.lit(1).alias("side"))))
        sent = pairs.select("grp", "low", "high", F.explode(ends).alias("end")).select(
            "grp", "low", "high", "end.block", "end.side").join(placed, ["grp", "block"]).checkpoint()
        if sent.isEmpty():
            continue
        links = sent.join(sets(sent), ["rep", *key]).groupBy("grp", "low", "high").applyInPandas(
            lambda pdf: _links(pdf, percent), "a long, b long").distinct().checkpoint()
        joined = connected_components(links)
        placed = placed.join(joined, F.col("comp") == F.col("v"), "left").select(
            "rep", *key, "grp", "block", F.coalesce("component", "comp").alias("comp")).coalesce(n_tasks).checkpoint()
    found = placed.select(F.col("rep").alias("v"), F.col("comp").alias("component"))
    whole = reps.join(found, F.col("rep") == F.col("v"), "left").select(
        *key, F.coalesce("component", "rep").alias("component_id"))
    unnamed = describe(docs.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text")).select(
        F.lit(None).cast("long").alias("doc_id"), "n", F.lit(None).cast("long").alias("component_id"))
    out = described.where("n > 0").join(whole, key).select("doc_id", "n", "component_id").unionByName(
        described.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))).unionByName(unnamed)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_superminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
