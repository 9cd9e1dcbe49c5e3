"""Merkle manifest of a dataset, with a witness for every row, by incremental witnesses.

A row's leaf is the SHA-256 of its values, each written as its length and itself. The leaves of
a source, by ascending doc_id, are the bottom of a tree in which every ARITY consecutive
nodes are hashed into one, level by level, until one remains: the subroot. The subroots, by source, are
the leaves of one more tree, whose root stands for the whole table. A witness holds,
level by level, the digests left and right of the row's own, so that one row can be checked against the root
without the others.

Witnesses grow while leaves are appended: an arriving node takes the digests of its elder siblings as a
partial witness for all leaves under it, and hands its own digest to theirs; a full run becomes a node of
the next level. Appending works on aligned blocks of SPAN nodes, one at a time in a task, whole
sources of less included; the roots of the blocks are appended to the levels above in the
same way. So a source that holds a third of the rows is spread over as many tasks as it has blocks, and
texts stay where they are read: only digests are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from storeline.llm.ranks import ranked, stored

ARITY = 3
SPAN = ARITY ** 7


def _value(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of one row, in hex."""
    return F.sha2(F.concat(*[_value(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Appender:
    """A tree of ``height`` levels that takes nodes from left to right and keeps their witnesses.

    ``witness[i]`` has, for each level, the digests before and after the i-th node's ancestor: ``before.after/``.
    """

    def __init__(self, height: int):
        self.height = height
        self.open = [[] for _ in range(height)]  # for each level: (digest, first leaf, end leaf)
        self.witness: list[str] = []
        self.root: str | None = None

    def append(self, digest: str) -> None:
        self.witness.append("")
        self._place(0, digest, len(self.witness) - 1, len(self.witness))

    def _extend(self, first: int, end: int, more: str) -> None:
        for i in range(first, end):
            self.witness[i] += more

    def _place(self, level: int, digest: str, first: int, end: int) -> None:
        if level == self.height:
            self.root = digest
            return
        run = self.open[level]
        self._extend(first, end, "".join(d for d, _, _ in run) + ".")
        if run:
            self._extend(run[0][1], first, digest)
        run.append((digest, first, end))
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        first, end = run[0][1], run[-1][2]
        self._extend(first, end, "/")
        self._place(level + 1, _digest([d for d, _, _ in run]), first, end)

    def finish(self) -> None:
        """Close the runs that are still open, shorter ones included, from the lowest level up."""
        for level in range(self.height):
            if self.open[level]:
                self._close(level)


def _height(n: int, span: int) -> int:
    """Levels above a block of a group of n nodes: up to its root, or to the root of a whole block."""
    h = 0
    while ARITY ** h < min(n, span):
        h += 1
    return h


def _append_blocks(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """Witnesses within each block, and its root; rows come sorted by block and position."""
    block, tree, held = None, None, []

    def done():
        tree.finish()
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        return rows.assign(witness=tree.witness, root=tree.root)

    for pdf in batches:
        pdf = pdf.reset_index(drop=True)
        if not len(pdf):
            continue
        new = (pdf["grp"] != pdf["grp"].shift()) | (pdf["blk"] != pdf["blk"].shift())
        edges = [*new[new].index, len(pdf)]
        for a, b in zip(edges[:-1], edges[1:]):
            rows = pdf.iloc[a:b]
            key = (rows["grp"].iat[0], rows["blk"].iat[0])
            if key != block:
                if tree is not None:
                    yield done()
                block, tree, held = key, Appender(_height(int(rows["n"].iat[0]), span)), []
            for d in rows["node"]:
                tree.append(d)
            held.append(rows)
    if tree is not None:
        yield done()


def _blocks(nodes: DataFrame, span: int) -> DataFrame:
    """``nodes`` (grp, pos, n, node and whatever else they carry as strings) plus blk, witness and root of the block."""
    cut = nodes.withColumn("blk", F.floor(F.col("pos") / span))
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    return stored(cut.repartition("grp", "blk").sortWithinPartitions("grp", "blk", "pos").mapInPandas(
        lambda batches: _append_blocks(batches, span), f"{schema}, witness string, root string"), "merkle")


def _parents(low: DataFrame, span: int) -> DataFrame:
    return low.groupBy("grp", "blk").agg(F.min("root").alias("node"), F.max("n").alias("n")).select(
        "grp", F.col("blk").alias("pos"), F.ceil(F.col("n") / span).alias("n"), "node")


def _witnesses(nodes: DataFrame, span: int) -> DataFrame:
    """grp, pos, witness up to the root of the group, root."""
    low = _blocks(nodes, span)
    if (low.agg(F.max("n")).first()[0] or 0) <= span:
        return low.select("grp", "pos", "witness", "root")
    high = _witnesses(_parents(low, span), span).select("grp", F.col("pos").alias("blk"), F.col("witness").alias("more"),
                                            F.col("root").alias("top"))
    return low.join(high, ["grp", "blk"]).select("grp", "pos", F.concat("witness", "more").alias("witness"),
                                                 F.col("top").alias("root"))


def fold(start: Column, witness: Column) -> Column:
    """The root that ``start`` leads to, with the digests of ``witness`` beside it."""
    steps = F.filter(F.split(witness, "/"), lambda s: s != "")
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(
        F.substring_index(s, ".", 1), acc, F.substring_index(s, ".", -1)), 256))


def manifest(docs: DataFrame, tampered: Column, span: int = SPAN) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, leaf, subroot, root, witness, tampered_leaf.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are ignored, whatever their names.
    ``tampered`` is the text of the row as found later; tampered_leaf is its leaf, with all else unchanged.
    Null values are values of their own ('-'); null doc_ids come first, null sources form a source that
    comes first; rows with equal doc_ids are ordered by their leaves, and repeated rows follow each
    other. An empty table gives no rows.
    ``span``: nodes of a block, a power of ARITY.
    """
    d = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    # a null source sorts first, and its key cannot equal another's
    grp = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    leaves = stored(docs.select("doc_id", grp.alias("grp"), leaf(*d, F.col("text")).alias("node"),
                                F.when(F.col("text") != tampered, leaf(*d, tampered)).alias("tampered_leaf")), "leaves")
    # ids travel as text: a null must not turn the others into floating point numbers
    low = _blocks(ranked(leaves, "grp", ["doc_id", "node"]).withColumn("doc_id", F.col("doc_id").cast("string")), span)
    sources = _witnesses(_parents(low, span), span).select("grp", F.col("pos").alias("blk"), F.col("witness").alias("more"),
                                               F.col("root").alias("subroot"))
    sources = stored(sources, "subroots")
    tops = ranked(sources.where("blk = 0").select(F.lit("").alias("grp"), F.col("grp").alias("key"),
                                                  F.col("subroot").alias("node")), "grp", ["key"])
    top = _witnesses(tops, span).join(tops.select("pos", "key"), "pos").select(
        F.col("key").alias("grp"), F.col("witness").alias("last"), F.col("root").alias("top"))
    high = sources.join(top, "grp").select("grp", "blk", "subroot", F.concat("more", "last").alias("more"), "top")
    return low.join(high, ["grp", "blk"]).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1)).alias("source"), F.col("node").alias("leaf"),
        "subroot", F.col("top").alias("root"), F.concat("witness", "more").alias("witness"),
        F.coalesce("tampered_leaf", "node").alias("tampered_leaf"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; where 2 divides the CRC-32 of the decimal doc_id, the line breaks
    are gone from the text that is checked against it. A null doc_id is never tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = manifest(docs, F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    return rows.select("doc_id", "leaf", "subroot", "root",
                       F.sha2(F.translate("witness", "./", ""), 256).alias("proof_sha256"),
                       fold(F.col("tampered_leaf"), F.col("witness")).alias("folded_root")).withColumn(
                           "verified", F.col("folded_root") == F.col("root"))


#: DuckDB has no CRC-32: a bit at a time over the decimal digits.
CRC_SQL = ("(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform("
           "string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), "
           "lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), "
           "lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))))")

#: The same tree level by level: a recursion over levels builds it, another folds each row's path. All
#: levels are kept in one relation, so this suits small tables.
SQL = """
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
        CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS later
      FROM documents),
l AS (SELECT rid, doc_id, source, sha256({leaf}) AS leaf, sha256({late}) AS late FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos,
             count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT 0 AS level, source, pos, n, leaf AS digest FROM p
      UNION ALL
      SELECT level + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM t
      WHERE n > 1 GROUP BY level, source, pos // 3, n),
s AS (SELECT source, digest, level AS height,
             row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
             count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, digest FROM s
      UNION ALL
      SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM u
      WHERE n > 1 GROUP BY level, pos // 3, n),
-- the runs of both trees under one numbering of levels, those of the upper tree after the source's
runs AS (SELECT source, level, pos // 3 AS run, list(digest ORDER BY pos) AS members FROM t WHERE n > 1
         GROUP BY source, level, pos // 3),
top_runs AS (SELECT level, pos // 3 AS run, list(digest ORDER BY pos) AS members FROM u WHERE n > 1
             GROUP BY level, pos // 3),
f AS (SELECT p.rid, p.source, 0 AS level, p.pos, p.late AS digest, '' AS proof FROM p
      UNION ALL
      SELECT f.rid, f.source, f.level + 1, f.pos // 3,
             sha256(array_to_string(r.members[:f.pos % 3], '') || f.digest || array_to_string(r.members[f.pos % 3 + 2:], '')),
             f.proof || array_to_string(r.members[:f.pos % 3], '') || array_to_string(r.members[f.pos % 3 + 2:], '')
      FROM f JOIN runs r ON r.source IS NOT DISTINCT FROM f.source AND r.level = f.level AND r.run = f.pos // 3),
g AS (SELECT f.rid, 0 AS level, s.pos, f.digest, f.proof
      FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source AND s.height = f.level
      UNION ALL
      SELECT g.rid, g.level + 1, g.pos // 3,
             sha256(array_to_string(r.members[:g.pos % 3], '') || g.digest || array_to_string(r.members[g.pos % 3 + 2:], '')),
             g.proof || array_to_string(r.members[:g.pos % 3], '') || array_to_string(r.members[g.pos % 3 + 2:], '')
      FROM g JOIN top_runs r ON r.level = g.level AND r.run = g.pos // 3)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root.digest AS root, sha256(g.proof) AS proof_sha256,
       g.digest AS folded_root, g.digest = root.digest AS verified
FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source
JOIN (SELECT level, digest FROM u WHERE n = 1) root ON true
JOIN g ON g.rid = p.rid AND g.level = root.level
"""


def sql() -> str:
    """DuckDB SQL for the query's rows."""
    def value(c):
        v = f"CAST({c} AS VARCHAR)"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"

    def whole(text):
        return " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text))

    return SQL.format(crc=CRC_SQL, leaf=whole("text"), late=whole("later"))
