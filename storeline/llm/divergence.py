"""Source divergence audit by count-cell ranking.

How far the terms of a source are from those of the other sources of its language, and from the language as a
whole. What a term adds depends on two counts only: its count in the source and its count on the
other side. So terms are grouped into cells of equal counts, a cell's value is computed once and
stands for all of its terms; cells are ranked by value, equal values are merged, and the
number of terms above a cell says which ranks it covers. Only cells that reach the report
are expanded into their terms, in UTF-8 order.

All arithmetic is on integers. Terms are counted where texts are read, in bounded maps, and summed by Spark.
Pairs of sources meet as blocks of some SOURCES sources, over buckets of some TERMS terms: a group
is a matrix of that size at most, however many sources share a term; terms with equal rows of the
matrix are one cell. What terms without any occurrence in two blocks add is one product.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from storeline.llm.ranks import stored

MIN_DOCS = 10
TOP = 10
SOURCES, TERMS = 48, 4096
ENTRIES = 200_000  # of a task's maps before they are passed on
UNIT = 1_000_000_000

#: letters A-Z become a-z; bytes of other characters stay; all else separates
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count_terms(batches):
    """Rows (lang, source, term, n, docs) of the texts of a task."""
    totals: dict[tuple, tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                 pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                 pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        totals.clear()

    size = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        texts = batch.column("text").cast(pa.large_binary())
        for i, key in enumerate(zip(langs, sources)):
            words = texts[i].as_py().translate(_FOLD).split()
            n, docs = totals.setdefault(key, (Counter(), Counter()))
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > ENTRIES:
                yield from rows()
                size = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it). Nulls are ''.

    Terms are runs of A-Z, a-z and characters beyond ASCII; only A-Z are lower-cased.
    """
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly, for any counts."""
    high = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    low = (total + 2 * terms).cast("decimal(19,0)")
    rest = high % low
    return F.lit(1).cast("long") + ((high - rest) / low).cast("decimal(38,0)").cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares."""
    top, low = (p - q) * (p - q), p + q
    return F.call_function("div", top, low)


class Audit:
    """The tables that both parts of the report are made from.

    postings: lang, source, term, n, lang_n of kept terms; groups: lang, source, total, terms, lang_total of
    every group that occurs; a language keeps the terms in at least ``min_docs`` of its documents.
    """

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        counts = stored(term_counts(docs), "term-counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(
            F.col("docs") >= min_docs).drop("docs")
        self.postings = stored(counts.drop("docs").join(kept, ["lang", "term"]), "postings")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
        totals = self.postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        self.groups = stored(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")]), "groups")

    def top_terms(self, top: int = TOP) -> DataFrame:
        """Each group's ``top`` terms that it uses more than its language does: lang, source, item, value, rank."""
        cells = self.postings.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("members"))
        p = share(F.col("n"), F.col("total"), F.col("terms"))
        q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
        cells = cells.join(self.groups, ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q").select(
            "lang", "source", "n", "lang_n", "members", gap(F.col("p"), F.col("q")).alias("value"))
        # one row for each value; those that can reach the report are among the first ``top``
        down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
        values = cells.groupBy("lang", "source", "value").agg(F.sum("members").alias("members"))
        values = values.withColumn("place", F.row_number().over(down)).where(F.col("place") <= top)
        above = F.coalesce(F.sum("members").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        values = values.withColumn("above", above).where(F.col("above") < top).select("lang", "source", "value", "above")
        chosen = cells.drop("members").join(values, ["lang", "source", "value"])
        terms = self.postings.join(chosen, ["lang", "source", "n", "lang_n"])
        order = Window.partitionBy("lang", "source", "value").orderBy("term")
        terms = terms.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
        rank = (F.col("above") + F.col("place")).cast("int")
        return terms.select("lang", "source", F.col("term").alias("item"), "value", rank.alias("rank")).where(
            F.col("rank") <= top)

    def pairs(self, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
        """Each group against each other source of its language, all ranks: lang, source, item, value, rank.

        ``sources``, ``terms``: about how many of each meet in one task's matrix.
        """
        by_lang = self.groups.groupBy("lang").agg(
            F.ceil(F.count(F.lit(1)) / sources).alias("blocks"), F.greatest(F.ceil(F.max("terms") / terms), F.lit(1)).alias("buckets"))
        block = F.pmod(F.xxhash64("source"), F.col("blocks"))
        members = self.groups.join(by_lang, "lang").withColumn("block", block)
        none = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
        packed = members.groupBy("lang", "block").agg(
            F.collect_list("source").alias("names"), F.collect_list(F.coalesce(none, F.lit(0))).alias("none"),
            F.max("buckets").alias("buckets"))
        a = packed.select("lang", F.col("block").alias("a"), F.col("names").alias("names_a"), F.col("none").alias("none_a"), "buckets")
        b = packed.select("lang", F.col("block").alias("b"), F.col("names").alias("names_b"), F.col("none").alias("none_b"))
        heads = a.join(b, "lang").where("a <= b").withColumn(
            "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
        rows = self.postings.join(members.select("lang", "source", "total", "terms", "block", "blocks", "buckets"),
                                  ["lang", "source"])
        rows = rows.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "block",
                           F.pmod(F.xxhash64("term", F.lit(1)), F.col("buckets")).alias("bucket"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        rows = rows.select("lang", "source", "term", "p", F.least("block", "other").alias("a"),
                           F.greatest("block", "other").alias("b"), "bucket")
        key = ["lang", "a", "b", "bucket"]
        partial = rows.groupBy(*key).cogroup(heads.drop("buckets").groupBy(*key)).applyInPandas(
            _sum_cells, "lang string, one string, two string, value long, seen long, none_one long, none_two long")
        sums = partial.groupBy("lang", "one", "two").agg(
            F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("none_one").alias("p"), F.max("none_two").alias("q"))
        langs = self.groups.groupBy("lang").agg(F.max("terms").alias("terms"))
        unseen = F.when(F.col("terms") > F.col("seen"), (F.col("terms") - F.col("seen")) * gap(
            F.greatest("p", F.lit(1)), F.greatest("q", F.lit(1)))).otherwise(0)
        sums = sums.join(langs, "lang").withColumn("value", F.col("value") + unseen)
        sums = sums.withColumn("way", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")),
                                                        F.struct(F.col("two").alias("source"), F.col("one").alias("item")))))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return sums.select("lang", "way.source", "way.item", "value").withColumn("rank", F.row_number().over(order))


def _sum_cells(rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
    """For each two sources of two blocks: the sum over the bucket's terms, one evaluation a cell."""
    columns = ["lang", "one", "two", "value", "seen", "none_one", "none_two"]
    if not len(heads):  # no source was dealt to the other block
        return pd.DataFrame(columns=columns)
    head = heads.iloc[0]
    same = head["a"] == head["b"]
    names, none = list(head["names_a"]), list(head["none_a"])
    first = len(names)
    if not same:
        names += list(head["names_b"])
        none += list(head["none_b"])
    at, terms = pd.factorize(rows["term"])
    shares = np.tile(np.array(none, np.int64), (len(terms), 1))
    place = {s: i for i, s in enumerate(names)}
    shares[at, [place[s] for s in rows["source"]]] = rows["p"].to_numpy()
    cells, members = np.unique(shares, axis=0, return_counts=True)
    out = []
    for i in range(first):
        others = slice(i + 1 if same else first, len(names))
        p, q = cells[:, i:i + 1], cells[:, others]
        value = (np.square(p - q) // (p + q) * members[:, None]).sum(axis=0) if len(cells) else np.zeros(q.shape[1], np.int64)
        out += [(names[i], t, int(v), none[i], m) for t, v, m in zip(names[others], value, none[others])]
    pdf = pd.DataFrame(out, columns=["one", "two", "value", "none_one", "none_two"])
    return pdf.assign(lang=head["lang"], seen=len(terms))[columns]


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank over ``docs`` (text, lang, source).

    Null text, lang and source are ''. Other columns are ignored, whatever their names. A repeated row
    counts as often as it occurs. A language without kept terms gives pairs of value 0 and no
    terms; a language with one source gives no pairs; an empty table gives no rows. Ties are ranked by
    item in UTF-8 order.
    """
    tables = Audit(docs)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return tables.pairs().withColumn("part", F.lit("pair")).select(*cols).unionByName(
        tables.top_terms().withColumn("part", F.lit("term")).select(*cols))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS m FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
l AS (SELECT lang, count(*) AS v, sum(m) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.m, count(w.rid) AS n
      FROM g JOIN k USING (lang) LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term
      GROUP BY ALL),
p AS (SELECT c.*, 1 + (1000000000::HUGEINT * (c.n + 2)) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 2 * l.v) AS p,
             1 + (1000000000::HUGEINT * (c.m + 2)) // (l.n + 2 * l.v) AS q
      FROM c JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS value
          FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
report AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
           SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM report QUALIFY part = 'pair' OR rank <= 10
"""
