"""The divergence audit against plain loops over exact integers, and against its SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from storeline.llm import divergence

SCHEMA = "text string, lang string, source string"
COLS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, min_docs=10, top=10):
    n, docs, groups = {}, {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        groups.setdefault(lang, set()).add(source)
        n.setdefault((lang, source), Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, m in docs[lang].items() if m >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update({t: n[lang, s][t] for t in kept})

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}
        q = shares(whole)
        p = {s: shares(n[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(items[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


def some_rows(k=400, sources=9):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Ünï", "ÉTÉ", "été", "日本", "𝛼x", "Ab"]
    out = []
    for _ in range(k):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["hot", "hot", None] + [f"s{i}" for i in range(sources)])
        pick = [rng.choice(words[:1 + int(len(words) * rng.random() ** 2)]) for _ in range(rng.randint(0, 40))]
        out.append((rng.choice([" ", "_", "3", "\n"]).join(pick) if rng.random() > .03 else None, lang, source))
    return out + [("only here", "xx", "a"), ("", "xx", "b"), (None, "yy", "a")]


@pytest.mark.parametrize("sources, terms", [(48, 4096), (2, 16)])
def test_equals_plain_loops(spark, sources, terms):
    rows = some_rows()
    tables = divergence.Audit(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = tables.pairs(sources, terms).withColumn("part", F.lit("pair")).select(*COLS).unionByName(
        tables.top_terms().withColumn("part", F.lit("term")).select(*COLS))
    assert rows_of(got) == brute(rows)


def test_extra_columns_and_ties(spark):
    # sources with the same texts tie with each other; repeated rows count as often as they occur
    rows = [("b a c a", "en", s) for s in ("x", "y", "z") for _ in range(4)] + [("c d", "en", "w")] * 10
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA + ", term string, n int")
    assert rows_of(divergence.audit(df)) == brute(rows)


def test_empty_table_and_no_kept_terms(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(df).count() == 0
    rows = [("rare", "en", "a"), ("words", "en", "b")]
    assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] == brute(rows)


def test_long_text_and_bounded_maps(spark, monkeypatch):
    rows = [("one two three " * 100_000, "en", "a")] + [("one four", "en", "b")] * 12
    assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    import pyarrow as pa
    monkeypatch.setattr(divergence, "ENTRIES", 2)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["a"] * 3, "text": ["x y z", "x", "y y"]})
    out = [r for b in divergence._count_terms(iter([batch])) for r in b.to_pylist()]
    sums = Counter()
    for r in out:
        sums[r["term"]] += r["n"]
    assert sums == {"x": 2, "y": 3, "z": 1} and len(out) == 5


def test_shares_are_exact_beyond_longs(spark):
    big = 9 * 10**15
    got = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big + 7), F.lit(11)).alias("p")).first().p
    assert got == 1 + 10**9 * (big + 2) // (3 * big + 7 + 22)


def test_sql_gives_the_same_rows(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = divergence.op11_source_divergence(spark, sf)
    res = con.execute(divergence.SQL)
    assert rows_of(got) == sorted(con.execute(f"SELECT {', '.join(COLS)} FROM ({divergence.SQL})").fetchall())
    assert sorted(c[0] for c in res.description) == sorted(got.columns)
