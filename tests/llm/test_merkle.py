"""The Merkle manifest against a tree built in memory, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from storeline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def climb(tree, at, digest):
    """Siblings along the path, and where ``digest`` in place of the node leads to."""
    proof = ""
    for level in tree[:-1]:
        run = level[at // 3 * 3:at // 3 * 3 + 3]
        i = at % 3
        proof += "".join(run[:i] + run[i + 1:])
        digest = H(*run[:i], digest, *run[i + 1:])
        at //= 3
    return proof, digest


def brute(rows):
    groups = {}
    for r in rows:
        late = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, late), r[0]))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in keys:
        groups[s].sort(key=lambda g: g[:3])
        trees[s] = levels([g[2] for g in groups[s]])
    top = levels([trees[s][-1][0] for s in keys])
    out = []
    for j, s in enumerate(keys):
        for i, g in enumerate(groups[s]):
            low, digest = climb(trees[s], i, g[3])
            high, folded = climb(top, j, digest)
            out.append((g[4], g[2], trees[s][-1][0], top[-1][0], H(low + high), folded, folded == top[-1][0]))
    return out


def check(spark, rows, tmp_path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute([r[:5] for r in rows]), key=key)
    return got


@pytest.mark.parametrize("span", [3, 9, 2187])
def test_manifest_equals_a_tree_in_memory(spark, tmp_path, monkeypatch, span):
    # small blocks take several levels of appended block roots
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda docs, tampered: whole(docs, tampered, span))
    rng = random.Random(3)
    rows = [(i * 7 - 50, rng.choice(["a\nb", "", None, "x" * 50, f"é{i}\n\n"]), rng.choice(["en", None]),
             rng.choice(["hot", "hot", "", None, "s1", "ünï", "z"]), rng.choice([None, i])) for i in range(180)]
    rows += [(9999, "alone", "en", "lone source", 5)]
    check(spark, rows, tmp_path)


def test_repeated_rows_null_ids_extra_columns(spark, tmp_path):
    rows = [(1, "t\n", "en", "a", 2, "x", 1)] * 5 + [(None, "n\n", None, "a", None, "y", 2)] * 3 + [
        (1, "other", "en", "a", 5, None, None), (2, None, None, None, None, "z", 0)]
    check(spark, rows, tmp_path, SCHEMA + ", node string, grp int")


def test_empty_table(spark, tmp_path):
    assert check(spark, [], tmp_path).count() == 0


def test_very_long_text(spark, tmp_path):
    check(spark, [(i, "long \n" * 200_000, "en", "a", None) for i in range(4)], tmp_path)


def test_a_witness_fits_no_other_text(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(40)], SCHEMA)
    rows = merkle.manifest(docs, F.concat(F.col("text"), F.when(F.col("doc_id") == 7, "!").otherwise("")))
    got = rows.select("doc_id", (merkle.fold(F.col("tampered_leaf"), F.col("witness")) == F.col("root")).alias("ok"))
    assert {r.doc_id for r in got.collect() if not r.ok} == {7}


def test_sql_gives_the_same_rows(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    res = con.execute(merkle.sql())
    names = [c[0] for c in res.description]
    got = merkle.op13_merkle_manifest(spark, sf)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(res.fetchall())
