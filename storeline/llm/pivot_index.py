"""Exact top-k inner products by a pivot-distance index.

Pivots are taken far apart from a bounded sample. Every vector is keyed by its nearest pivot
and its distance r to it; a pivot's vectors, sorted by r, are cut into annuli, one block each. For a query q
at distance d from the pivot, a vector v of an annulus [r0, r1] is no nearer to q than
gap = max(0, d - r1, r0 - d) by the triangle inequality, so

    q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2 <= (|q|^2 + max |v|^2 - gap^2) / 2,

and also q.v <= q.p + |q| r1. A query expands its annuli by falling bound, in rounds of growing size, and
stops when the next bound is below the k-th best score found. Every block that could hold a result is
visited, so the answer is exact whatever the pivots are; they only decide how much is visited. Vectors spread
evenly in many dimensions leave little to skip, and then nearly all blocks are visited.

Equal vectors are one entry with its k + 1 smallest ids, which is all a result can show. The visits of some
hundred queries to one block travel as one row. What all tasks know are the pivots and
40 bytes for each block (a block has 1,024 vectors, and from 67 million vectors on n / 65,536, up to 16,384).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from storeline.llm.ranks import stored

K = 5
SAMPLE = 2048            # vectors that pivots are chosen from
PIVOT_VECTORS, MAX_PIVOTS = 8192, 256
MIN_BLOCK, MAX_BLOCK, BLOCKS = 1024, 16384, 65536
PIECE = 512              # queries planned together
GROUP_PIECES = 16        # pieces that meet a block in one group
GROWTH = 8               # of the rounds
REAL, NO_ID, FREE = 0, 1, 2
_UNKNOWN = np.iinfo(np.int64).min


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component as a long, x as double; null where the vector takes no part."""
    x = embedding.cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(whole, F.transform(x, lambda v: F.floor(v * 256)))


def _matrix(vectors, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _packed(m: np.ndarray) -> bytes:
    small = m.size == 0 or np.abs(m).max() < 2**31 - 1
    return (b"\x04" if small else b"\x08") + (m.astype(np.int32) if small else m).tobytes()


def _unpacked(b: bytes, dim: int, rows: int) -> np.ndarray:
    if not rows * dim:
        return np.zeros((rows, dim), np.int64)
    return np.frombuffer(b, np.int32 if b[:1] == b"\x04" else np.int64, offset=1).reshape(rows, dim).astype(np.int64)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond a long they are cut to its range."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ v.T
    lim = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ v.T.astype(object), lim.min, lim.max).astype(np.int64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, pivots = x.astype(np.float64), pivots.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """n of the sample's vectors: the first, then always the one farthest from those chosen."""
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def bounds(q: np.ndarray, pivots: np.ndarray, of: np.ndarray, r0: np.ndarray, r1: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """No vector of block b has a larger inner product with query i than [i, b].

    ``of``, ``r0``, ``r1``, ``norm``: each block's pivot, least and greatest distance, greatest norm. The bounds allow
    for rounding.
    """
    d = _distances(q, pivots)[:, of]
    nq = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None]
    np_ = np.sqrt((pivots.astype(np.float64) ** 2).sum(1))[of]
    gap = np.maximum(np.maximum(d - r1, r0 - d), 0)
    by_triangle = (nq * nq + norm * norm - gap * gap) / 2
    by_pivot = (q.astype(np.float64) @ pivots.astype(np.float64).T)[:, of] + nq * r1
    return np.minimum(by_triangle, by_pivot) + 1e-6 * (nq + norm + np_) ** 2


def best_rows(scores: np.ndarray, ids: np.ndarray, state: np.ndarray, k: int) -> list[tuple[int, int, bool, int]]:
    """(score, id, id is null, vector) of the k best rows by score, then id, null ids last.

    Vectors come by smallest id, each with at most k ids.
    """
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        picked = np.concatenate([above, np.flatnonzero(scores == least)[:k]])
    else:
        picked = np.arange(len(scores))
    rows = [(-int(scores[v]), int(s), int(i), int(v)) for v in picked for i, s in zip(ids[v], state[v]) if s != FREE]
    return [(-a, i, s == NO_ID, v) for a, s, i, v in sorted(rows)[:k]]


class PivotIndex:
    """An index over (vec_id, vec) rows, with vec as ``quantised`` gives it and never null."""

    def __init__(self, rows: DataFrame, k: int = K, block: int | None = None, pivots: int | None = None):
        self.k, self.rows = k, rows
        keep = k + 1
        first = Window.partitionBy("vec").orderBy(F.asc_nulls_last("vec_id"))
        some = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= keep)
        vectors = stored(some.groupBy("vec").agg(
            F.sort_array(F.collect_list("vec_id")).alias("ids"),
            F.sum(F.col("vec_id").isNull().cast("int")).alias("no_ids")), "vectors")
        n, self.dim = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
        block = block or min(MAX_BLOCK, max(MIN_BLOCK, n // BLOCKS))
        sample = vectors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
        self.pivots = far_apart(_matrix([r.vec for r in sample], self.dim),
                                pivots or max(1, min(MAX_PIVOTS, n // PIVOT_VECTORS))) if sample else np.zeros((0, 0))
        self.blocks = self._build(vectors, n, block) if n else None
        self.n = n

    def _build(self, vectors: DataFrame, n: int, block: int) -> DataFrame:
        dim, pivots, keep = self.dim, self.pivots, self.k + 1

        def key(batches):
            for pdf in batches:
                x = _matrix(pdf["vec"], dim)
                d = _distances(x, pivots)
                near = d.argmin(1) if len(x) else np.zeros(0, int)
                yield pdf.assign(pivot=near.astype(np.int32), r=d[np.arange(len(x)), near])

        def cut(batches):
            place, held, size, i = TaskContext.get().partitionId(), [], 0, 0

            def pack(pdf):
                nonlocal i
                i += 1
                x = _matrix(pdf["vec"], dim)
                ids = np.zeros((len(pdf), keep), np.int64)
                state = np.full((len(pdf), keep), FREE, np.int8)
                for row, (a, m) in enumerate(zip(pdf["ids"], pdf["no_ids"])):
                    ids[row, :len(a)] = a
                    state[row, :len(a)] = REAL
                    state[row, len(a):len(a) + m] = NO_ID
                order = np.lexsort((ids[:, 0], state[:, 0]))
                r = pdf["r"].to_numpy()
                norm = np.sqrt((x.astype(np.float64) ** 2).sum(1)).max()
                return ((place << 32) + i, int(pdf["pivot"].iat[0]), r.min(), r.max(), norm, len(pdf), _packed(x[order]),
                        ids[order].tobytes(), state[order].tobytes())

            def out(rows):
                return pd.DataFrame(rows, columns=["blk", "pivot", "r0", "r1", "norm", "m", "vectors", "ids", "states"])

            for pdf in batches:
                start = 0
                pivot = pdf["pivot"].to_numpy()
                while start < len(pdf):
                    if held and held[0]["pivot"].iat[0] != pivot[start]:
                        yield out([pack(pd.concat(held))])
                        held, size = [], 0
                    end = min(len(pdf), start + block - size, start + int(np.argmax(np.r_[pivot[start:] != pivot[start], True])))
                    held.append(pdf.iloc[start:end])
                    size += end - start
                    start = end
                    if size == block:
                        yield out([pack(pd.concat(held))])
                        held, size = [], 0
            if held:
                yield out([pack(pd.concat(held))])

        keyed = vectors.mapInPandas(key, "vec array<long>, ids array<long>, no_ids long, pivot int, r double")
        parts = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // (32 * block)))
        return stored(keyed.withColumn("tie", F.xxhash64("vec")).repartitionByRange(parts, "pivot", "r", "tie").sortWithinPartitions(
            "pivot", "r", "tie").drop("tie").mapInPandas(
            cut, "blk long, pivot int, r0 double, r1 double, norm double, m int, vectors binary, ids binary, states binary"), "annuli")

    def _plan(self, queries: DataFrame, done: int, budget: int, groups: int) -> DataFrame:
        """The visits of one round: annuli ``done`` to ``done + budget`` of each query's order, while their
        bounds reach its k-th score (``least``)."""
        spark = queries.sparkSession
        pivots, dim = self.pivots, self.dim
        known = spark.sparkContext.broadcast(self.blocks.select("blk", "pivot", "r0", "r1", "norm").orderBy("blk").toPandas())

        def plan(batches):
            blocks = known.value
            of, r0, r1, norm = (blocks[c].to_numpy() for c in ("pivot", "r0", "r1", "norm"))
            step = max(16, min(PIECE, (1 << 22) // max(1, len(of))))
            place = 0
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at:at + step]
                    place += 1
                    q = _matrix(part["vec"], dim)
                    least = part["least"].fillna(_UNKNOWN).to_numpy(np.int64)
                    limit = bounds(q, pivots, of, r0, r1, norm)
                    order = np.argsort(-limit, axis=1, kind="stable")[:, done:done + budget]
                    live = np.zeros(limit.shape, bool)
                    np.put_along_axis(live, order, True, axis=1)
                    live &= limit >= least[:, None]
                    group = (TaskContext.get().partitionId() * 31 + place) % groups
                    rows = [(int(blocks["blk"].iat[b]), group, int(sel.sum()), part["qkey"].to_numpy(np.int64)[sel].tobytes(),
                             least[sel].tobytes(), _packed(q[sel]))
                            for b in np.flatnonzero(live.any(0)) for sel in [live[:, b]]]
                    yield pd.DataFrame(rows, columns=["blk", "grp", "m", "keys", "least", "queries"])

        return queries.mapInPandas(plan, "blk long, grp int, m int, keys binary, least binary, queries binary")

    def _visit(self, visits: DataFrame) -> DataFrame:
        """The best rows of each visit: qkey, score, vec_id, same (the vector equals the query's)."""
        dim, keep = self.dim, self.k + 1

        def visit(blocks, visits):
            out = []
            if len(blocks):
                b = blocks.iloc[0]
                v = _unpacked(b["vectors"], dim, b["m"])
                ids = np.frombuffer(b["ids"], np.int64).reshape(-1, keep)
                states = np.frombuffer(b["states"], np.int8).reshape(-1, keep)
                for m, keys, least, queries in zip(visits["m"], visits["keys"], visits["least"], visits["queries"]):
                    q = _unpacked(queries, dim, m)
                    scores = products(q, v)
                    least, keys = np.frombuffer(least, np.int64), np.frombuffer(keys, np.int64)
                    for i in np.flatnonzero(scores.max(1) >= least):
                        out += [(keys[i], s, None if null else vid, bool((v[j] == q[i]).all()))
                                for s, vid, null, j in best_rows(scores[i], ids, states, keep) if s >= least[i]]
            pdf = pd.DataFrame(out, columns=["qkey", "score", "vec_id", "same"])
            return pdf.astype({"qkey": "int64", "score": "int64", "vec_id": "Int64", "same": "bool"})

        key = ["blk", "grp"]
        wanted = visits.select("blk", F.col("grp").alias("g")).distinct()
        met = self.blocks.select("blk", "m", "vectors", "ids", "states").join(wanted, "blk").select(
            F.col("blk").alias("blk"), F.col("g").alias("grp"), "m", "vectors", "ids", "states")
        return met.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(
            visit, "qkey long, score long, vec_id long, same boolean")

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score: the k best rows for each row of ``queries`` (vec_id, vec), which
        are rows of the index; a row is no candidate for itself."""
        spark = queries.sparkSession
        empty = "query_id long, rank int, vec_id long, score long"
        if not self.n:
            return spark.createDataFrame([], empty)
        keyed = stored(queries.select("vec").distinct().withColumn("qkey", F.monotonically_increasing_id()), "queries")
        n_queries = keyed.count()
        pieces = -(-n_queries // PIECE)
        groups = max(1, -(-pieces // GROUP_PIECES))
        n_blocks = self.blocks.count()
        best = spark.createDataFrame([], "qkey long, score long, vec_id long, same boolean, place int")
        by_score = Window.partitionBy("qkey").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.desc("same"))
        done, budget = 0, 1
        while done < n_blocks:
            least = best.where(F.col("place") == self.k + 1).select("qkey", F.col("score").alias("least"))
            visits = stored(self._plan(keyed.join(least, "qkey", "left"), done, budget, groups), "visits")
            if visits.isEmpty():
                break
            hits = self._visit(visits).unionByName(best.drop("place"))
            best = stored(hits.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= self.k + 1), "best")
            done, budget = done + budget, budget * GROWTH
        found = best.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id", "same"))).alias("found"))
        asked = queries.select(F.col("vec_id").alias("query_id"), "vec").join(keyed, "vec").join(found, "qkey")
        own = F.array_min(F.transform(F.filter("found", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))),
                                      lambda x: x["place"]))
        others = F.slice(F.filter("found", lambda x: ~x["place"].eqNullSafe(F.col("own"))), 1, self.k)
        return asked.withColumn("own", own).select("query_id", F.posexplode(others).alias("at", "hit")).select(
            "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def top_products(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """The ``k`` rows with the highest integer inner products for each row of ``vectors`` (vec_id, embedding) whose
    vec_id is divisible by ``every``: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part. Vectors of different lengths
    are compared as if the shorter ended in zeros. A row is no candidate for itself, but a repeated row is
    one for its copies, and is answered as often as it occurs. Rows without an id are candidates
    (after those with one on ties) and no queries. Other columns are ignored, whatever their names. An
    empty table gives no rows; fewer candidates than ``k`` give all of them. Scores beyond a long are cut to its range.
    """
    rows = stored(vectors.select("vec_id", quantised(F.col("embedding")).alias("vec")).where(F.col("vec").isNotNull()), "rows")
    return PivotIndex(rows, k).search(rows.where(F.col("vec_id") % every == 0))


def op12_pivot_top_k(spark, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON b.rid <> a.rid WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
