"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has a codebook of its own, and
the product of both is a grid of cells. A vector visits cells in the order of a multi-sequence
traversal: by the sum of two bounds, each the squared distance from its half to the border of
a codeword's region. A link (cosine >= c) means a squared distance of at most 2 - 2c, so the traversal stops
when the sum exceeds that, and before, at the target recall: so many cells as hold RECALL of the partners at exactly the
threshold, measured on sampled vectors that are turned by its angle in random directions; closer partners lie in
nearer cells. Pairs met are verified by their cosine in double precision.

Equal vectors are one vertex with a count. The codebooks grow with the number of vectors. A cell's
residents are cut into blocks of a bounded size, and so are its visitors; a pair of blocks
returns link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from storeline.llm.components import connected_components

SAMPLE, CODEWORDS, BLOCK = 20000, 24, 512
RECALL, TURNED = 0.999, 2000  # target recall, and vectors that it is measured on
CELL = 128  # vectors for each cell of a grid that is larger than CODEWORDS squared


def codebook(x: np.ndarray, k: int = CODEWORDS, rounds: int = 12) -> np.ndarray:
    """Codewords by k-means from the first distinct rows."""
    c = np.unique(x[: 50 * k], axis=0)
    c = c[np.random.RandomState(1).permutation(len(c))[:k]].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        for i in range(len(c)):
            own = x[near == i]
            if len(own):
                c[i] = own.mean(0)
    return c


def border_bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and for every codeword the squared distance from the row to
    the border between the nearest's region and that one's (0 for the nearest)."""
    d = np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)
    near = d.argmin(1)
    gap = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 0))[near]
    bound = (d - d[np.arange(len(x)), near][:, None]) / np.maximum(2 * gap, 1e-12)
    bound[np.arange(len(x)), near] = 0
    return near, bound ** 2


def traverse(a: np.ndarray, b: np.ndarray, most: float, limit: int) -> np.ndarray:
    """The first ``limit`` cells (i * len(b) + j) in order of a[i] + b[j], up to ``most``: both sequences are
    sorted, a row of the grid ends where its sum gets too large, and of row p (from 0) no more than
    limit / (p + 1) cells can be among the first."""
    i, j = np.argsort(a, kind="stable")[:limit], np.argsort(b, kind="stable")
    i = i[a[i] <= most]
    ends = np.minimum(np.searchsorted(b[j], most - a[i], "right"), limit // np.arange(1, len(i) + 1))
    cells = np.concatenate([p * len(b) + j[:e] for p, e in zip(i, ends)])
    return cells[np.argsort(np.concatenate([a[p] + b[j[:e]] for p, e in zip(i, ends)]), kind="stable")[:limit]]


def reach(x: np.ndarray, c: tuple[np.ndarray, np.ndarray], cosine: float, recall: float) -> int:
    """How many cells a traversal must visit to meet ``recall`` of the partners at exactly ``cosine``: one partner
    of each row of ``x`` (unit vectors), in a random direction; the greater of both ends' places."""
    if x.shape[1] < 2 or not len(x):
        return len(c[0]) * len(c[1])
    u = np.random.RandomState(5).randn(*x.shape)
    u = _unit(u - (u * x).sum(1, keepdims=True) * x)
    y = cosine * x + np.sqrt(1 - cosine * cosine) * u
    cut = x.shape[1] // 2
    place = np.zeros(len(x), np.int64)
    for here, there in ((x, y), (y, x)):
        a, b = (border_bounds(h, k)[1] for h, k in zip((here[:, :cut], here[:, cut:]), c))
        i, j = (border_bounds(h, k)[0] for h, k in zip((there[:, :cut], there[:, cut:]), c))
        for r in range(len(x)):
            # cells that come no later than the partner's
            ends = np.searchsorted(np.sort(b[r]), a[r, i[r]] + b[r, j[r]] - a[r] + 1e-12, "right")
            place[r] = max(place[r], ends.sum())
    return int(np.quantile(place, recall, method="higher"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _visits(batches, books: dict, most: float, limits: dict):
    for pdf in batches:
        for dim, part in pdf.groupby("dim"):
            x = _unit(np.array(part["vec"].tolist(), float).reshape(len(part), dim))
            cut = dim // 2
            (i, a), (j, b) = (border_bounds(h, c) for h, c in zip((x[:, :cut], x[:, cut:]), books[dim]))
            own = i * b.shape[1] + j
            # both ends of a link visit each other's cell: the later cell is enough
            cells = [c[c >= o] for c, o in ((traverse(a[r], b[r], most, limits[dim]), own[r]) for r in range(len(x)))]
            yield part.assign(cell=own, visits=cells)


def _links(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of a block's residents with another block, or with each other when there is no other: (a: vertex,
    n: rows linked, b: smallest vertex of its part of both blocks)."""
    pdf = pdf.sort_values("rep", ignore_index=True)
    x = np.array(pdf["vec"].tolist(), float)
    norm = np.sqrt((x * x).sum(1))
    ids, rows, one = pdf["rep"].to_numpy(), pdf["m"].to_numpy(), pdf["resident"].to_numpy(bool)
    link = (x @ x.T) / (norm[:, None] * norm[None, :]) >= least
    same = pdf["block"].iloc[0] == pdf["met"].iloc[0]
    link &= ~np.eye(len(ids), dtype=bool) if same else one[:, None] != one[None, :]
    n = link @ rows
    label = np.arange(len(ids))
    p, q = np.nonzero(link)
    while len(p):
        low = label.copy()
        np.minimum.at(low, p, label[q])
        low = low[low]
        if (low == label).all():
            break
        label = low
    hit = np.flatnonzero(n)
    return pd.DataFrame({"a": ids[hit], "n": n[hit], "b": ids[label[hit]]})


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable) and
    kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their lengths are equal, and their cosine is
    at least ``cosine``. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing; nor do rows without a vec_id (component null, kept). Repeated rows link with each other as any
    equal vectors do. Other columns are ignored; an empty table gives an empty result.
    Codebooks are fitted on at most SAMPLE vectors (smallest hashes); every vector is indexed.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    sent = "array<float>" if element == "float" else "array<double>"  # what travels is no wider than the column
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)
            & (square > 0) & (square < float("inf")) & ~F.isnan(square))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    key = ["label", "vec"]
    vertex = rows.where("fine").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn(
        "dim", F.size("vec")).checkpoint()
    words = max(CODEWORDS, int(np.sqrt(vertex.count() / CELL)))
    sample = vertex.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("dim", "vec").toPandas()
    books, limits = {}, {}
    for dim in [r[0] for r in vertex.select("dim").distinct().collect()]:
        own = sample[sample["dim"] == dim]["vec"].tolist() or [[1.0] + [0.0] * (dim - 1)]
        x = _unit(np.array(own, float).reshape(-1, dim))
        books[dim] = codebook(x[:, :dim // 2], words), codebook(x[:, dim // 2:], words)
        limits[dim] = reach(x[:TURNED], books[dim], cosine, RECALL)
    schema = f"label {vectors.schema['label'].dataType.simpleString()}, vec array<double>, rep long, m long, dim int"
    seen = vertex.mapInPandas(lambda b: _visits(b, books, 2 - 2 * cosine + 1e-9, limits),
                              schema + ", cell long, visits array<long>").checkpoint()
    place = ["label", "dim", "cell"]
    visit = seen.select("label", "dim", F.col("vec").cast(sent).alias("vec"), "rep", "m", F.col("cell").alias("own"), F.explode("visits").alias("cell"))
    visit = visit.withColumn("lives", F.col("own") == F.col("cell"))
    lives, goes = F.col("lives"), ~F.col("lives")
    size = visit.groupBy(*place).agg(F.ceil(F.count_if(lives) / BLOCK).alias("blocks"),
                                     F.ceil(F.count_if(goes) / BLOCK).alias("guests"))
    # blocks by hash: a resident's block meets itself and the cell's other ones (the earlier of a pair counts
    # as the residents'), and each of the visitors' blocks, which are numbered behind them
    visit = visit.join(size.where("blocks > 0"), place).withColumn("home", F.when(
        lives, F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(
            F.col("blocks") + F.pmod(F.xxhash64("rep"), F.col("guests"))))
    visit = visit.withColumn("other", F.explode(F.when(
        lives, F.sequence(F.lit(0), F.col("blocks") + F.col("guests") - 1)).otherwise(
            F.sequence(F.lit(0), F.col("blocks") - 1))))
    visit = visit.withColumns({"block": F.least("home", "other"), "met": F.greatest("home", "other"),
                               "resident": F.col("home") <= F.col("other")})
    links = visit.select(*place, "block", "met", "rep", "m", "resident", "vec").groupBy(
        *place, "block", "met").applyInPandas(
        lambda pdf: _links(pdf, cosine), "a long, n long, b long").checkpoint()
    found = connected_components(links.select("a", "b"))
    count = links.groupBy("a").agg(F.sum("n").alias("n"))
    whole = (vertex.join(found, F.col("rep") == F.col("v"), "left").join(count, F.col("rep") == F.col("a"), "left")
             .select(*key, (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    out = rows.where("fine").join(whole, key).select("vec_id", "n_links", "component_id").unionByName(
        rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                      F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_multi_index(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
