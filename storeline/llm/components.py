"""Connected components of a graph given as edges, for any number of vertices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from storeline.functions.sizing import in_few_tasks

EDGES_OF_TASK = 100_000
EDGES_TOGETHER = 1_000_000  # whose components one task finds: 16 bytes each, and some times that while it does


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges, and the smallest vertex that each reaches by them."""
    v, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = back[:len(a)], back[len(a):], np.arange(len(v))
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return v, v[label]


def _reached(batches) -> tuple[np.ndarray, np.ndarray]:
    """``_smallest`` of all edges of the batches; of the edges so far no more than a star for each component is held."""
    v = least = np.zeros(0, np.int64)
    new, n = [], 0
    for pdf in batches:
        new.append(pdf.to_numpy(np.int64))
        n += len(pdf)
        if n > max(EDGES_OF_TASK, len(v)):
            v, least = _smallest(*(np.concatenate([x, *(y[:, i] for y in new)]) for i, x in enumerate((v, least))))
            new, n = [], 0
    return _smallest(*(np.concatenate([x, *(y[:, i] for y in new)]) for i, x in enumerate((v, least))))


def _stars(batches):
    """Edges with the same components, fewer than a task has vertices: from each to the smallest it reaches."""
    v, least = _reached(batches)
    yield pd.DataFrame({"a": v[v != least], "b": least[v != least]})


def _labels(batches):
    v, least = _reached(batches)
    yield pd.DataFrame({"v": v, "component": least})


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reachable, for each vertex of ``edges`` (a, b: long).

    First each task replaces its edges by stars, as many as it has vertices at most. Where they are few by then
    (EDGES_TOGETHER), one task ends it: rounds would be some twenty jobs, whose plans and tasks the driver keeps
    records and code of. Stars of larger graphs go on in rounds.
    """
    stars = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(
        _stars, "a long, b long").checkpoint()
    if stars.count() > EDGES_TOGETHER:
        return _by_rounds(stars)
    return stars.coalesce(1).mapInPandas(_labels, "v long, component long").checkpoint()


def _by_rounds(edges: DataFrame) -> DataFrame:
    """``connected_components`` of any number of ``edges``, of different ends.

    Every round each vertex takes the smallest label among its own and its neighbours', then
    the label of that label, so that chains halve. Labels are checkpointed each round;
    only the number of changes reaches the driver. Rounds run in as many tasks as the edges fill: those of a
    small graph would else be nearly all empty, and the driver keeps a record of each.
    """
    both = edges.union(edges.select("b", "a")).distinct().checkpoint()
    both, n = in_few_tasks(both, EDGES_OF_TASK)
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("component")).coalesce(n).checkpoint()
    none = F.lit(None).cast("long")
    while True:
        told = both.join(labels, F.col("b") == F.col("v")).select(F.col("a").alias("v"), "component", none.alias("old")).coalesce(n)
        near = told.unionByName(labels.withColumn("old", F.col("component"))).groupBy("v").agg(
            F.min("component").alias("near"), F.max("old").alias("old")).coalesce(n)
        jump = labels.select(F.col("v").alias("near"), F.col("component").alias("far"))
        new = near.join(jump, "near", "left").select(
            "v", F.least("near", "far").alias("component"), "old").coalesce(n).checkpoint()
        if new.where("component <> old").isEmpty():
            return new.drop("old")
        labels = new.drop("old")
