"""Quality classifier by co-training.

Two views of a document: its text (byte pair histogram and shape statistics)
and its metadata (source, language, length, line layout). A classifier of each view is fitted
on labelled documents; in each round both score all unlabelled documents and
each hands the most confident of those that the other was not yet given, with its own verdict as label, to the other.
The views' log odds are calibrated and combined on labelled
documents that neither was fitted on. All documents are scored.

The views of all documents are computed once and kept as half-precision numbers (some 600 bytes a document);
a round scores these. The driver gets at most LABELLED + 4 * EXCHANGED * ROUNDS of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from storeline.llm import blocks as B
from storeline.llm.ranks import stored
from storeline.llm.samples import fit_logistic, labelled, predict, sigmoid

LABELLED = 5000   # labelled documents fitted on, at most
ROUNDS, EXCHANGED, SURE = 4, 250, 0.95
PAIRS = 256
N_TEXT, N_META = PAIRS + 9, 4
MOST_SOURCES, MOST_LANGS = 256, 64  # bins that their names are hashed to, at most


def text_view(texts) -> np.ndarray:
    """Text features of each text: relative byte pair counts (square roots) and shape statistics."""
    data, starts = B.joined_bytes(texts)
    n, size = len(starts) - 1, np.diff(starts)
    out = np.zeros((n, N_TEXT))
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), size)
    pair = (data[:-1].astype(np.int64) * 31 + data[1:] * 17) % PAIRS
    inner = doc[1:] == doc[:-1]
    hist = np.bincount(doc[:-1][inner] * PAIRS + pair[inner], minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, :PAIRS] = np.sqrt(hist / np.maximum(size, 1)[:, None])
    upper = (data >= 65) & (data <= 90)
    lower = ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    mark = ~(upper | lower | digit | B.SPACE[data])
    for i, x in enumerate((upper, lower, digit, mark)):
        out[:, PAIRS + i] = np.bincount(doc, weights=x, minlength=n) / np.maximum(size, 1)
    at, end, first = B.word_spans(data, starts)
    words, own = np.diff(first), np.repeat(np.arange(n), np.diff(first))
    out[:, PAIRS + 4] = np.log1p(words) / 10
    out[:, PAIRS + 5] = np.bincount(own, weights=end - at, minlength=n) / np.maximum(words, 1) / 10
    h = B.span_hashes(data, at, end)
    order = np.lexsort((h, own))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
    distinct = np.bincount(own[order], weights=new, minlength=n)
    out[:, PAIRS + 6] = distinct / np.maximum(words, 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    out[:, PAIRS + 7] = np.bincount(own, weights=again, minlength=n) / np.maximum(words, 1)
    out[:, PAIRS + 8] = np.log1p(distinct) / 10
    return out


def metadata_view(frame: pd.DataFrame, bins: tuple[int, int]) -> np.ndarray:
    """Metadata features: hashed source and language, log length, lines and line length."""
    out = np.zeros((len(frame), sum(bins) + N_META))
    row = np.arange(len(frame))
    out[row, frame["source_bin"].to_numpy(int)] = 1
    out[row, bins[0] + frame["lang_bin"].to_numpy(int)] = 1
    chars, lines = frame["chars"].to_numpy(float), frame["lines"].to_numpy(float)
    out[:, -4] = np.log1p(chars) / 10
    out[:, -3] = np.log1p(lines) / 10
    out[:, -2] = np.log1p(chars / np.maximum(lines, 1)) / 10
    out[:, -1] = chars < 200
    return out


def _bins(docs: DataFrame) -> tuple[int, int]:
    """Bins for sources and languages: twice as many as there are names."""
    n = docs.agg(F.approx_count_distinct("source"), F.approx_count_distinct("lang")).first()
    return min(MOST_SOURCES, 2 * n[0] + 2), min(MOST_LANGS, 2 * n[1] + 2)


def _views(docs: DataFrame, bins: tuple[int, int], *more: str) -> DataFrame:
    def binned(column, n):
        return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n)).cast("int")

    text = F.coalesce("text", F.lit(""))
    return docs.select(*more, text.alias("text"), binned("source", bins[0]).alias("source_bin"),
                       binned("lang", bins[1]).alias("lang_bin"), F.char_length(text).alias("chars"),
                       (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1).alias("lines"))


def _features(docs: DataFrame, bins: tuple[int, int]) -> DataFrame:
    """doc_id and both views as one row of half-precision numbers; of a repeated doc_id the least row."""
    def run(batches):
        for pdf in batches:
            for part in B.pieces(pdf):
                x = np.hstack([text_view(part["text"]), metadata_view(part, bins)]).astype(np.float16)
                yield pd.DataFrame({"doc_id": part["doc_id"], "x": [r.tobytes() for r in x]})

    known = docs.where("doc_id is not null").select("doc_id", "text", "source", "lang")
    return _views(known, bins, "doc_id").mapInPandas(run, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x"))


def _matrices(x, bins: tuple[int, int]) -> list[np.ndarray]:
    whole = np.frombuffer(b"".join(x), np.float16).reshape(-1, N_TEXT + sum(bins) + N_META).astype(float)
    return [whole[:, :N_TEXT], whole[:, N_TEXT:]]


def _taught(unlabelled: DataFrame, weights: list, given: list[set], bins: tuple[int, int]) -> list[tuple[dict, pd.DataFrame]]:
    """For each view, the documents that the other one hands to it: {doc_id: verdict}, and their features."""
    def run(batches):
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            out = {"doc_id": ids}
            for v, x in enumerate(_matrices(pdf["x"], bins)):
                p = sigmoid(predict(x, weights[v]))
                # what the other view has been given is not offered again
                out[f"p{v}"] = np.where([i in given[1 - v] for i in ids], 0.5, p) if len(ids) else p
            yield pd.DataFrame(out)

    scored = unlabelled.mapInPandas(run, "doc_id long, p0 double, p1 double").checkpoint()
    out = []
    for v in (0, 1):
        p = F.col(f"p{1 - v}")
        best = [scored.where(p >= SURE).orderBy(p.desc(), "doc_id"), scored.where(p <= 1 - SURE).orderBy(p, "doc_id")]
        verdicts = {r.doc_id: y for y, rows in zip((1, 0), best) for r in rows.select("doc_id").limit(EXCHANGED).collect()}
        ids = unlabelled.sparkSession.createDataFrame([(i,) for i in verdicts], "doc_id long")
        out.append((verdicts, unlabelled.join(F.broadcast(ids), "doc_id").toPandas().sort_values("doc_id")))
    return out


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> dict:
    """Weights of both views after co-training and of their combination; ``fitted``: rows that each was fitted on,
    by round.

    Fitted on at most LABELLED labelled documents (a quarter of them for calibration only), chosen by a hash of
    doc_id, and on what the views hand to each other of all unlabelled ones.
    """
    bins = _bins(docs)
    named = labels.where("doc_id is not null").groupBy("doc_id").agg(F.lit(True).alias("named"))
    features = stored(_features(docs, bins).join(named, "doc_id", "left"), "views")
    rows = features.join(F.broadcast(labelled(labels, "quality", LABELLED)), "doc_id").toPandas().sort_values("doc_id")
    unlabelled = features.where("named is null").drop("named")
    views, y = _matrices(rows["x"], bins), rows["y"].to_numpy(float)
    held = np.arange(len(y)) % 4 == 3
    use = [[x[~held], y[~held]] for x in views]
    given: list[set] = [set(), set()]
    weights, fitted = [None, None], []
    for r in range(rounds + 1):
        weights = [fit_logistic(*use[v]) for v in (0, 1)]
        fitted.append([len(use[v][1]) for v in (0, 1)])
        if r == rounds:
            break
        taught = _taught(unlabelled, weights, given, bins)
        if not any(verdicts for verdicts, _ in taught):
            break
        for v, (verdicts, more) in enumerate(taught):
            given[v] |= set(verdicts)
            use[v][0] = np.vstack([use[v][0], _matrices(more["x"], bins)[v]])
            use[v][1] = np.append(use[v][1], [verdicts[i] for i in more["doc_id"]])
    both = np.stack([predict(views[v][held], weights[v]) for v in (0, 1)], 1)
    return {"views": weights, "both": fit_logistic(both, y[held], ridge=0.1), "bins": bins, "fitted": fitted}


def score_documents(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, text_score, meta_score and score (each 0 to 1: quality) of every whole text.

    Needs text, source and lang. Null texts, sources and languages count as empty; rows stay
    as they are; other columns are left out; an empty table gives an empty result.
    """
    inner = [f"keep_{i}" for i in range(len(keep))]
    frame = docs.select("text", "source", "lang", *[F.col(k).alias(i) for i, k in zip(inner, keep)])
    schema = ", ".join(f"{i} {docs.schema[k].dataType.simpleString()}" for i, k in zip(inner, keep))

    def run(batches):
        for pdf in batches:
            for part in B.pieces(pdf):
                odds = np.stack([predict(text_view(part["text"]), model["views"][0]),
                                 predict(metadata_view(part, model["bins"]), model["views"][1])], 1)
                yield part[inner].assign(text_score=sigmoid(odds[:, 0]), meta_score=sigmoid(odds[:, 1]),
                                         score=sigmoid(predict(odds, model["both"])))

    out = _views(frame, model["bins"], *inner).mapInPandas(run, f"{schema}, text_score double, meta_score double, score double")
    return out.withColumnsRenamed(dict(zip(inner, keep)))


def op4_cotraining(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).withColumn("kept", F.col("score") >= 0.5)
