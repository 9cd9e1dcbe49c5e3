"""Toxic spans by a linear-chain conditional random field.

Two tags (other, toxic) over the letter runs of a text. Token labels come from the
document labels: document counts of every token and token prefix, gathered
over all training documents, give log odds; tokens of toxic documents with high odds are labelled toxic.
The lexicon holds every key whose odds are significant among all keys tested.
The field is fitted on a bounded sample of documents of each label by its likelihood. Forward-backward
marginals give the spans; their sum and maximum give, calibrated on the
sample's document labels, the document's score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from storeline.functions.sizing import bounded_broadcast
from storeline.llm import blocks as B
from storeline.llm.samples import fit_logistic, labelled, predict, sigmoid

SAMPLE_DOCS = 4000      # documents that the scores are calibrated on
FIELD_DOCS = 400        # documents that the field is fitted on, half of them of each label
BROADCAST_LABELS = 2_000_000
MIN_DOCS = 3
PRIOR = 5               # documents of the usual mix that every key is taken to have besides its own
PREFIXES = (4, 5, 6)
_EDGES = np.array([0.5, 1.5, 2.5, 3.5])
N_FEATURES = 1 + 4 * (len(PREFIXES) + 1) + 2
U = np.uint64

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def token_keys(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Tokens of all texts: first byte, end byte, text index, and keys: the whole token and
    its prefixes (0 where the token isn't longer)."""
    data, starts = B.joined_bytes(texts)
    data = B.lower_ascii(data)
    at, end, first = B.word_spans(data, starts, LETTER)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    keys = [B.span_hashes(data, at, end)]
    padded = np.concatenate([data, np.zeros(max(PREFIXES), np.uint8)])
    h = np.zeros(len(at), np.uint64)
    for i in range(max(PREFIXES)):
        h = h * B.BASE + B.BYTE[padded[at + i]]
        if i + 1 in PREFIXES:
            keys.append(np.where(end - at > i + 1, B.mix(h + U(i)), U(0)))
    return at - starts[text], end - starts[text], text, keys


def _counts(batches):
    """For each key its number of toxic and of clean documents."""
    for pdf in (p for batch in batches for p in B.pieces(batch, 1 << 21)):
        _, _, text, keys = token_keys(pdf["text"])
        key = np.concatenate(keys)
        pair = np.stack([key.astype(np.uint64), np.tile(text, len(keys)).astype(np.uint64)])
        order = np.lexsort(pair[::-1])
        k, d = pair[:, order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        new &= k != 0
        k, y = k[new], pdf["y"].to_numpy()[d[new].astype(np.int64)]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(k)))
        toxic = np.add.reduceat(y, at) if len(at) else at
        hit = toxic > 0  # keys of clean documents only have no positive odds
        yield pd.DataFrame({"key": k[at].view(np.int64)[hit], "toxic": toxic[hit].astype(np.int64),
                            "clean": np.zeros(hit.sum(), np.int64)})
        yield pd.DataFrame({"key": k[at].view(np.int64)[~hit | (n > toxic)], "toxic": 0,
                            "clean": (n - toxic)[~hit | (n > toxic)].astype(np.int64)})


def features(keys: list[np.ndarray], text: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Indicator features of each token: the strength of its own key and prefixes in the lexicon
    in four steps each, and whether the tokens before and after are in it."""
    known, odds = lexicon
    out = np.zeros((len(text), N_FEATURES), np.float32)
    out[:, 0] = 1
    any_hit = np.zeros(len(text), bool)
    for j, key in enumerate(keys):
        if not len(known):
            break
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = np.flatnonzero(known[place] == key)
        step = np.searchsorted(_EDGES, odds[place[hit]]) - 1
        hit, step = hit[step >= 0], step[step >= 0]
        out[hit, 1 + 4 * j + step] = 1
        any_hit[hit] = True
    if len(text) > 1:
        same = text[1:] == text[:-1]
        out[1:, -2] = any_hit[:-1] & same
        out[:-1, -1] = any_hit[1:] & same
    return out


def _scan(step: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Normalised row vectors after each of n steps ``v <- v @ step[i]`` (steps: (2, 2, n)),
    from (0.5, 0.5), and the sums before normalisation.

    Pieces of ``width`` steps are multiplied side by side, then linked one after
    another, then filled in: exact for any length.
    """
    n = step.shape[2]
    pieces = -(-n // width)
    m = np.zeros((2, 2, pieces * width))
    m[0, 0, n:] = m[1, 1, n:] = 1
    m[:, :, :n] = step
    m = np.ascontiguousarray(m.reshape(2, 2, pieces, width).transpose(3, 0, 1, 2))
    (a, b), (c, d) = m[0]
    for i in range(1, width):
        (e, f), (g, h) = m[i]
        a, b, c, d = a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h
        s = a + b + c + d
        a, b, c, d = a / s, b / s, c / s, d / s
    v0, v1 = np.empty(pieces), np.empty(pieces)
    x, y = 0.5, 0.5
    for i, (p, q, r, t) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        v0[i], v1[i] = x, y
        x, y = x * p + y * r, x * q + y * t
        x, y = x / (x + y), y / (x + y)
    out, total = np.empty((width, pieces, 2)), np.empty((width, pieces))
    for i in range(width):
        (e, f), (g, h) = m[i]
        v0, v1 = v0 * e + v1 * g, v0 * f + v1 * h
        s = v0 + v1
        v0, v1 = v0 / s, v1 / s
        out[i, :, 0], out[i, :, 1], total[i] = v0, v1, s
    return out.transpose(1, 0, 2).reshape(-1, 2)[:n], total.T.reshape(-1)[:n]


def marginals(emit: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag marginals of each token, and the sum over tokens of the pair marginals with the token
    before. ``emit`` (tokens, 2) and ``trans`` are log potentials; ``first`` marks the
    first token of each text."""
    if not len(emit):
        return np.zeros((0, 2)), np.zeros((2, 2))
    e = np.exp(emit - emit.max(1, keepdims=True))
    t = np.exp(trans)
    step = t[:, :, None] * e.T[None]
    step[:, :, first] = 0.5 * e[first].T[None]  # whatever came before: a fresh start
    alpha, _ = _scan(step)
    # beta of a token: t @ (e * beta) of the next; 1 at the last token of a text
    last = np.append(first[1:], True)
    step = np.empty_like(step)
    step[:, :, :-1] = t.T[:, :, None] * e[1:].T[:, None]
    step[:, :, last] = 0.5
    beta = _scan(step[:, :, ::-1])[0][::-1]
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    inner = np.flatnonzero(~first)
    pair = alpha[inner - 1][:, :, None] * t[None] * (e[inner] * beta[inner])[:, None, :]
    return post, (pair / pair.sum((1, 2), keepdims=True)).sum(0)


def fit_field(x: np.ndarray, tag: np.ndarray, first: np.ndarray, rounds: int = 40):
    """Weights of the tags (features, 2) and of the transitions, by gradient ascent with
    per-weight step sizes (Adagrad) on the penalised likelihood."""
    w, t = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    gold = np.eye(2)[tag]
    seen_w = x.T @ gold
    seen_t = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(seen_t, (tag[inner - 1], tag[inner]), 1)
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    n = max(len(x), 1)
    for _ in range(rounds):
        post, pair = marginals(x @ w, t, first)
        dw = (seen_w - x.T @ post) / n - 1e-6 * w
        dt = (seen_t - pair) / n - 1e-6 * t
        gw += dw * dw
        gt += dt * dt
        w += 0.5 * dw / np.sqrt(gw)
        t += 0.5 * dt / np.sqrt(gt)
    return w, t


def _firsts(text: np.ndarray) -> np.ndarray:
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    return first


def _document_features(post: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sum (log) and maximum of the toxic marginals, and their density, for each of n texts."""
    out = np.zeros((n, 3))
    size = np.bincount(text, minlength=n)
    total = np.bincount(text, weights=post, minlength=n)
    np.maximum.at(out[:, 1], text, post)
    out[:, 0] = np.log1p(total)
    out[:, 2] = np.sqrt(total / np.maximum(size, 1))
    return out


def sampled(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> pd.DataFrame:
    """text, y, field (at most FIELD_DOCS / 2 documents of each label) and calibrate (at most ``sample_docs``),
    all chosen by a hash of doc_id and in its order, whatever the table's order; of a repeated doc_id one text."""
    parts = [labelled(labels, "toxic", sample_docs, fold=0).withColumns({"field": F.lit(False), "calibrate": F.lit(True)})]
    parts += [labelled(labels, "toxic", FIELD_DOCS // 2, fold=0, only=y).withColumns(
        {"field": F.lit(True), "calibrate": F.lit(False)}) for y in (0, 1)]
    ids = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("doc_id", "y").agg(
        F.max("field").alias("field"), F.max("calibrate").alias("calibrate"))
    rows = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy(
        "doc_id", "y", "field", "calibrate").agg(F.min("text").alias("text"), F.xxhash64("doc_id").alias("place"))
    return rows.toPandas().sort_values(["place", "doc_id"], ignore_index=True).drop(columns=["doc_id", "place"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """The model: lexicon, field weights, calibration. ``labels``: doc_id, toxic.

    Token counts cover all labelled documents outside the held-out fold; the field and the
    calibration are fitted on ``sampled`` ones.
    """
    rows = labelled(labels, "toxic", None, fold=0)
    # texts stay where they are while the labels are few enough to be sent to them (16 bytes each)
    few, _ = bounded_broadcast(rows, BROADCAST_LABELS)
    train = docs.where("doc_id is not null").select("doc_id", "text").join(few, "doc_id")
    n = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    toxic, clean = n[1], n[0] - n[1]
    counts = (train.select("text", "y").mapInPandas(_counts, "key long, toxic long, clean long")
              .groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    share = (toxic + 1) / (toxic + clean + 2)
    odds = (F.log((F.col("toxic") + PRIOR * share) / (F.col("clean") + PRIOR * (1 - share)))
            - F.lit(float(np.log(share / (1 - share)))))
    tested = counts.where(F.col("toxic") >= MIN_DOCS).withColumn("n", F.col("toxic") + F.col("clean")).checkpoint()
    # likelihood ratio of the key's own share against the usual one, at one false key among all tested
    gain = 2 * (F.col("toxic") * F.log(F.col("toxic") / F.col("n") / share) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / F.col("n") / (1 - share))).otherwise(0.0))
    top = (tested.select("key", odds.alias("odds"), gain.alias("gain")).where("odds > 0.5")
           .where(F.col("gain") >= 2 * float(np.log(max(tested.count(), 1)))).select("key", "odds").toPandas())
    key = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    model = {"lexicon": (key[order], top["odds"].to_numpy(float)[order])}
    pdf = sampled(docs, labels, sample_docs)
    head = pdf[pdf["field"]].reset_index(drop=True)
    pdf = pdf[pdf["calibrate"]].reset_index(drop=True)
    _, _, text, keys = token_keys(head["text"])
    x = features(keys, text, model["lexicon"])
    strong = x[:, 1:N_FEATURES - 2].reshape(len(x), len(PREFIXES) + 1, 4)[:, :, 2:].any((1, 2))
    tag = (strong & (head["y"].to_numpy(np.int64)[text] == 1)).astype(np.int64)
    model["w"], model["t"] = fit_field(x.astype(float), tag, _firsts(text))
    parts = [part[["y"]].assign(x=list(_described(part, model)[0])) for part in B.pieces(pdf)]
    seen = np.array([v for part in parts for v in part["x"]]).reshape(-1, 3)
    y = np.array([v for part in parts for v in part["y"]], float)
    model["c"] = fit_logistic(seen, y, ridge=0.1)
    return model


def _described(part: pd.DataFrame, model: dict):
    """Document features, and of every token its first and end byte, text and marginal."""
    at, end, text, keys = token_keys(part["text"])
    post = marginals(features(keys, text, model["lexicon"]) @ model["w"], model["t"], _firsts(text))[0][:, 1]
    return _document_features(post, text, len(part)), at, end, text, post


def tag_documents(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, score (0 to 1) and spans (first, end byte and marginal of toxic tokens)
    of every whole text.

    A null or empty text has no tokens and gets the score of a text without any; rows stay as
    they are; other columns are left out; an empty table gives an empty result.
    """
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")

    def run(batches):
        for pdf in batches:
            for part in B.pieces(pdf):
                found, at, end, text, post = _described(part, model)
                score = sigmoid(predict(found, model["c"]))
                spans = [[] for _ in range(len(part))]
                for j in np.flatnonzero(post >= 0.5):
                    spans[text[j]].append({"first": int(at[j]), "end": int(end[j]), "marginal": float(post[j])})
                yield part.drop(columns="text").assign(score=score, spans=spans)

    return kept.mapInPandas(
        run, f"{schema}, score double, spans array<struct<first: long, end: long, marginal: double>>")


def op10_toxicity_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    id_fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return tag_documents(docs, model).select(
        "doc_id", (id_fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"))
