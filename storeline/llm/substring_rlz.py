"""Substring dedup on words by relative Lempel-Ziv parsing.

Each document's shared contexts are factored against reference blocks of the corpus: at each word the longest match
with what an earlier document holds in the block is taken as one factor, and parsing goes on behind it. The longest
matches come from a suffix order of the block (``longest_matches``). Windows of 50 words that lie in one
factor are duplicates; a window that a factor boundary cuts is looked up by itself, as it may occur in
the reference although the greedy factors cut it.

A reference block is a shard of ``repeats``: it holds the contexts (a window's surroundings, 84 words at most) around
shared anchors, of all documents, so that every block that a document has anything in common with is consulted, and
no other. Contexts that recur as a whole are found before, by their hashes (step 2 of ``repeats``).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from storeline.llm.repeats import HOT, WINDOW, find_repeats

BLOCK_BYTES = 4 << 20


def longest_matches(units: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each unit of the contexts: how long the longest match is that starts there and with a unit of a
    context of a smaller id, up to the end of either context.

    Suffixes are ordered by doubling. Of all suffixes of smaller ids, the next ones before and behind in this order
    match longest; how long is read off the orders of the lengths 64, 32, ... 1.
    """
    n = len(units) + len(sizes)
    # a separator of its own ends each context, so that no match goes on
    _, symbol = np.unique(units, return_inverse=True)
    inside = np.arange(len(units)) + np.repeat(np.arange(len(sizes)), sizes)
    text = np.empty(n, np.int64)
    text[inside] = symbol + len(sizes)
    text[starts + sizes + np.arange(len(sizes))] = np.arange(len(sizes))
    owner = np.full(n, np.iinfo(np.int64).max)
    owner[inside] = np.repeat(ids, sizes)
    ranks, span = [text], 1
    while span < 128:
        after = np.zeros(n, np.int64)
        after[:-span] = ranks[-1][span:] + 1
        _, rank = np.unique(ranks[-1] * (n + len(sizes) + 2) + after, return_inverse=True)
        ranks.append(rank)
        span *= 2
    order = np.argsort(ranks.pop(), kind="stable")  # by 128 units: longer than any context
    own = owner[order]
    best = np.zeros(n, np.int64)
    for step in (-1, 1):
        to = np.arange(n) + step
        to[to == n] = -1
        open_ = np.flatnonzero((to >= 0) & (own != np.iinfo(np.int64).max))
        open_ = open_[own[to[open_]] >= own[open_]]
        while len(open_):  # a neighbour of no smaller id has none in between either
            to[open_] = to[to[open_]]
            open_ = open_[to[open_] >= 0]
            open_ = open_[own[to[open_]] >= own[open_]]
        i = np.flatnonzero((to >= 0) & (own != np.iinfo(np.int64).max))
        x, y = order[i], order[to[i]]
        long = np.zeros(len(i), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            u, v = np.minimum(x + long, n - 1), np.minimum(y + long, n - 1)
            long += np.where((ranks[k][u] == ranks[k][v]) & (x + long < n) & (y + long < n), 1 << k, 0)
        best[order[i]] = np.maximum(best[order[i]], long)
    return best[inside]


def factor(units: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each window of 50 words of each context: does a context of a smaller id hold it?"""
    starts = np.cumsum(sizes) - sizes
    match = longest_matches(units, ids, starts, sizes)
    # greedy parse of all contexts side by side
    covered = np.zeros(len(units), bool)   # windows that start here lie in one factor
    cut = np.zeros(len(units), bool)       # or are cut by a boundary
    at, end = starts.copy(), starts + sizes
    while len(at):
        long = np.maximum(match[at], 1)
        whole = long >= WINDOW
        for first, last, mark in ((at[whole], (at + long - WINDOW + 1)[whole], covered),
                                  (np.where(whole, at + long - WINDOW + 1, at), at + long, cut)):
            m = last - first
            mark[np.repeat(first - (np.cumsum(m) - m), m) + np.arange(m.sum())] = True
        at = at + long
        at, end = at[at < end], end[at < end]
    n = sizes - WINDOW + 1
    window = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    return covered[window] | cut[window] & (match[window] >= WINDOW)


_WORD = re.compile(rb"[^ \t-\r]+")


def _finish(docs: pd.DataFrame, covered: np.ndarray, starts: np.ndarray, layout: bool = False) -> pd.DataFrame:
    kept, removed, spans = [], [], []
    for text, a, b in zip(docs["text"], starts[:-1], starts[1:]):
        c = covered[a:b]
        raw = (text or "").encode("utf-8", "surrogatepass")
        edge = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]]))).reshape(-1, 2)
        if not layout:
            words = raw.split()
            raw = b" ".join([w for w, x in zip(words, c) if not x] if len(edge) else words)
        elif len(edge):
            begin = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
            at = [0, *[begin[i] for i in edge.reshape(-1)], len(raw)]
            raw = b"".join(raw[i:j] for i, j in zip(at[::2], at[1::2]))
        spans.append([{"first": int(i), "end": int(j)} for i, j in edge])
        removed.append(int(c.sum()))
        kept.append(raw.decode("utf-8", "surrogatepass"))
    out = docs.drop(columns=["text", "blk"])
    return out.assign(n_words=np.diff(starts), n_removed=removed, spans=spans, kept=kept)


def remove_repeated_passages(docs: DataFrame, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES,
                             hot: int = HOT, layout: bool = False) -> DataFrame:
    """Removes the words of ``text`` in any window of 50 words that starts in an
    earlier document (smaller doc_id) too; windows are judged on the input.

    Words are ``[^\\x20\\x09-\\x0D]+``. Returns doc_id, the string columns ``keep``,
    n_words, n_removed, spans (removed runs of words: first, end) and kept: the
    other words joined by one space, or with ``layout`` the text as it is without the removed runs.
    One row per input row. A null text is empty; an empty table gives an empty result; a null doc_id
    counts as the smallest id; rows that repeat a doc_id don't remove from each other; other
    columns are ignored.
    """
    kept = "".join(f"{k} string, " for k in keep)

    def finish(pdf, covered, starts):
        return _finish(pdf, covered, starts, layout)

    return find_repeats(docs, "words", factor, finish, f"doc_id long, {kept}n_words long, n_removed long, "
                        "spans array<struct<first: long, end: long>>, kept string", block_bytes, keep, hot)


def op8_substring_rlz(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
