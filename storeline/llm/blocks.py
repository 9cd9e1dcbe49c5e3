"""Blocks of documents and the exchange of keys between them.

Several operators need to know, for the millions of keys (words, anchors,
contexts) that occur in a block of documents, something that only the whole
corpus can tell: in how many documents the key occurs, or its total count. A row per
key would be mostly row overhead, so a block sends one packed array of sorted
distinct keys to each key range (``bucket``), the bucket combines what all
blocks sent, and answers with an array in the same order. A key that a third
of all documents hold costs one entry per block, never one per document, so
no bucket grows with a hot key.

All blocks come from one shuffle of the texts; the passes of an operator are
branches of one plan and read that shuffle again (``ReusedExchange``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.RandomState(20240517)
# random symbols of the 256 bytes and odd multipliers for the hashes below
BYTE = _rng.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U(30))
    h = h * MIX
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_powers: dict[int, np.ndarray] = {}
_PIECE = 1 << 19


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n-1; up to a million are kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = U(1)
        np.cumprod(have, out=have)
        if len(have) <= 1 << 20:
            _powers[int(base)] = have
    return have[:n]


def with_blocks(docs: DataFrame, block_bytes: int, columns: list[str]) -> tuple[DataFrame, int]:
    """``columns`` plus ``blk``, a hash of doc_id and text into blocks of about
    ``block_bytes`` bytes of text, and the number of blocks. Rows of one doc_id, or of none, may lie in
    several blocks; rows that repeat both lie in one."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return docs.select(*columns, F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(n)).alias("blk")), n


def joined_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the start of each (one more at the end).
    Null is empty."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=starts[1:])
    return np.frombuffer(b"".join(raw), np.uint8), starts


def pieces(pdf, size: int = 1 << 19):
    """The rows of a batch in pieces of about ``size`` characters of text: memory stays bounded
    however many rows a batch has."""
    part = np.cumsum(pdf["text"].fillna("").str.len().to_numpy()) // size
    for _, rows in pdf.groupby(part, sort=True):
        yield rows.reset_index(drop=True)


def word_spans(data: np.ndarray, starts: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` (or runs of ``letters``): first byte, end byte, and for each text the
    index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    solid = ~SPACE[data] if letters is None else letters[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first = solid & (np.r_[True, ~solid[:-1]] | edge[:-1])
    last = solid & (np.r_[~solid[1:], True] | edge[1:])
    at = np.flatnonzero(first)
    return at, np.flatnonzero(last) + 1, np.searchsorted(at, starts)


def span_hashes(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span ``[at, end)``; spans are in order, apart, not empty.

    Spans are hashed in pieces of some _PIECE bytes: what is held for each byte is many times its size.
    """
    out = np.zeros(len(at), np.uint64)
    size = end - at
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // _PIECE, prepend=-1)).tolist() + [len(at)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        n = size[a:b]
        total = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(total[-1]) - np.repeat(total[:-1], n)
        inside = np.repeat(at[a:b], n) + place
        values = BYTE[data[inside]] * powers(BASE, int(n.max()))[place]
        out[a:b] = np.add.reduceat(values, total[:-1]) + n.astype(np.uint64) * MIX
    return mix(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def bucket_cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where sorted 64-bit keys pass from one of ``n`` equal key ranges to the next."""
    edges = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def aligned(frame, tag: str, dtype) -> np.ndarray:
    """The answers of one exchange, in the order in which the block sent its keys."""
    own = frame[frame["tag"] == tag].sort_values("bucket")["data"] if len(frame) else []
    return np.frombuffer(b"".join(own), dtype)
