"""Finding every stretch of 50 units (words or bytes) that an earlier document holds.

Both repeat removers (``substring_rlz``: words, ``suffix_array``: bytes) need,
for each window of 50 consecutive units, whether the same window starts in a
document with a smaller doc_id. Sending all windows through a shuffle would cost
many times the input, so the corpus is narrowed down first, without loss:

1. *Anchors.* The anchor of a window is its 16-unit gram with the smallest hash
   (leftmost on ties). Equal windows have equal anchors, so a window whose
   anchor occurs in one document only is unique. Blocks exchange anchor hashes
   (``blocks``) and learn which anchors two or more documents share.
2. *Contexts.* Consecutive windows with one anchor form one context, the text
   they cover. Blocks exchange (anchor hash, context hash), 128 bits, with the
   smallest doc_id. A context that an earlier document holds is repeated as a whole.
3. *Cores.* Where one anchor has several different contexts, the first holder
   of each context sends its text to the shard of that anchor, where the core
   (suffix array or relative Lempel-Ziv) finds which of its windows an
   earlier document holds. Equal windows meet in one shard as their anchors are equal.
4. *Cover.* Every block marks the units covered by its repeated windows.

Hot anchors (in more than ``HOT`` documents) may have as many contexts as
documents, at the two ends of a passage that very many share. Their windows are
compared one by one in the exchange of step 2, keyed by the window, so that no
shard receives an unbounded group. The result is the same either way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from storeline.llm import blocks as B

U = np.uint64
WINDOW, GRAM, HOT = 50, 16, 2000
NO_ID = -(2**63)
BUCKET_BYTES, SHARD_BYTES = 32 << 20, 2 << 20  # of text for each bucket of keys, each shard of contexts
PACKED = "blk long, bucket int, data binary"
ANSWER = "blk long, bucket int, tag string, data binary"
_STEP, _LOW = 1 << 14, U((1 << 15) - 1)  # grams are hashed in pieces that stay in the CPU's cache


_FACTORS = {1: B.BASE, 2: B.MIX, 4: U(0xD6E8FEB86659FD93), 8: U(0xA0761D6478BD642F)}
_AT = np.arange(_STEP + WINDOW, dtype=np.uint64)


def _gram(s: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-unit grams, by doubling; the units are random 64-bit symbols."""
    span = 1
    while span < GRAM:
        s = s[:-span] * _FACTORS[span] + s[span:]
        span *= 2
    s ^= s >> U(32)
    s *= B.MIX
    s ^= s >> U(29)
    return s


def _smallest(key: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


class Picks:
    """The contexts of a block: runs of windows ``first..last`` with one anchor.

    ``h``: anchor hash, ``doc``: index of the document.
    """

    def __init__(self, sym: np.ndarray, starts: np.ndarray):
        self.sym, self.starts, self.total = sym, starts, None
        n = len(sym) - WINDOW + 1
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.doc = self.anchor = empty
        self.h = np.zeros(0, np.uint64)
        if n <= 0:
            return
        valid = np.ones(n, bool)
        for a, b in zip(starts[:-1], starts[1:]):
            valid[max(a, b - WINDOW + 1):b] = False
        parts = []
        for i in range(0, n, _STEP):
            s = sym[i:min(i + _STEP, n) + WINDOW - 1]
            g = _gram(s)
            p = (_smallest((g & ~_LOW) | _AT[:len(g)], WINDOW - GRAM + 1) & _LOW).astype(np.int64)
            v = np.flatnonzero(valid[i:i + len(p)])
            if not len(v):
                continue
            p = p[v]
            new = np.empty(len(v), bool)
            new[0] = True
            new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1] + 1)
            new = np.flatnonzero(new)
            last = np.append(v[new[1:] - 1], v[-1])
            parts.append((v[new] + i, last + i, p[new] + i, g[p[new]]))
        if not parts:
            return
        first, last, anchor, h = (np.concatenate(x) for x in zip(*parts))
        new = np.ones(len(first), bool)  # a run may go on in the next piece
        new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1)
        self.first, self.last = first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]
        # an anchor is the smallest of its window's hashes; mixed, anchors spread evenly over the key ranges
        self.h, self.anchor = B.mix(h[new]), anchor[new]
        self.doc = np.searchsorted(starts, self.first, "right") - 1

    def contexts(self) -> np.ndarray:
        """Hashes of the contexts, with the place of the anchor in them."""
        return self.ranges(self.first, self.last + WINDOW, self.anchor - self.first)

    def ranges(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        """Hashes of the unit ranges ``[a, b)``, independent of their place."""
        if self.total is None:
            self.total = np.zeros(len(self.sym) + 1, np.uint64)
            np.cumsum(self.sym * B.powers(B.BASE, len(self.sym)), out=self.total[1:])
        h = (self.total[b] - self.total[a]) * B.powers(B.BASE_INV, len(self.sym) + 1)[a]
        return B.mix(B.mix(h) + np.asarray(salt).astype(np.uint64) * B.MIX + (b - a).astype(np.uint64))


def _byte_units(texts):
    data, starts = B.joined_bytes(texts)
    return B.BYTE[data], starts


def _word_units(texts):
    data, starts = B.joined_bytes(texts)
    at, end, first = B.word_spans(data, starts)
    return B.span_hashes(data, at, end), first


UNITS: dict[str, Callable] = {"bytes": _byte_units, "words": _word_units}


class _Block:
    """What one block knows; each step adds the answers of one exchange."""

    def __init__(self, docs: pd.DataFrame, unit: str):
        self.ids = docs["doc_id"].to_numpy(np.int64)
        self.picks = Picks(*UNITS[unit](docs["text"]))
        p = self.picks
        order = np.argsort(p.h, kind="stable")  # documents are in the order of their ids
        h, d = p.h[order], self.ids[p.doc[order]]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        other = new.copy()
        other[1:] |= d[1:] != d[:-1]
        at = np.flatnonzero(new)
        self.anchors = h[at]
        self.anchor_docs = np.add.reduceat(other, at, dtype=np.int64) if len(at) else at

    def shared(self, answers: pd.DataFrame) -> None:
        """Keys of step 2: contexts of shared anchors, single windows of hot ones."""
        p = self.picks
        state = B.aligned(answers, "anchors", np.uint8)
        state = state[np.searchsorted(self.anchors, p.h)] if len(state) else np.zeros(len(p.h), np.uint8)
        self.whole, hot = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        n = p.last[hot] - p.first[hot] + 1
        self.single = np.repeat(p.first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = p.ranges(self.single, self.single + WINDOW) if len(hot) else np.zeros(0, np.uint64)
        h = np.concatenate([p.h[self.whole], B.mix(w ^ np.repeat(p.h[hot], n))])
        c = np.concatenate([p.contexts()[self.whole], w]) if len(self.whole) else w
        self.key_ids = self.ids[np.concatenate([p.doc[self.whole], np.repeat(p.doc[hot], n)])]
        order = np.lexsort((self.key_ids, c, h))
        h, c, d = h[order], c[order], self.key_ids[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        self.key = np.empty(len(h), np.int64)
        self.key[order] = np.cumsum(new) - 1
        self.kh, self.kc, self.kd = h[new], c[new], d[new]
        self.kat = order[new]

    def owned(self, answers: pd.DataFrame) -> None:
        """Keys that an earlier document holds; contexts that this block must send to a core."""
        flags = B.aligned(answers, "contexts", np.uint8)
        flags = flags if len(flags) else np.zeros(len(self.kh), np.uint8)
        self.earlier, self.send = (flags & 1) > 0, np.flatnonzero(flags == 2)

    def repeated(self, answers: pd.DataFrame) -> np.ndarray:
        """Units covered by a repeated window."""
        p, n = self.picks, len(self.whole)
        bits = np.unpackbits(B.aligned(answers, "cores", np.uint8)).astype(bool)
        dup = self.earlier[self.key] | (self.key_ids > self.kd[self.key])
        mark = np.zeros(len(p.sym) + 1, np.int64)
        full = self.whole[dup[:n]]
        np.add.at(mark, p.first[full], 1)
        np.add.at(mark, p.last[full] + WINDOW, -1)
        own = self.single[dup[n:]]
        np.add.at(mark, own, 1)
        np.add.at(mark, own + WINDOW, -1)
        if len(self.send):
            at = self.whole[self.kat[self.send]]
            size = p.last[at] - p.first[at] + 1
            begin = _bit_starts(size, self.kh[self.send], self.n_shards)
            place = np.full(len(self.kh), -1, np.int64)
            place[self.send] = np.arange(len(self.send))
            rest = np.flatnonzero(~dup[:n] & (place[self.key[:n]] >= 0))
            j, w = place[self.key[rest]], self.whole[rest]
            m = size[j]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            hit = bits[np.repeat(begin[j], m) + step]
            own = (np.repeat(p.first[w], m) + step)[hit]
            np.add.at(mark, own, 1)
            np.add.at(mark, own + WINDOW, -1)
        return np.cumsum(mark[:-1]) > 0


def _bit_starts(size: np.ndarray, h: np.ndarray, n_shards: int) -> np.ndarray:
    """Where the answer bits of each sent context start; each bucket's answer fills whole bytes."""
    out, at = np.zeros(len(size), np.int64), 0
    cuts = B.bucket_cuts(h, n_shards)
    for a, b in zip(cuts[:-1], cuts[1:]):
        total = np.cumsum(size[a:b])
        out[a:b] = at + total - size[a:b]
        at += -(-int(total[-1]) // 8) * 8 if b > a else 0
    return out


def _packed(blk, keys: np.ndarray, n_buckets: int, columns) -> pd.DataFrame:
    cuts = B.bucket_cuts(keys, n_buckets)
    rows = [(blk, i, columns(a, b)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    return pd.DataFrame(rows, columns=["blk", "bucket", "data"])


def _anchor_answers(sent: pd.DataFrame, hot: int) -> pd.DataFrame:
    """0: in one document, 1: in several, 2: in more than ``hot``."""
    raw = [np.frombuffer(x, np.uint8) for x in sent["data"]]
    n = np.array([len(x) // 12 for x in raw])
    h = np.concatenate([x[:8 * k].view(np.uint64) for x, k in zip(raw, n)])
    count = np.concatenate([x[8 * k:].view(np.uint32) for x, k in zip(raw, n)])
    _, group = np.unique(h, return_inverse=True)
    total = np.bincount(group, weights=count)[group]
    state = (total > 1).astype(np.uint8) + (total > hot).astype(np.uint8)
    return _answer(sent, "anchors", np.split(state, np.cumsum(n)[:-1]))


def _context_answers(sent: pd.DataFrame) -> pd.DataFrame:
    """Bit 0: an earlier document holds the context; bit 1: the anchor has several contexts."""
    raw = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in sent["data"]]
    n = np.array([x.shape[1] for x in raw])
    h, c, d = np.concatenate(raw, 1)
    d = d.view(np.int64)
    order = np.lexsort((d, c, h))
    hs, cs, ds = h[order], c[order], d[order]
    other = np.concatenate([[True], hs[1:] != hs[:-1]])
    new = other | np.concatenate([[True], cs[1:] != cs[:-1]])
    first = ds[new][np.cumsum(new) - 1]
    group = np.cumsum(other) - 1
    several = np.bincount(group, weights=new)[group] > 1
    flags = np.empty(len(h), np.uint8)
    flags[order] = (ds > first).astype(np.uint8) + 2 * several.astype(np.uint8)
    return _answer(sent, "contexts", np.split(flags, np.cumsum(n)[:-1]))


def _answer(sent: pd.DataFrame, tag: str, parts) -> pd.DataFrame:
    return pd.DataFrame({"blk": sent["blk"], "bucket": sent["bucket"], "tag": tag,
                         "data": [x.tobytes() for x in parts]})


def _core_answers(sent: pd.DataFrame, unit: str, core: Callable) -> pd.DataFrame:
    dtype = np.uint8 if unit == "bytes" else np.uint64
    heads, bodies = [], []
    for x in sent["data"]:
        k = int(np.frombuffer(x[:8], np.int64)[0])
        heads.append(np.frombuffer(x[8:8 + 16 * k], np.int64).reshape(2, k))
        bodies.append(np.frombuffer(x[8 + 16 * k:], dtype))
    ids, size = np.concatenate(heads, 1)
    hit = core(np.concatenate(bodies), ids, size + WINDOW - 1)
    cuts = np.cumsum([h[1].sum() for h in heads])[:-1]
    return _answer(sent, "cores", [np.packbits(x) for x in np.split(hit, cuts)])


def find_repeats(docs: DataFrame, unit: str, core: Callable, finish: Callable, schema: str,
                 block_bytes: int, keep: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """``finish(docs, covered, starts)`` of every block of ``docs`` (doc_id, text, ``keep``).

    ``covered`` marks the units of the block's texts in a window that also
    starts in a document with a smaller doc_id, ``starts`` where each text's
    units start. ``core(units, ids, sizes)`` gets contexts of ``sizes`` units
    of the documents ``ids`` and returns for each window in them, in order,
    whether a smaller id has it too.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", *keep)
    texts, n_blocks = B.with_blocks(docs, block_bytes, ["doc_id", "text", *keep])
    # every block sends a message to every bucket: as few buckets as memory allows. A bucket holds up to two bytes for
    # each of its share of the texts, sorted; a core needs about a hundred for each of its own
    n_buckets = max(6, -(-n_blocks * block_bytes // BUCKET_BYTES))
    n_shards = max(6, -(-n_blocks * block_bytes // SHARD_BYTES))

    def in_order(pdf):  # a shuffle may deliver rows in another order in each pass
        return pdf.sort_values(["doc_id", "text"], ignore_index=True)

    def block(pdf, *answers) -> _Block:
        b = _Block(pdf, unit)
        b.n_shards = n_shards
        for step, a in zip((b.shared, b.owned), answers):
            step(a)
        return b

    def send_anchors(key, pdf):
        b = block(in_order(pdf))
        return _packed(key[0], b.anchors, n_buckets, lambda i, j:
                       b.anchors[i:j].tobytes() + b.anchor_docs[i:j].astype(np.uint32).tobytes())

    def send_contexts(key, pdf, got):
        b = block(in_order(pdf), got) if len(pdf) else None
        if b is None:
            return pd.DataFrame(columns=["blk", "bucket", "data"])
        return _packed(key[0], b.kh, n_buckets, lambda i, j:
                       np.stack([b.kh[i:j], b.kc[i:j], b.kd[i:j].view(np.uint64)]).tobytes())

    def send_cores(key, pdf, got):
        pdf = in_order(pdf)
        b = block(pdf, got, got) if len(pdf) else None
        if b is None or not len(b.send):
            return pd.DataFrame(columns=["blk", "bucket", "data"])
        p, at = b.picks, b.whole[b.kat[b.send]]
        data = np.concatenate(pdf["text"].map(lambda t: np.frombuffer(
            (t or "").encode("utf-8", "surrogatepass"), np.uint8)).tolist()) if unit == "bytes" else p.sym
        a, size = p.first[at], p.last[at] - p.first[at] + 1
        ids = b.kd[b.send]

        def body(i, j):
            return (np.array([j - i]).tobytes() + ids[i:j].tobytes() + size[i:j].tobytes()
                    + b"".join(data[x:x + k + WINDOW - 1].tobytes() for x, k in zip(a[i:j], size[i:j])))

        return _packed(key[0], b.kh[b.send], n_shards, body)

    def cover(key, pdf, got):
        pdf = in_order(pdf)
        b = block(pdf, got, got)
        return finish(pdf, b.repeated(got), b.picks.starts)

    def asked(answers):
        return texts.groupBy("blk").cogroup(answers.groupBy("blk"))

    anchors = texts.groupBy("blk").applyInPandas(send_anchors, PACKED).groupBy("bucket").applyInPandas(
        lambda key, sent: _anchor_answers(sent, hot), ANSWER)
    contexts = asked(anchors).applyInPandas(send_contexts, PACKED).groupBy("bucket").applyInPandas(
        lambda key, sent: _context_answers(sent), ANSWER)
    cores = asked(anchors.unionAll(contexts)).applyInPandas(send_cores, PACKED).groupBy("bucket").applyInPandas(
        lambda key, sent: _core_answers(sent, unit, core), ANSWER)
    out = asked(anchors.unionAll(contexts).unionAll(cores)).applyInPandas(cover, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
