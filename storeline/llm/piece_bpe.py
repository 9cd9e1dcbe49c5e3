"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model.

Encoding by backtracking: an Aho-Corasick automaton gives, for every position, the
pieces that start there; the longest is tried first. A piece is accepted after
another only if the two are compatible: merging the characters of both by the
model's scores gives exactly these two pieces back. When nothing fits, the
position is marked in a bitfield as failed and the last piece is shortened. The
first sequence that reaches the end is the one that the merges produce.

No piece holds a white-space mark after another character, so merges never
cross into the next word; where no piece mixes Latin letters with other characters
either, merges do not cross between those. Texts are encoded word by word by the finest such
split of which every piece is one word, and words that recur are looked up.
"""

from __future__ import annotations

import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
_LATIN = "A-Za-z\u00c0-\u024f"
_LETTERS_APART = re.compile(f"{MARK}*[{_LATIN}]+|{MARK}*[^{_LATIN}{MARK}]+|{MARK}+")
_MARKS_APART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_KEEP_WORDS, _KEEP_PAIRS, _KEEP_LENGTH = 200_000, 500_000, 48
NORMAL, CONTROL, BYTE_KIND = 1, 3, 6


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id. The model must be a BPE model with byte fallback,
    no normalisation, and a dummy prefix."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if (train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix
            or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix):
        raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix")
    out = [(p.piece, p.score, p.type) for p in model.pieces]
    if any(k == NORMAL and MARK in p.lstrip(MARK) for p, _, k in out):
        raise ValueError("a piece holds a white-space mark inside")
    return out


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.pieces = pieces
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.score = {p: s for p, s, k in pieces if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE_KIND}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.eos = next(i for i, (p, _, k) in enumerate(pieces) if k == CONTROL and p == "</s>")
        self.text = [p.replace(MARK, " ") if k == NORMAL else "" for p, _, k in pieces]
        self.size = [len(p) for p, _, _ in pieces]
        # the longest piece that is a proper prefix of the piece
        self.shorter = {i: next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None)
                        for p, i in self.ids.items() if len(p) > 1}
        self.words = next(w for w in (_LETTERS_APART, _MARKS_APART) if all(w.fullmatch(p) for p in self.ids))
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1:
                self.automaton.add_word(p, (i, len(p) - 1))
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._words: dict[str, tuple[bytes, str]] = {}

    def merge(self, text: str) -> list[str]:
        """The model's own rule on a short text: the best-scored pair first, leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the texts of ``a`` and ``b`` gives these two again (so each alone is
        merged to itself as well); ``a`` -1: ``b`` alone."""
        if len(self._fits) >= _KEEP_PAIRS:
            self._fits.clear()
        parts = [self.pieces[i][0] for i in (a, b) if i >= 0]
        known = self._fits[(a + 1) * len(self.pieces) + b] = self.merge("".join(parts)) == parts
        return known

    def segment(self, text: str, single: list[int]) -> list[int]:
        """The piece ids of a text of which every character is a piece (``single``)."""
        longest = list(single)
        for end, (i, back) in self.automaton.iter(text):  # of those that start at a place the last is the longest
            longest[end - back] = i
        n = len(text)
        known, count, size, shorter = self._fits, len(self.pieces), self.size, self.shorter
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        at, last = 0, -1
        while at < n:
            i = longest[at]
            while i is not None:
                end = at + size[i]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fit = known.get((last + 1) * count + i)
                    if self.fits(last, i) if fit is None else fit:
                        out.append(i)
                        at, last = end, i
                        break
                i = shorter.get(i)
            else:
                if not out:
                    raise ValueError("no sequence of pieces")
                failed[at >> 3] |= 1 << (at & 7)
                at -= size[out.pop()]
                last = out[-1] if out else -1
        return out

    def encode_word(self, word: str) -> list[int]:
        single = list(map(self.ids.get, word))
        if None not in single:
            return self.segment(word, single)
        out: list[int] = []
        known = 0  # start of the run of characters that are pieces
        for i, c in enumerate(word):
            if single[i] is None:
                if known < i:
                    out += self.segment(word[known:i], single[known:i])
                out += [self.bytes[b] for b in c.encode("utf-8")]
                known = i + 1
        if known < len(word):
            out += self.segment(word[known:], single[known:])
        return out

    def decode_ids(self, ids: list[int]) -> str:
        """The pieces' text, white-space marks as spaces; control ids are left out."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.text[i] for i in ids])
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace").replace(MARK, " "))
                run.clear()
            out.append(self.text[i])
        out.append(run.decode("utf-8", "replace").replace(MARK, " "))
        return "".join(out)

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids (packed 32-bit) and decoded text of one word."""
        got = self._words.get(word)
        if got is None:
            ids = self.encode_word(word)
            got = array("i", ids).tobytes(), self.decode_ids(ids)
            if len(word) <= _KEEP_LENGTH:
                if len(self._words) >= _KEEP_WORDS:
                    self._words.clear()
                self._words[word] = got
        return got

    def encode(self, text: str) -> tuple[bytes, str]:
        """Packed ids of a text with the end id, and the text decoded from them."""
        end = array("i", [self.eos]).tobytes()
        if not text:
            return end, ""
        known, words = self._words, self.words.findall(MARK + text.replace(" ", MARK))
        got = [known.get(w) or self.word(w) for w in words]
        return b"".join([g[0] for g in got]) + end, "".join([g[1] for g in got])[1:]


_codecs: dict[str, Codec] = {}


def _codec(name: str, shared) -> Codec:
    """One codec for each broadcast model and worker process."""
    if name not in _codecs:
        _codecs.clear()  # a worker outlives queries
        _codecs[name] = Codec(shared.value)
    return _codecs[name]


def encode_documents(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ids (array<int>, with the end id) and decoded (string) of every text.

    A null text is empty: the end id only, decoded to an empty text. Rows stay as they are,
    repeated ones included; columns other than ``keep`` and text are left out; an
    empty table gives an empty result. The model's pieces (under a MB) are broadcast.
    """
    kept = docs.select(*keep, "text")
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")

    def run(batches):
        codec = _codec(name, shared)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = [codec.encode(t or "") for t in part.column("text").to_pylist()]
                offsets = np.zeros(len(got) + 1, np.int32)
                np.cumsum([len(g[0]) // 4 for g in got], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(
                    np.frombuffer(b"".join([g[0] for g in got]), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [
                    ids, pa.array([g[1] for g in got], pa.string())], names=[*keep, "ids", "decoded"])

    return kept.mapInArrow(run, f"{schema}, ids array<int>, decoded string")


def op3_piece_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
                           public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
