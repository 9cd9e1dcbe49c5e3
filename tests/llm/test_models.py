"""Encoding, scoring, classifiers, mixing and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from storeline.llm import cotraining, mixing, piece_bpe, suffix_tree_lm, toxicity_crf, winnowing

SF = "/root/testdata/sf0.01"


def test_encoding_equals_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    letters = "aäeinstr ▁ 漢字é\t\n\U0001F600<0x0A></s>-.!THE the  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["", " ", "a" * 3000, " " * 100, "ab" * 700, "\0a", "the" * 500]
    ours = piece_bpe.Codec(piece_bpe.read_pieces(path))
    for t in texts:
        ids, decoded = ours.encode(t)
        want = theirs.encode(t, add_eos=True)
        assert np.frombuffer(ids, np.int32).tolist() == want and decoded == theirs.decode(want)
    docs = spark.createDataFrame([(1, None, "x"), (1, "two words", "y"), (None, "", None)],
                                 "doc_id long, text string, ids string")
    out = piece_bpe.encode_documents(docs, path).collect()
    assert sorted((r.ids, r.decoded) for r in out) == sorted(
        (theirs.encode(t, add_eos=True), t) for t in ("", "two words", ""))


def test_base_scores_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    rows += [(10**9, None), (10**9 + 1, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    got = {r.doc_id: r for r in suffix_tree_lm.score_documents(
        docs, suffix_tree_lm.fit(train), block_bytes=50_000).collect()}
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(fold)) + [None] for d, t in rows}
    count = collections.Counter(x for d, ts in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1 for x in ts)
    n, v = sum(count.values()), len(count)
    for d, ts in tokens.items():
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)
        assert got[d].n_tokens == len(ts) and got[d].train_tokens == n
        assert got[d].n_known == sum(count[x] > 0 for x in ts)
        assert got[d].base_score == pytest.approx(base, rel=1e-9) and got[d].score <= 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_tree_distributions_sum_to_one():
    rng = np.random.RandomState(0)
    vocabulary = np.sort(rng.randint(1, 2**62, 30).astype(np.uint64))
    pd = pytest.importorskip("pandas")
    one = pd.DataFrame({"context": np.repeat(vocabulary[:2], 5), "token": np.tile(vocabulary[:5], 2),
                        "suffix": np.repeat(vocabulary[:2], 5), "size": 100.0, "n": 12.0})
    tree = {"total": 3000, "word": vocabulary, "word_n": np.full(30, 100.0), "one": one, "two": one.iloc[:0],
            "distinct": 30}
    model = suffix_tree_lm.Scorer(tree)
    token = np.stack([np.full(30, vocabulary[0]), vocabulary], 1).reshape(-1)
    starts = np.arange(0, 61, 2)
    _, p = model.probabilities(token, starts, np.full(60, 100.0))
    unseen = 0.5 / model.den  # the share that the root keeps for what it hasn't seen
    assert p[1::2].sum() == pytest.approx(1 - unseen, abs=0.01)


def test_toxicity_held_out(spark):
    out = toxicity_crf.op10_toxicity_crf(spark, SF).toPandas()
    both = out.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert len(out) == 1000 and ((out["score"] >= 0) & (out["score"] <= 1)).all()
    assert (held["predicted"] == held["toxic"]).mean() > 0.9


def test_marginals_by_enumeration():
    rng = np.random.RandomState(1)
    emit, trans = rng.randn(5, 2), rng.randn(2, 2)
    first = np.array([True, False, False, True, False])
    post, pair = toxicity_crf.marginals(emit, trans, first)
    total, want, pairs = 0.0, np.zeros((5, 2)), np.zeros((2, 2))
    for tags in np.ndindex(*[2] * 5):
        links = [(tags[i - 1], tags[i]) for i in range(1, 5) if not first[i]]
        w = math.exp(sum(emit[i, g] for i, g in enumerate(tags)) + sum(trans[a] for a in links))
        total += w
        for i, g in enumerate(tags):
            want[i, g] += w
        for a in links:
            pairs[a] += w
    assert np.allclose(post, want / total) and np.allclose(pair, pairs / total)


def test_quality(spark):
    out = cotraining.op4_cotraining(spark, SF).toPandas()
    both = out.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert len(out) == 1000 and (both["kept"] == (both["quality"] == 1)).mean() > 0.97


def test_winnowing_by_hand(spark):
    words = [f"w{i % 7}" for i in range(40)]
    df = spark.createDataFrame([(" ".join(words),), (" ".join(words[5:]),), ("one two",), (None,)], "text string")
    got = [r[0] for r in df.select(winnowing.selected(df["text"])).collect()]
    k, w = winnowing.K, winnowing.W
    low = (1 << 24) - 1
    place = [low - (x & low) for x in got[0]]
    assert place == sorted(set(place)) and place[0] < w and max(b - a for a, b in zip(place, place[1:])) <= w
    assert len(got[2]) == 1 and got[3] == []
    # equal stretches of w + k - 1 words share a hash
    assert {x >> 24 for x in got[0]} & {x >> 24 for x in got[1]}


def test_next_document_is_the_following_id(spark):
    rows = [(i, f"t{i}") for i in (3, 1, 9000, 50000, 4095, 4096)]
    got = {r.doc_id: r.next_text for r in winnowing.with_next(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "t3", 3: "t4095", 4095: "t4096", 4096: "t9000", 9000: "t50000", 50000: "t1"}


def test_mix_meets_budget_and_limit(spark):
    rows = [(i, "a" if i % 10 else None, "w " * (1 + i % 5)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mixed(docs, repetitions=1.5).toPandas()
    own = docs.toPandas()
    own["n"] = own["text"].str.split().map(len)
    budget = own["n"].sum()
    total = own.groupby(own["source"].fillna(""))["n"].sum()
    used = out.groupby(out["source"].fillna(""))["n_tokens"].sum()
    assert out["n_tokens"].sum() <= budget and (used <= 1.5 * total + 1e-6).all()
    assert used[""] == pytest.approx(1.5 * total[""], rel=0.02)
    assert not out.duplicated(["doc_id", "block"]).any()
    flat = mixing.mixed(docs, entropy=math.log(2)).toPandas()
    share = flat.groupby(flat["source"].fillna(""))["n_tokens"].sum() / budget
    assert share[""] == pytest.approx(0.5, rel=0.03)
    assert mixing.mixed(docs.limit(0), repetitions=2.0).count() == 0


def test_tree_equals_brute_force_at_any_depth(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(30)):
            a = rng.choice("ab")
            # what follows is told by the word three back only
            words += rng.choice([[a, "x", "y", "p" if a == "a" else "q"], ["z", "y", "s"], [f"r{rng.randrange(40)}"]])
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (None, "a x y p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    got = {r.doc_id: r for r in suffix_tree_lm.score_documents(
        docs, suffix_tree_lm.fit(train), block_bytes=2000).collect()}

    tokens = {d: [*(t or "").split(), None] for d, t in rows}
    # every context of a text, of any length, from END on
    follows = collections.defaultdict(collections.Counter)
    used = [ts for d, ts in tokens.items() if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    count = collections.Counter(x for ts in used for x in ts)
    total, den = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    for ts in used:
        for i, x in enumerate(ts):
            for k in range(1, i + 2):
                follows[tuple([None, *ts][i + 1 - k:i + 1])][x] += 1
    kept = {}

    def p(context, x):
        if not context:
            return (count[x] + 0.5) / den
        parent = p(context[1:], x)
        if context not in kept:
            return parent
        n, entries, k, size, rest = kept[context]
        return ((entries[x] if x in entries else rest * parent) + k * parent) / (size + k)

    for length in range(1, 100):
        found = {}
        for c, n in follows.items():
            size = sum(n.values())
            entries = {x: m for x, m in n.items() if m >= suffix_tree_lm.ENTRY_COUNT}
            if len(c) != length or size < suffix_tree_lm.CONTEXT_COUNT or not entries:
                continue
            parent = {x: p(c[1:], x) for x in entries}
            rest, left = size - sum(entries.values()), 1 - sum(parent.values())
            gain = sum(m * math.log(m / size / parent[x]) for x, m in entries.items())
            gain += rest * math.log(rest / size / max(left, 1e-12)) if rest else 0
            if gain >= 0.5 * len(entries) * math.log(size) and gain >= suffix_tree_lm.LEAST_DIVERGENCE * size:
                found[c] = (n, entries, len(entries) + 1, size, rest / max(left, 1e-9))
        kept |= found
        if not found:
            break
    assert length > 3  # contexts of three words are kept
    for d, ts in tokens.items():
        want = sum(math.log10(p(tuple([None, *ts][:i + 1]), x)) if i < 12 else
                   math.log10(p(tuple(ts[i - 12:i]), x)) for i, x in enumerate(ts))
        assert got[d].score == pytest.approx(want, rel=1e-9)
        assert got[d].train_tokens == total


def test_toxicity_on_a_clustered_table(spark):
    rng = random.Random(5)

    def text(words, n=30):
        return " ".join(rng.choice(words) for _ in range(n))
    calm = [f"calm{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    # one clean source comes first and holds a third of all rows; toxic documents lie behind it
    rows = [(i, text(calm), 0) for i in range(900)]
    rows += [(900 + i, text(calm, 25) + (" vileword grimword" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(1600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").coalesce(1)
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", "toxic")
    picked = toxicity_crf.sampled(docs, labels)
    assert picked[picked["field"]]["y"].value_counts().to_dict() == {0: 200, 1: 200}
    assert toxicity_crf.sampled(docs.orderBy("text"), labels).equals(picked)
    out = toxicity_crf.tag_documents(docs, toxicity_crf.fit(docs, labels)).toPandas().set_index("doc_id")
    for d, _, y in rows:
        assert (out.loc[d, "score"] >= 0.5) == (y == 1) and (len(out.loc[d, "spans"]) == 2) == (y == 1)


def test_lexicon_has_no_size_limit(spark):
    def name(i):
        return "".join(chr(97 + i // 26 ** k % 26) for k in range(4))
    # 24,000 words that only toxic documents hold
    rows = [(i, " ".join(name(j) for j in range(i % 40 * 600, i % 40 * 600 + 600)) if i < 1200 else "calm text", int(i < 1200))
            for i in range(3600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_crf.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert len(model["lexicon"][0]) >= 24_000


def test_tree_packs_blocks_and_leaves_nothing_behind(spark):
    rng = np.random.RandomState(2)
    key = np.concatenate([rng.randint(1, 2**62, 500).astype(np.uint64)] * 2 + [np.arange(1 << 20, (1 << 20) + 9, dtype=np.uint64)])
    for x in (key, key[:1000], key[:0]):  # the last nine differ in the low bits only
        for got, want in zip(suffix_tree_lm._distinct(x), np.unique(x, return_index=True, return_inverse=True)):
            assert got.tolist() == want.tolist()
    columns = [key, np.array([-1, 0, 300]), np.array([0.1, -0.0, np.inf]), np.zeros(0, np.int64)]
    types = [np.uint64, np.int64, float, np.int64]
    for got, want in zip(suffix_tree_lm._unpack(suffix_tree_lm._pack(*columns), *types), columns):
        assert got.tolist() == want.tolist()
    docs = spark.createDataFrame([(i, "a b c d") for i in range(50)], "doc_id long, text string")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    out = suffix_tree_lm.score_documents(docs, suffix_tree_lm.fit(docs), block_bytes=100)
    assert out.count() == 50 and spark.conf.get(name) == before
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("suffix_tree_blocks")]
