"""Language ID, context trees and BPE: exact sums, held-out accuracy, round trips."""

import functools
import itertools
import math
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from spotflow.llm import byte_bpe, context_tree, language_id

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


# -- byte-level BPE ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(codec, library):
    rng = random.Random(1)
    parts = ["a", "the", "ing", " ", "\n", "\t", "é", "ß", "中", "\U0001f600", "1", "²", "'s", "!", "=", "_", "\x1c", "\x85", "\xa0", "ம", "ɐ", "Q", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["".join(rng.choice(parts[:3]) for _ in range(200)) for _ in range(50)] + ["a" * 3000, "ab" * 2000, " " * 999 + "x", "=" * 777]
    for t in texts:
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t), repr(t)


def test_transducer_equals_merging(codec):
    rng = random.Random(2)
    ranks = codec.pieces.transducer.ranks
    tokens = sorted(ranks)
    for _ in range(500):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 4)))[:40]
        if piece in ranks:
            continue
        assert codec.pieces.transducer.encode(piece) == [ranks[t] for t in byte_bpe.merge(piece, ranks)]


def test_decoding_in_any_chunks(codec):
    text = "É中\U0001f600 tail " * 20
    ids = codec.encode(text)
    for step in (4, 8, 4000):
        assert "".join(codec.decode_stream(ids[i:i + step] for i in range(0, len(ids), step))) == text
    assert codec.decode(ids) == text.encode()
    assert "".join(codec.decode_stream([codec.encode("é")[:0], b""])) == ""


def test_encode_awkward_rows(spark, library):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "x" * 50_000), (3, "x" * 50_000), (4, "\n\n")]
    docs = table(spark, [(i, t, b"old", "d") for i, t in rows], ", ids binary, decoded string")
    got = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, r.text, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr) == sorted(
        ((i, t, library.encode_ordinary(t or "")) for i, t in rows), key=repr)
    assert all(r.decoded == (r.text or "") for r in got)
    assert byte_bpe.encode(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_states_take_little_memory(library, monkeypatch):
    def size(x):
        return sys.getsizeof(x) + (sum(map(size, x)) if isinstance(x, tuple) else 0)

    rng = random.Random(3)
    tokens = [t.decode("utf-8", "ignore") for t in sorted(byte_bpe.read_ranks(RANKS))]
    texts = ["".join(rng.choice(tokens).strip() for _ in range(3)) for _ in range(6000)]
    texts += [t + "s" for t in texts]
    made = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    machine = made.pieces.transducer
    for most in (1000, 100_000):  # what was met once is forgotten when no state can be added
        monkeypatch.setattr(byte_bpe, "STATES", most)
        for t in texts:
            assert np.frombuffer(made.encode(t), "<u4").tolist() == library.encode_ordinary(t)
        if most == 1000:
            assert len(machine.states) == most + 1 and not machine.met
            made.pieces.clear()
    assert len(machine.states) > 5000
    assert sum(map(size, machine.states)) / len(machine.states) < 150


def test_workers_get_texts_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)

    def sizes(source):
        import pyarrow as pa

        for batch in source:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    try:
        docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('word ', 1500) text")
        assert sum(r.n for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).selectExpr("1 n").collect()) == 3000
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 5_000_000
    finally:
        spark.conf.set(setting, before)


# -- language ID ------------------------------------------------------------------------


def all_cuts(word: bytes):
    for n in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), n):
            yield [word[a:b] for a, b in zip((0, *at), (*at, len(word)))]


def test_forward_sum_over_all_segmentations():
    own = language_id.vocabulary(RANKS)
    chance = np.random.default_rng(0).random((own.size, 2)) ** 8
    pieces = [t for t in sorted(byte_bpe.read_ranks(RANKS)) if len(t) <= language_id.PIECE]
    place = {p: i for i, p in enumerate(pieces)}
    for word in (b" the", b" \xc3\xa9tion", b" zzqx"):
        want = sum(np.prod([chance[place[p]] for p in cut], axis=0) for cut in all_cuts(word) if all(p in place for p in cut))
        got = language_id._log_sums(np.frombuffer(word, np.uint8)[None, :], own, chance)[0]
        assert np.allclose(got, np.log(want))


def test_expected_counts_are_those_of_all_segmentations():
    own = language_id.vocabulary(RANKS)
    chance = np.random.default_rng(1).random(own.size)
    pieces = [t for t in sorted(byte_bpe.read_ranks(RANKS)) if len(t) <= language_id.PIECE]
    place = {p: i for i, p in enumerate(pieces)}
    total, want = 0.0, Counter()
    for cut in all_cuts(b" there"):
        if all(p in place for p in cut):
            p = math.prod(chance[place[x]] for x in cut)
            total += p
            for x in cut:
                want[place[x]] += 3 * p
    got = language_id._expected(np.frombuffer(b" there", np.uint8)[None, :], np.array([3.0]), own, chance)
    assert {i: pytest.approx(v / total) for i, v in want.items()} == {int(i): got[i] for i in np.flatnonzero(got)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs.where("doc_id % 3 <> 1"), RANKS)
    rows = language_id.identify(docs.where("doc_id % 3 = 1"), model).collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    train = [(k, "the and of this that with from " * 3, "en") for k in range(5)] + [(9, None, "en"), (10, "der die das und nicht ein " * 4, "de"), (11, "x", None)]
    model = language_id.train(table(spark, train, ", lang string"), RANKS)
    assert model.languages == ["de", "en"]
    rows = [(None, "The WITH"), (1, None), (2, ""), (3, "12 !?\n"), (4, "nicht " * 20_000), (4, "nicht " * 20_000), (5, "ab" * 40_000), (6, "und")]
    got = language_id.identify(table(spark, [(i, t, 1.5) for i, t in rows], ", score double"), model).collect()
    pred = {(r.doc_id, (r.text or "")[:9]): (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows)
    assert [pred[i, (t or "")[:9]][0] for i, t in rows[:6]] == ["en", "und", "und", "und", "de", "de"] and pred[2, ""][1] == 0
    none = language_id.train(table(spark, [], ", lang string"), RANKS)
    assert none.languages == [] and {r.lang_pred for r in language_id.identify(table(spark, rows), none).collect()} == {"und"}
    assert language_id.identify(table(spark, []), model).count() == 0


# -- context trees ----------------------------------------------------------------------


def tree_by_hand(train, texts, depth):
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    counts, below = {}, defaultdict(list)
    places = lambda t: [((b"\0" * depth + t + b"\xff")[i:i + depth], (t + b"\xff")[i]) for i in range(len(t) + 1)]
    for t in train:
        for context, x in places(t):
            for d in range(depth + 1):
                for b in range(8):
                    key = context[depth - d:], 1 << b | x >> 8 - b
                    if key not in counts and key[0]:
                        below[key[0][1:], key[1]].append(key)
                    counts.setdefault(key, [0, 0])[x >> 7 - b & 1] += 1

    @functools.cache
    def weighted(key):
        own = kt(*counts[key])
        return own if len(key[0]) == depth else np.logaddexp(own, sum(map(weighted, below[key]))) - math.log(2)

    out = []
    for t in texts:
        total = 0.0
        for context, x in places(t):
            for b in range(8):
                p = None
                for d in range(depth, -1, -1):
                    key = context[depth - d:], 1 << b | x >> 8 - b
                    if key in counts:
                        own = (counts[key][x >> 7 - b & 1] + 0.5) / (sum(counts[key]) + 1)
                        stay = math.exp(kt(*counts[key]) - math.log(2) - weighted(key)) if p is not None else 1.0
                        p = own if p is None else stay * own + (1 - stay) * p
                total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


def test_scores_equal_the_tree_by_hand(spark):
    rng = random.Random(4)
    words = ["the", "Thing", "of", "É", "ring", "\U0001f600"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(30)]
    rows += [(30, None), (31, ""), (32, "the " * 3000), (32, "the " * 3000), (None, "never \x00 seen ZZ")]
    train = rows[:20] + [(7, None), (7, "of of")]
    got = context_tree.score(table(spark, rows).repartition(3), table(spark, train), 3).collect()
    low = lambda t: (t or "").encode().lower()
    want = tree_by_hand([low(t) for _, t in train], [low(t) for _, t in rows], 3)
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), r[1])
    made = sorted(((r.doc_id, r.n_bytes, r.score) for r in got), key=key)
    hand = sorted(((i, len(low(t)) + 1, s) for (i, t), s in zip(rows, want)), key=key)
    assert [m[:2] for m in made] == [h[:2] for h in hand]
    assert [m[2] for m in made] == pytest.approx([h[2] for h in hand], rel=1e-5)
    count = Counter(w for _, t in train for w in [*low(t).split(), None])
    n, v = sum(count.values()), len(count)
    for r in got:
        if r.doc_id is not None and r.doc_id < 30:
            tokens = [*low(dict(rows[:30])[r.doc_id]).split(), None]
            assert r.train_tokens == n and r.n_tokens == len(tokens) and r.n_known == sum(count[x] > 0 for x in tokens)
            assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens))


def test_scores_without_training_or_texts(spark):
    got = {r.doc_id: r.score for r in context_tree.score(table(spark, [(1, "ab"), (2, None)]), table(spark, []), 2).collect()}
    assert got == {1: pytest.approx(-24 * math.log10(2)), 2: pytest.approx(-8 * math.log10(2))}
    assert context_tree.score(table(spark, []), table(spark, [(1, "ab")]), 2).count() == 0


def test_bits_sum_to_one():
    keys = np.unique(np.random.default_rng(0).integers(0, 4, (500, 4)).astype(np.uint64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint64))
    levels = context_tree.tree(keys, np.ones(len(keys), np.int64), 3, 1)
    for context in (0x010203, 0x7F0000):
        every = np.array([context << 8 | x for x in range(256)], np.uint64)
        assert (10 ** context_tree.log_chance(every, 3, levels, [])).sum() == pytest.approx(1)
