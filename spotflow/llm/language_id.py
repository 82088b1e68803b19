"""Language ID: unigrams over the pieces of a fixed public vocabulary, summed over all segmentations.

A word (with a blank before it) can be cut into vocabulary pieces in many ways.
Under a language it has the probability of all these ways together, which the
forward algorithm sums from left to right; a text has the product over its
words. Piece probabilities are fitted by expectation maximisation, in which the
forward and backward sums give each piece its expected count.

Words are handled as arrays: all words of one length together, each distinct
word of a batch once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spotflow.llm.byte_bpe import read_ranks
from spotflow.llm.common import _values, batches, byte_sums, hold, powers, release, spans, stored, word_bounds

#: Longest piece in bytes; longest word that is scored with others of its length.
PIECE, STRETCH = 16, 256
#: Longest stretch of a word in bytes that training takes as a whole.
TRAINED = 24
LETTER = re.compile(r"[^\W\d_]")


class Vocabulary:
    """Pieces of a rank file up to PIECE bytes, found by the rolling hash of their bytes."""

    def __init__(self, rank_file: str, bits: int = 20):
        pieces = sorted(t for t in read_ranks(rank_file) if len(t) <= PIECE)
        self.size = len(pieces)
        self.hashes = np.array([spans(byte_sums(p), np.array([0]), np.array([len(p)]))[0] for p in pieces], np.uint64)
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.shift = np.uint64(64 - bits)
        slot = self._slot(self.hashes)
        self.table = np.full(1 << bits, -1, np.int32)
        self.table[slot] = np.arange(self.size)
        self.shared = np.bincount(slot, minlength=1 << bits) > 1

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers; ``size`` where a hash is no piece's."""
        slot = self._slot(hashes)
        at = self.table[slot]
        out = np.where((at >= 0) & (self.hashes[at] == hashes), at, self.size)
        odd = np.flatnonzero(self.shared[slot])  # slots of several pieces
        if len(odd):
            place = np.minimum(np.searchsorted(self.sorted, hashes[odd]), self.size - 1)
            out[odd] = np.where(self.sorted[place] == hashes[odd], self.order[place], self.size)
        return out


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(rank_file: str) -> Vocabulary:
    if rank_file not in _vocabularies:
        _vocabularies[rank_file] = Vocabulary(rank_file)
        hold("language_id", _vocabularies.clear)
    return _vocabularies[rank_file]


def _pieces(words: np.ndarray, own: Vocabulary) -> dict[tuple[int, int], np.ndarray]:
    """(end, length) → piece number of each word's bytes [end - length, end)."""
    n = words.shape[1]
    up, down = powers(n + 1)
    sums = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum(_values[words] * down[:n], axis=1, dtype=np.uint64, out=sums[:, 1:])
    return {
        (end, size): own.find((sums[:, end] - sums[:, end - size]) * up[end - size])
        for end in range(1, n + 1) for size in range(1, min(PIECE, end) + 1)
    }


def _log_sums(words: np.ndarray, own: Vocabulary, chance: np.ndarray) -> np.ndarray:
    """Log probability of each word (rows of bytes, equal lengths) under each language."""
    n = words.shape[1]
    up, down = powers(n + 1)
    sums = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum(_values[words] * down[:n], axis=1, dtype=np.uint64, out=sums[:, 1:])
    one = np.ones((len(words), chance.shape[1]))
    window, logs = [one], np.zeros_like(one)
    for end in range(1, n + 1):
        now = np.zeros_like(one)
        for size in range(1, min(PIECE, end) + 1):
            at = own.find((sums[:, end] - sums[:, end - size]) * up[end - size])
            hit = np.flatnonzero(at < own.size)
            if len(hit):
                now[hit] += window[-size][hit] * chance[at[hit]]
        window = [*window[-PIECE + 1:], now]
        if end % 8 == 0:  # keep the numbers near one
            logs += np.log(now)
            window = [w / now for w in window]
    return logs + np.log(window[-1])


def _long_log_sums(words: list[bytes], own: Vocabulary, chance: np.ndarray, step: int = 64) -> np.ndarray:
    """As _log_sums, for words of any lengths side by side, a blank before each."""
    out = np.zeros((len(words), chance.shape[1]))
    padded = np.vstack([chance, np.zeros((1, chance.shape[1]))])
    up, down = powers(step + PIECE)
    ends, sizes = np.arange(PIECE, PIECE + step)[:, None], np.arange(1, PIECE + 1)
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    for group in (order[g:g + 512] for g in range(0, len(order), 512)):
        length = np.array([len(words[i]) for i in group])
        logs = np.zeros((len(group), chance.shape[1]))
        window = np.zeros((len(group), PIECE, chance.shape[1]))  # the sums 1, 2, ... bytes back
        window[:, 0] = 1
        for a in range(0, int(length[0]), step):
            n = int((length > a).sum())
            flat = b"".join(bytes(max(0, PIECE - 1 - a)) + words[i][max(0, a - PIECE + 1):a + step] + bytes(max(0, a + step - len(words[i]))) for i in group[:n])
            sums = np.zeros((n, step + PIECE), np.uint64)
            np.cumsum(_values[np.frombuffer(flat, np.uint8).reshape(n, -1)] * down[:-1], axis=1, dtype=np.uint64, out=sums[:, 1:])
            at = own.find(((sums[:, ends] - sums[:, ends - sizes]) * up[ends - sizes]).ravel()).reshape(n, step, PIECE)
            at = np.where(sizes <= a + ends - PIECE + 1, at, own.size)  # no piece starts before the word
            for k in range(min(step, int(length[0]) - a)):
                n = int((length > a + k).sum())
                now = (window[:n] * padded[at[:n, k]]).sum(1)
                done = np.flatnonzero(length[:n] == a + k + 1)
                for i in done:
                    out[group[i]] = logs[i] + np.log(now[i])
                window = np.concatenate([now[:, None], window[:n, :-1]], axis=1)
                if k % 8 == 7:
                    logs[:n] += np.log(now)
                    window /= now[:, None]
    return out


def _expected(words: np.ndarray, counts: np.ndarray, own: Vocabulary, chance: np.ndarray) -> np.ndarray:
    """Expected piece counts of words with counts, under one language."""
    n = words.shape[1]
    at = _pieces(words, own)
    padded = np.append(chance, 0.0)
    p = {k: padded[v] for k, v in at.items()}
    ahead, back = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
    ahead[0] = back[n] = 1
    for end in range(1, n + 1):
        for size in range(1, min(PIECE, end) + 1):
            ahead[end] += ahead[end - size] * p[end, size]
    for start in range(n - 1, -1, -1):
        for size in range(1, min(PIECE, n - start) + 1):
            back[start] += back[start + size] * p[start + size, size]
    scale = counts / ahead[n]
    out = np.zeros(own.size + 1)
    for (end, size), v in at.items():
        out += np.bincount(v, ahead[end - size] * p[end, size] * back[end] * scale, own.size + 1)
    return out[:-1]


def _matrix(buf: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Bytes of words of length n, a blank before each."""
    out = np.full((len(start), n + 1), 32, np.uint8)
    out[:, 1:] = buf[start[:, None] + np.arange(n)]
    return out


def stretches(word: bytes) -> Iterator[bytes]:
    """A word, or its parts of TRAINED bytes at most, cut between characters; the blank before it is not counted."""
    a, b = 0, TRAINED + 1
    while b < len(word):
        while word[b] & 0xC0 == 0x80:
            b -= 1
        yield word[a:b]
        a, b = b, b + TRAINED
    yield word[a:]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, text) → lang, word, n: stretches of words in lower case, a blank before each word."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, owner="language_id"):
            found: Counter = Counter()
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                found.update((lang, s) for w in text.lower().encode().split() for s in stretches(b" " + w))
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    chance: np.ndarray  # pieces x languages
    rank_file: str


def train(docs: DataFrame, rank_file: str, docs_per_language: int = 2000, rounds: int = 4, smoothing: float = 0.02) -> Model:
    """(doc_id, text, lang) → model, from about so many documents of each language.

    Documents are chosen by a hash of doc_id. Null texts and languages are left
    out; a language whose documents have no words is not learned. The model has
    one number per piece and language and is fitted in ``rounds`` passes.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((vocabulary(rank_file).size, 0)), rank_file)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, docs_per_language / n))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    words = stored(word_counts(chosen.select("lang", "text")).repartition("lang", "word"))
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    own = vocabulary(rank_file)
    chance = np.full((own.size, len(languages)), 1.0 / own.size)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("language_id")
        here = vocabulary(rank_file)
        sums = np.zeros((len(languages), here.size))
        for batch in source:
            lang = np.array([languages.index(x) for x in batch["lang"].to_pylist()])
            n = batch["n"].to_numpy().astype(float)
            word = batch["word"].to_pylist()
            size = np.array([len(w) for w in word])
            for k in range(len(languages)):
                for s in np.unique(size[lang == k]):
                    own_rows = np.flatnonzero((lang == k) & (size == s))
                    buf = np.frombuffer(b"".join(word[i] for i in own_rows), np.uint8)
                    for a in range(0, len(own_rows), 20_000):
                        part = own_rows[a:a + 20_000]
                        rows = buf.reshape(-1, s)[a:a + len(part)]
                        sums[k] += _expected(rows, n[part], here, chance[:, k])
        k, piece = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(piece, pa.int64()), pa.array(sums[k, piece])], names=["k", "piece", "n"])

    for _ in range(rounds):
        got = words.mapInArrow(count, "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        fitted = np.full_like(chance, smoothing)
        fitted[got["piece"].to_numpy(np.int64), got["k"].to_numpy(np.int64)] += got["n"].to_numpy(float)
        chance = fitted / fitted.sum(0)
    release()  # the driver needs the vocabulary no longer
    return Model(languages, chance, rank_file)


def _log_likelihoods(texts: list[bytes], own: Vocabulary, chance: np.ndarray) -> np.ndarray:
    """Texts x languages."""
    buf = b" ".join(texts)
    start, end = word_bounds(buf)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    long = np.flatnonzero(end - start > STRETCH)
    out = np.zeros((len(texts), chance.shape[1]))
    if len(long):
        kinds: dict[bytes, int] = {}
        which = [kinds.setdefault(b" " + buf[s:e], len(kinds)) for s, e in zip(start[long], end[long])]
        np.add.at(out, owner[long], _long_log_sums(list(kinds), own, chance)[which])
        owner, start, end = (np.delete(x, long) for x in (owner, start, end))
    hashes = spans(byte_sums(buf), start, end) + (end - start).astype(np.uint64)
    order = np.argsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    first = order[new]
    size = end[first] - start[first]
    logs = np.zeros((len(first), chance.shape[1]))
    flat = np.frombuffer(buf, np.uint8)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for a in range(0, len(rows), 20_000):
            part = rows[a:a + 20_000]
            logs[part] = _log_sums(_matrix(flat, start[first[part]], int(n)), own, chance)
    for k in range(chance.shape[1]):
        out[:, k] += np.bincount(owner, logs[kind, k], len(texts))
    return out


def identify(docs: DataFrame, model: Model, pred: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (or the names given) from the whole text of each row.

    ``score`` is the language's posterior under equal priors. A text that is
    null or has no letter is ``und`` with score 0, and so is every text if the
    model has learned no language; among equal languages the first by name
    wins. Columns of these names are replaced.
    """
    rest = [c for c in docs.columns if c not in (pred, score_as)]
    out = docs.select(*[F.col(f"`{c}`") for c in rest])
    languages, chance, rank_file = model.languages, model.chance, model.rank_file

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("language_id")
        own = vocabulary(rank_file)
        for batch in batches(source, 1 << 21, owner="language_id"):
            texts = [t or "" for t in batch["text"].to_pylist()]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if languages:
                logs = _log_likelihoods([t.lower().encode() for t in texts], own, chance)
                best = logs.argmax(1)
                sure = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                for i, t in enumerate(texts):
                    if LETTER.search(t):
                        lang[i], score[i] = languages[best[i]], sure[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score)], names=[*batch.schema.names, pred, score_as])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score_as, T.DoubleType())]))
