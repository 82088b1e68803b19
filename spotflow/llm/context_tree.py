"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the
bytes before. A node holds how often 0 and 1 followed its context in the
training texts and the Krichevsky-Trofimov probability of these counts. Its
weighted probability is half that and half the product over the longer
contexts below; so all depths are mixed, each by how well it explained the
training texts. A context not seen in training ends its branch: the deepest
one seen takes its place. Scoring multiplies the predictions along each text.

Counts of byte strings come from all training texts. They are dealt out by the
two nearest context bytes, so a whole subtree lies in one bucket; only the two
top levels, 256 x 256 numbers at most, are known to all tasks. Texts to be
scored lie in blocks; a block sends each distinct string once and gets its log
probability back, so no task ever holds the whole model. Word counts for the
base score take the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotflow.llm.common import as_bytes, batches, blocked, mix, runs, stored, total_chars, width, word_hashes

#: Byte after the end of a text; it occurs in no UTF-8 text. Zeros stand before the start.
END = b"\xff"
HALF = np.log(0.5)
U8 = np.uint64(8)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5, by Stirling's series eight steps up."""
    down = np.ones_like(x)
    for i in range(8):
        down *= np.where(x < 1e6, x + i, 1.0)
    y = np.where(x < 1e6, x + 8, x)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(down)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte at each place as one number (nearest context byte first, the byte last), and places per text."""
    flat = np.frombuffer(b"".join([b"\0" * depth + t + END for t in texts]), np.uint8).astype(np.uint64)
    key = flat[depth:].copy()
    for j in range(1, depth + 1):
        key |= flat[depth - j:len(flat) - j] << np.uint64(8 * (depth + 1 - j))
    counts = np.array([len(t) + 1 for t in texts], np.int64)
    return key[_inside(counts, depth)], counts


def _inside(counts: np.ndarray, depth: int) -> np.ndarray:
    """Indices of the texts' own places once the first ``depth`` bytes are gone."""
    start = np.cumsum(counts) - counts + depth * np.arange(len(counts))
    return np.arange(int(counts.sum())) + np.repeat(start - (np.cumsum(counts) - counts), counts)


def tallied(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if counts is None:
        keys = np.sort(keys)
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[edge], np.diff(np.append(edge, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


class Level:
    """Binary nodes of all contexts of one length: (context << 8 | node) with counts and weights."""

    def __init__(self, context_and_byte: np.ndarray, counts: np.ndarray, below: Level | None):
        context, byte = context_and_byte >> U8, context_and_byte & np.uint64(255)
        keys, ones = [], []
        for b in range(8):
            node = np.uint64(1 << b) | (byte >> np.uint64(8 - b))
            keys.append(context << U8 | node)
            ones.append((byte >> np.uint64(7 - b)) & np.uint64(1))
        keys, ones, n = np.concatenate(keys), np.concatenate(ones).astype(np.int64), np.tile(counts, 8)
        self.keys, both = tallied(keys, n)
        self.ones = tallied(keys, n * ones)[1]
        self.zeros = both - self.ones
        kt = log_kt(self.zeros.astype(float), self.ones.astype(float))
        if below is None:
            self.weighted, self.stay = kt, np.ones(len(kt))
        else:
            # a node's key without its farthest byte is its parent's
            parent = below.keys >> np.uint64(16) << U8 | below.keys & np.uint64(255)
            self.weigh(kt, tallied(parent, below.weighted)[1])

    def weigh(self, kt: np.ndarray, children: np.ndarray) -> None:
        self.weighted = np.logaddexp(HALF + kt, HALF + children)
        self.stay = np.exp(HALF + kt - self.weighted)

    def predict(self, context: np.ndarray, byte: np.ndarray, chance: np.ndarray) -> None:
        """Mix this level into the chance of each of the eight bits; NaN: no longer context seen."""
        if not len(self.keys):
            return
        for b in range(8):
            node = np.uint64(1 << b) | (byte >> np.uint64(8 - b))
            one = ((byte >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
            key = context << U8 | node
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            at = at[hit]
            own = (np.where(one[hit], self.ones[at], self.zeros[at]) + 0.5) / (self.ones[at] + self.zeros[at] + 1.0)
            deep = chance[hit, b]
            chance[hit, b] = np.where(np.isnan(deep), own, self.stay[at] * own + (1 - self.stay[at]) * deep)


def tree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels from ``depth`` up to ``top``."""
    levels: list[Level] = []
    for d in range(depth, top - 1, -1):
        levels.append(Level(keys, counts, levels[-1] if levels else None))
        if d > top:
            # drop the farthest context byte
            keys, counts = tallied(keys >> np.uint64(16) << U8 | keys & np.uint64(255), counts)
    return levels


def log_chance(keys: np.ndarray, depth: int, levels: list[Level], top: list[Level]) -> np.ndarray:
    """Log10 probability of the byte of each key in its context."""
    byte = keys & np.uint64(255)
    chance = np.full((len(keys), 8), np.nan)
    for i, level in enumerate([*levels, *top]):
        level.predict(keys >> np.uint64(8 * (i + 1)), byte, chance)
    return np.log10(np.where(np.isnan(chance), 0.5, chance)).sum(1)


def _texts(table: pa.Table | pa.RecordBatch) -> list[bytes]:
    return [t.lower() for t in as_bytes(table["text"])]  # bytes: A-Z only


def _distinct(texts: list[bytes], depth: int) -> list[np.ndarray]:
    """Distinct strings and words of texts, in order."""
    found = [np.zeros(0, np.uint64)] * 2
    for part in runs(texts, 1 << 21):
        for kind, keys in enumerate((strings(part, depth)[0], word_hashes(part)[0])):
            found[kind] = tallied(np.concatenate([found[kind], tallied(keys)[0]]))[0]
    return found


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key; keys are asked for in order, which is kind to the cache."""
    order = np.argsort(keys)
    out = np.empty(len(keys), values.dtype)
    out[order] = values[np.searchsorted(known, keys[order])]
    return out


def _dealt(keys: np.ndarray, of: np.ndarray, counts: np.ndarray | None = None):
    """(bucket, keys, counts) of each bucket; sorted keys stay sorted."""
    order = np.argsort(of, kind="stable")
    of = of[order]
    edge = np.flatnonzero(np.diff(of, prepend=-1, append=-1)) if len(of) else np.zeros(0, np.int64)
    for a, b in zip(edge, edge[1:]):
        part = order[a:b]
        yield int(of[a]), keys[part], None if counts is None else counts[part]


def _buckets(kind: int, keys: np.ndarray, depth: int, n: int) -> np.ndarray:
    """Strings go by their two nearest context bytes, words by their hash."""
    source = keys >> np.uint64(8 * (depth - 1)) if kind == 0 else keys
    return (mix(source) >> np.uint64(20)).astype(np.int64) % n + kind * n


def count(docs: DataFrame, depth: int, n: int) -> DataFrame:
    """(text) → bucket, keys, counts: strings and words of all texts, one row per bucket."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        for batch in batches(source):
            texts = _texts(batch)
            for kind, keys in enumerate((strings(texts, depth)[0], word_hashes(texts)[0])):
                k, c = tallied(keys)
                found[kind] = tallied(np.concatenate([found[kind][0], k]), np.concatenate([found[kind][1], c]))
        for kind, (keys, counts) in enumerate(found):
            rows = list(_dealt(keys, _buckets(kind, keys, depth, n), counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in rows], pa.int32()), pa.array([k.tobytes() for _, k, _ in rows], pa.binary()),
                 pa.array([c.astype(np.int64).tobytes() for _, _, c in rows], pa.binary())], names=["bucket", "keys", "counts"],
            )

    def add(table: pa.Table) -> pa.Table:
        keys, counts = tallied(*_joined(table))
        return pa.table({"bucket": table["bucket"][:1], "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(
        add, "bucket int, keys binary, counts binary"
    )


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(k.as_buffer(), np.uint64) for k in table["keys"]]
    counts = [np.frombuffer(c.as_buffer(), np.int64) for c in table["counts"]]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([none[0], *keys]), np.concatenate([none[1], *counts])


def top_levels(counted: DataFrame, depth: int, n: int) -> list[Level]:
    """Levels 1 and 0: their counts, and the weights that the subtrees below hand up."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            table = pa.Table.from_batches([batch])
            for i in range(len(table)):
                levels = tree(*_joined(table[i:i + 1]), depth, 2)
                last = levels[-1]
                keys, counts = _joined(table[i:i + 1])
                near, counts = tallied(keys >> np.uint64(8 * depth) << U8 | keys & np.uint64(255), counts)
                up, weights = tallied(last.keys >> np.uint64(16) << U8 | last.keys & np.uint64(255), last.weighted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * len(near) + [1] * len(up), pa.int32()), pa.array(np.concatenate([near, up]).astype(np.int64)),
                     pa.array(np.concatenate([counts.astype(float), weights]))], names=["kind", "key", "value"],
                )

    rows = counted.where(F.col("bucket") < n).mapInArrow(run, "kind int, key long, value double").groupBy("kind", "key").agg(F.sum("value").alias("value")).toPandas()
    rows = rows.sort_values(["kind", "key"])
    part = [rows[rows["kind"] == k] for k in (0, 1)]
    keys, counts = part[0]["key"].to_numpy(np.uint64), part[0]["value"].to_numpy().astype(np.int64)
    one = Level(keys, counts, None)
    one.weigh(one.weighted, part[1]["value"].to_numpy(float))
    zero = Level(*tallied(keys & np.uint64(255), counts), one)
    return [one, zero]


def score(docs: DataFrame, training: DataFrame, depth: int = 5) -> DataFrame:
    """(doc_id, text), (text) → doc_id, n_bytes, score, n_tokens, n_known, train_tokens, base_score.

    Texts are lower-cased (A-Z). ``score`` is the log10 probability of the
    bytes and the end of the text under the tree; ``-score / n_bytes *
    log2(10)`` is the code length in bits per byte. ``base_score`` is that of
    its words and one end under add-one counts. Null counts as empty, and an
    empty text has one byte and one token, its end. Without training texts
    every bit has chance one half. One row comes back for each row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = total_chars(docs)
    n = max(2 * width(docs.sparkSession), chars >> 22, 1)
    counted = stored(count(training, depth, n))
    top = top_levels(counted, depth, n)
    ends = training.count()
    sizes = counted.where(F.col("bucket") >= n).agg(F.sum(F.expr("octet_length(keys) div 8"))).first()[0] or 0

    def total(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(c.as_buffer(), np.int64).sum()) for c in batch["counts"]], pa.int64())], names=["n"])

    tokens = ends + (counted.where(F.col("bucket") >= n).select("counts").mapInArrow(total, "n long").agg(F.sum("n")).first()[0] or 0)
    kinds = sizes + (ends > 0)
    rows = blocked(docs, chars, per_partition=1).select("_block", "doc_id", "text")

    def in_order(table: pa.Table) -> pa.Table:
        return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])

    def send(table: pa.Table) -> pa.Table:
        out = []
        for kind, keys in enumerate(_distinct(_texts(table), depth)):
            out += [(b, k) for b, k, _ in _dealt(keys, _buckets(kind, keys, depth, n))]
        return pa.table({
            "block": pa.array([table["_block"][0].as_py()] * len(out), pa.int32()),
            "bucket": pa.array([b for b, _ in out], pa.int32()), "asked": pa.array([k.tobytes() for _, k in out], pa.binary()),
        })

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, counts = _joined(known)
        parts = [np.frombuffer(k.as_buffer(), np.uint64) for k in asked["asked"]]
        if not parts:
            return pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "values": pa.array([], pa.binary())})
        distinct = tallied(np.concatenate(parts))[0]
        if asked["bucket"][0].as_py() < n:
            value = log_chance(distinct, depth, tree(keys, counts, depth, 2), top).astype(np.float32)
        else:
            value = np.zeros(len(distinct), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                value = np.where(keys[at] == distinct, counts[at], 0)
        return pa.table({
            "block": asked["block"], "bucket": asked["bucket"],
            "values": pa.array([value[np.searchsorted(distinct, p)].tobytes() for p in parts], pa.binary()),
        })

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_order(table)
        texts = _texts(table)
        got = dict(zip(answers["bucket"].to_pylist(), answers["values"].to_pylist()))

        known = []
        for kind, (keys, dtype) in enumerate(zip(_distinct(texts, depth), (np.float32, np.int64))):
            of = _buckets(kind, keys, depth, n)
            values = np.zeros(len(keys), dtype)
            if len(keys):
                values[np.argsort(of, kind="stable")] = np.concatenate([np.frombuffer(got.pop(int(b)), dtype) for b in np.unique(of)])
            known.append((keys, values))
        scale = np.log10(tokens + kinds + 1.0)
        out = []
        for part in runs(texts, 1 << 21):
            keys, places = strings(part, depth)
            logs = _looked_up(keys, *known[0])
            words, per_doc = word_hashes(part)
            c = _looked_up(words, *known[1])
            text, doc = np.repeat(np.arange(len(part)), places), np.repeat(np.arange(len(part)), per_doc)
            out.append((
                places, np.bincount(text, logs, len(part)), per_doc + 1, np.bincount(doc, c > 0, len(part)).astype(np.int64) + (ends > 0),
                np.full(len(part), tokens), np.bincount(doc, np.log10(c + 1.0) - scale, len(part)) + np.log10(ends + 1.0) - scale,
            ))
        names = ("n_bytes", "score", "n_tokens", "n_known", "train_tokens", "base_score")
        return pa.table({"doc_id": table["doc_id"]} | {name: pa.array(np.concatenate(x)) for name, x in zip(names, zip(*out))})

    asked = rows.groupBy("_block").applyInArrow(send, "block int, bucket int, asked binary")
    answers = asked.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(answer, "block int, bucket int, values binary")
    return rows.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, "doc_id long, n_bytes long, score double, n_tokens long, n_known long, train_tokens long, base_score double"
    )
