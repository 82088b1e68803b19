"""Benchmark decontamination: latent semantic retrieval, then an exact look at what it finds.

Passages are rows of a TF-IDF matrix over hashed words. A randomised SVD gives
the leading directions of that matrix: every passage of every document is added, with random
signs, to three of a few hundred rows, and the singular vectors of these are taken. All windows of all documents are compared with the benchmark items by
cosine in this space. A pair that passes is settled by the longest common
subsequence of words, and for paraphrases by the item's answer, its last
sentence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotflow.llm.common import as_bytes, batches, byte_sums, mix, release, spans, stored, word_bounds

FEATURES = 1 << 15
#: Words of a step between windows; words of a passage that trains the space.
STEP, PASSAGE = 8, 64
#: Longest item part in steps; longer items are compared part by part.
PARTS = 16
_plain = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalised(text: bytes) -> bytes:
    """Lower case A-Z; ASCII that is no letter or digit becomes blank."""
    return text.translate(_plain)


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Feature of each word, words per text, and the normalised buffer with word bounds."""
    buf = normalised(b" ".join(texts))
    start, end = word_bounds(buf)
    hashes = mix(spans(byte_sums(buf), start, end) + (end - start).astype(np.uint64))
    counts = np.diff(np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    return (hashes >> np.uint64(49)).astype(np.int64), counts, buf, start, end


def _summed(rows: DataFrame, width: int, kind) -> np.ndarray:
    """(part, values) → the sums of the binary arrays of each part, one after the other."""
    def add(table: pa.Table) -> pa.Table:
        wide = np.int64 if kind is np.int64 else np.float64
        total = sum(np.frombuffer(v.as_buffer(), kind).astype(wide) for v in table["values"])
        return pa.table({"part": table["part"][:1], "values": pa.array([total.astype(kind).tobytes()], pa.binary())})

    out = np.zeros(FEATURES * width, kind)
    got = {r["part"]: r["values"] for r in rows.groupBy("part").applyInArrow(add, "part int, values binary").collect()}
    size = len(out) // max(1, len(got))
    for i, part in enumerate(sorted(got)):  # a fixed number of parts
        out[i * size:(i + 1) * size] = np.frombuffer(got[part], kind)
    return out.reshape(-1, width)


def _parts(total: np.ndarray, kind, parts: int = 64) -> Iterator[pa.RecordBatch]:
    """The parts one by one, so that neither side holds a second copy of the whole."""
    for i, piece in enumerate(np.split(np.ascontiguousarray(total, kind), parts)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["part", "values"])


def inverse_frequencies(docs: DataFrame, hashed: DataFrame) -> np.ndarray:
    """log(1 + documents / (1 + documents with the feature)), over all documents."""
    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(FEATURES, np.int64)
        for batch in source:
            for features, counts in zip(batch["features"], batch["counts"]):
                feature, counts = np.frombuffer(features.as_buffer(), np.uint16), np.frombuffer(counts.as_buffer(), np.int32)
                keys = np.sort(np.repeat(np.arange(len(counts)), counts) * FEATURES + feature)
                if len(keys):
                    total += np.bincount(keys[np.append(True, keys[1:] != keys[:-1])] % FEATURES, minlength=FEATURES)
        yield from _parts(total, np.int64)

    found = _summed(hashed.mapInArrow(count, "part int, values binary"), 1, np.int64)[:, 0]
    return np.log1p(docs.count() / (1 + found))


def _passages(feature: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of passages of PASSAGE words; rows have length one."""
    at = np.arange(len(feature)) - np.repeat(np.cumsum(counts) - counts, counts)
    row = np.cumsum(at % PASSAGE == 0) - 1
    value = weights[feature]
    norm = np.sqrt(np.bincount(row, value * value)) if len(row) else np.zeros(0)
    return row, feature, value / np.maximum(norm[row], 1e-9)


def _hashed(docs: DataFrame) -> DataFrame:
    """The features of all words of all texts, two bytes each, and the words of each text."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1 << 20):
            feature, counts, *_ = _features(as_bytes(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([feature.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts.astype(np.int32).tobytes()], pa.binary())],
                names=["features", "counts"],
            )

    return stored(docs.select("text").mapInArrow(run, "features binary, counts binary"))


def _sketch(feature: np.ndarray, counts: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
    """Adds every passage, with random signs, to three random rows of ``total``."""
    row, feature, value = _passages(feature, counts, weights)
    if not len(row):
        return
    rng = np.random.default_rng(zlib.crc32(feature.tobytes()))
    for _ in range(3):
        place, sign = rng.integers(0, len(total), row[-1] + 1), rng.choice((-1.0, 1.0), row[-1] + 1)
        np.add.at(total.reshape(-1), place[row] * FEATURES + feature, (sign[row] * value).astype(total.dtype))


def latent_space(docs: DataFrame, items: list[bytes], weights: np.ndarray, dimensions: int = 96,
                 wide: int = 256, hashed: DataFrame | None = None) -> np.ndarray:
    """Leading right singular vectors (features x dimensions) of the passages of all documents and of the items.

    Every passage is added to three of ``wide`` rows, so one pass over all documents gives
    random combinations of them, whose singular vectors are taken. The items count as much as the
    documents together, so that the space can tell them apart. ``hashed``: what :func:`_hashed` made of the documents.
    """
    release()  # the driver keeps no tables of earlier stages
    hashed = _hashed(docs) if hashed is None else hashed
    size = hashed.agg(F.coalesce(F.sum(F.octet_length("features")), F.lit(0))).first()[0]
    few = hashed.coalesce(max(1, min(256, size >> 24)))  # each task hands in a matrix of the sketch's size

    def combine(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros((wide, FEATURES), np.float32)
        for batch in source:
            for features, counts in zip(batch["features"], batch["counts"]):
                _sketch(np.frombuffer(features.as_buffer(), np.uint16).astype(np.int64), np.frombuffer(counts.as_buffer(), np.int32), weights, total)
        yield from _parts(total.reshape(-1), np.float32)

    both = np.zeros((2 * wide, FEATURES), np.float32)
    both[:wide] = _summed(few.mapInArrow(combine, "part int, values binary"), wide, np.float32).reshape(wide, FEATURES)
    feature, counts, *_ = _features(items)
    _sketch(feature, counts, weights, both[wide:])
    of_docs, of_items = (np.linalg.norm(part @ part.T) for part in (both[:wide], both[wide:]))
    if of_docs and of_items:
        both[wide:] *= np.sqrt(of_docs / of_items)
    values, turn = np.linalg.eigh((both @ both.T).astype(np.float64))
    first = np.argsort(-values)[:dimensions]
    kept = first[values[first] > max(values[first[0]], 1e-9) * 1e-9]  # fewer where the texts have fewer directions
    space = np.zeros((FEATURES, dimensions), np.float32)
    space[:, :len(kept)] = both.T @ (turn[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    return space


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence; one machine word per 64 words of ``a``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if m := where.get(x):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def answer(text: str) -> str:
    """The last sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text or "") if normalised(p.encode()).split()]
    return parts[-1] if parts else ""


@dataclass
class Items:
    """A block of benchmark items in the latent space. Parts of an item are compared on their own."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    owner: np.ndarray
    steps: np.ndarray
    vectors: np.ndarray
    short: np.ndarray
    holds: np.ndarray  # one bit for each feature
    sizes: np.ndarray


def _items(rows: list, space: np.ndarray) -> Items:
    words = [normalised((r["text"] or "").encode()).split() for r in rows]
    answers = [normalised(answer(r["text"]).encode()).split() for r in rows]
    owner, steps, vectors, sizes, holds = [], [], [], [], []
    for i, w in enumerate(words):
        n = -(-len(w) // (STEP * PARTS)) or 1
        for part in np.array_split(np.arange(len(w)), n):
            if len(part):
                feature = _features([b" ".join(w[part[0]:part[-1] + 1])])[0]
                vector = space[feature].sum(0)
                sizes.append(len(part))
                holds.append(np.packbits(np.bincount(feature, minlength=FEATURES) > 0))
                owner.append(i)
                steps.append(max(1, min(PARTS, round(len(part) / STEP))))
                vectors.append(vector / max(np.linalg.norm(vector), 1e-9))
    return Items([r["item_id"] for r in rows], words, answers, np.array(owner, np.int64), np.array(steps, np.int64),
                 np.array(vectors, np.float32).reshape(-1, space.shape[1]), np.array([len(words[i]) < STEP for i in owner], bool),
                 np.array(holds, np.uint8).reshape(-1, FEATURES // 8), np.array(sizes, np.int64))


def _candidates(feature: np.ndarray, counts: np.ndarray, items: Items, space: np.ndarray, cosine: float, share: float):
    """(first word, item, steps) of windows near an item part.

    A common subsequence of a share of the part's words needs as many words of
    the window, or a step on either side, that the part has; windows with
    fewer are left out.
    """
    if not len(feature) or not len(items.steps):
        return
    first = np.cumsum(counts) - counts
    at = np.arange(len(feature)) - np.repeat(first, counts)
    edge = np.flatnonzero(at % STEP == 0)
    size = np.diff(np.append(edge, len(feature)))
    segment = space[feature[edge]]
    for k in range(1, STEP):  # whole rows at a time; the last step of a text may be short
        full = np.flatnonzero(size > k)
        segment[full] += space[feature[edge[full] + k]]
    ends = first + counts
    doc = np.repeat(np.arange(len(counts)), counts)[edge]
    window = np.zeros_like(segment)
    for steps in range(1, int(items.steps.max()) + 1):
        # add the next step where it belongs to the same text
        k = steps - 1
        window[:len(window) - k] += segment[k:]
        other = np.flatnonzero(doc[k:] != doc[:len(doc) - k])
        window[other] -= segment[other + k]
        own = np.flatnonzero(items.steps == steps)
        if len(own):
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), np.float32(1e-9))
            least = cosine * np.where(items.short[own], 0.5, 1.0)  # a short item fills only part of its window
            near = window @ (items.vectors[own] / least[:, None].astype(np.float32)).T >= norm[:, None]
            found, part = np.divmod(np.flatnonzero(near), len(own))
            for k in range(0, len(found), 20_000):
                w, i = found[k:k + 20_000], own[part[k:k + 20_000]]
                place = edge[w][:, None] + np.arange(-STEP, (steps + 1) * STEP)
                inside = (place >= first[doc[w]][:, None]) & (place < ends[doc[w]][:, None])
                seen = feature[np.clip(place, 0, len(feature) - 1)]
                held = items.holds[i[:, None], seen >> 3] >> (7 - (seen & 7)).astype(np.uint8) & 1
                hits = (held.astype(bool) & inside).sum(1)
                enough = hits >= np.where(items.short[i], 1.0, share) * items.sizes[i] - 1e-9
                yield from zip(edge[w[enough]].tolist(), items.owner[i[enough]].tolist(), [steps] * int(enough.sum()))


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.5, same: float = 0.8, alike: float = 0.6,
          dimensions: int = 96, block: int = 2000, fit_docs: int | None = None) -> DataFrame:
    """(doc_id, text), (item_id, text) → doc_id, text_hash, item_id, overlap, with_answer: items that a document holds.

    ``overlap`` is the longest common subsequence of the item's words and those
    of the window (with a step on either side) over the item's words. A pair is
    a leak at ``same``, or at ``alike`` if the window also has 0.8 of the
    answer's words in order. Items of fewer than 8 words must be there word for
    word. Null and empty texts and items match nothing; repeated rows are
    repeated. Items take part in blocks, each of which passes over all
    documents. All documents make the space; ``fit_docs``: about so many of them, if a caller wants that.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    hashed = _hashed(docs)
    weights = inverse_frequencies(docs, hashed)
    if fit_docs:
        step = max(1, docs.count() // fit_docs)
        hashed = _hashed(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0))
    blocks = -(-bench.count() // block) or 1
    out = None
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        space = latent_space(docs, [(r["text"] or "").encode() for r in rows], weights, dimensions, hashed=hashed)
        space *= weights[:, None].astype(np.float32)
        sent = spark.sparkContext.broadcast((space, _items(rows, space)))

        def search(source: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            space, items = sent.value
            for batch in batches(source, 1 << 20):
                ids, hashes = batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist()
                feature, counts, buf, start, end = _features(as_bytes(batch["text"]))
                edges = np.cumsum(counts)
                best: dict[tuple[int, int], tuple[float, bool]] = {}
                for word, item, steps in _candidates(feature, counts, items, space, cosine, alike):
                    d = int(np.searchsorted(edges, word, side="right"))
                    if best.get((d, item), (0.0,))[0] == 1.0:
                        continue
                    a = max(int(edges[d] - counts[d]), word - STEP)
                    z = min(int(edges[d]), word + (steps + 1) * STEP)
                    region = buf[start[a]:end[z - 1]].split()
                    own = items.words[item]
                    if len(own) > STEP * PARTS:  # a long item: the text around as long as the item
                        a, z = max(int(edges[d] - counts[d]), word - len(own)), min(int(edges[d]), word + len(own) + STEP)
                        region = buf[start[a]:end[z - 1]].split()
                    if len(own) < 8:
                        ok = b" " + b" ".join(own) + b" " in b" " + b" ".join(region) + b" "
                        ratio, with_answer = float(ok), ok
                    else:
                        present = set(region)
                        if sum(w in present for w in own) < alike * len(own):
                            continue
                        ratio = common_subsequence(own, region) / len(own)
                        last = items.answers[item]
                        with_answer = bool(last) and common_subsequence(last, region) >= 0.8 * len(last)
                    if ratio >= same or ratio >= alike and with_answer:
                        best[d, item] = max(best.get((d, item), (0.0, False)), (ratio, with_answer))
                found = sorted(best.items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for (d, _), _ in found], pa.int64()), pa.array([hashes[d] for (d, _), _ in found], pa.int64()),
                     pa.array([items.ids[i] for (_, i), _ in found], pa.int64()),
                     pa.array([r for _, (r, _) in found], pa.float64()), pa.array([w for _, (_, w) in found], pa.bool_())],
                    names=["doc_id", "text_hash", "item_id", "overlap", "with_answer"],
                )

        part = docs.mapInArrow(search, "doc_id long, text_hash long, item_id long, overlap double, with_answer boolean")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The whole rows without any leak, by the rules of :func:`leaks`; rows alike in doc_id and text go together."""
    found = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["_d"]) & (F.xxhash64(docs["text"]) == found["_h"])
    return docs.join(found, same, "left_anti")
