"""Near copies: SimHash links, and all pairs whose word shingles have a Jaccard similarity of 0.8 or more.

The bits of a SimHash tell little about a Jaccard similarity of 0.8 (some ten of
64 bits differ, and 13 or more often enough), so those pairs are found by
MinHash: BANDS bands of ROWS minima each. A pair at 0.8 shares no band with a
chance of (1 - 0.8**ROWS)**BANDS, about one in eight million; a pair above it
with less.

Sets that are equal take part once. Sets that share bands, directly or by way of
others, make a cluster; its whole sets meet in one task, or in blocks two by two
where they are large, and only the edges of a spanning forest come out: never
the pairs that share a band, and never two sets in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotflow.llm.common import as_bytes, batches, discard, mix, release, stored, trim, width
from spotflow.llm.simhash import fingerprint, roots
from spotflow.operators.graphs import connected_components

BANDS, ROWS = 40, 5
_made = np.random.default_rng(8).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_turns, _factors = _made[0], _made[1] | np.uint64(1)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles in lower case (A-Z only); a shorter text is one shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)])) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(hashes), 1 << 10):
        np.minimum(least, ((hashes[a:a + (1 << 10), None] ^ _turns) * _factors).min(0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One number for each band."""
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = mix(mix(out) + column)
    return out.view(np.int64)


def signatures(docs: DataFrame, size: int = 5, print_size: int = 3) -> DataFrame:
    """(doc_id, text) → doc_id, text_hash, fingerprint (of op5's shingles), key of the shingle set, bands."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches(source):
            texts = as_bytes(batch["text"])
            sets = [shingle_set(t, size) for t in texts]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            prints = np.array([fingerprint(t, print_size) for t in texts], np.uint64).view(np.int64)
            made = [bands(minima(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(prints), pa.array(keys), pa.array(made, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "fingerprint", "key", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, fingerprint long, key long, bands array<long>"
    )


def forest(ends: np.ndarray, hashes: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Edges between sets of such a similarity that connect all that such links connect.

    Set i is ``hashes[ends[i]:ends[i + 1]]``. Sets are reached one after another, and the
    hashes of each are looked up among the sets not reached yet, which counts what it
    shares with all of them at once.
    """
    n, size = len(ends) - 1, np.diff(ends)
    order = np.argsort(hashes, kind="stable")
    who = np.repeat(np.arange(n), size)[order]
    run = np.cumsum(np.diff(hashes[order], prepend=hashes[order[:1]]) != 0)
    run_of = np.empty(len(hashes), np.int64)
    run_of[order] = run
    n_runs = int(run[-1]) + 1 if len(run) else 0
    left, open_, listed, one, two = np.ones(n, bool), n, 2 * n + 1, [], []
    for start in range(n):
        if not left[start]:
            continue
        left[start], front = False, [start]
        open_ -= 1
        while front and open_:
            if 2 * open_ < listed:  # forget the sets reached
                stays = left[who]
                who, run, listed = who[stays], run[stays], open_
                count = np.bincount(run, minlength=n_runs)
                begin = np.cumsum(count) - count
            i = front.pop()
            own = run_of[ends[i]:ends[i + 1]]
            own = own[count[own] > 0]
            c = count[own]
            at = np.repeat(begin[own] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            both = np.bincount(who[at], minlength=n)
            near = np.flatnonzero(left & (both > 0) & (100 * both >= percent * (size + size[i] - both))).tolist()
            left[near] = False
            open_ -= len(near)
            front += near
            one += [i] * len(near)
            two += near
    return one, two


def _groups(source: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows that follow each other with equal values in these columns; one group is held at a time."""
    held, last = [], None
    for batch in source:
        values = [np.asarray(batch[c]) for c in names]
        new = np.any([v[1:] != v[:-1] for v in values], axis=0)
        for a, b in zip(edges := [0, *(np.flatnonzero(new) + 1), batch.num_rows], edges[1:]):
            if b > a:
                this = tuple(v[a] for v in values)
                if held and this != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = this
    if held:
        yield pa.Table.from_batches(held)


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """(unit, i, j, key, hashes) → edges (a, b) inside each (unit, i, j)."""
    names = ["unit", "i", "j"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for group in _groups(source, names):
            keys, sets = np.asarray(group["key"]), group["hashes"].combine_chunks()
            ends = np.concatenate([[0], np.cumsum(np.asarray(sets.value_lengths()))])
            one, two = forest(ends, np.asarray(sets.flatten()), percent)
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(keys[one]), pa.array(keys[two])], names=["a", "b"])
        trim()

    return rows.repartition(width(rows.sparkSession), *names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long")


def hooked(shared: DataFrame) -> DataFrame:
    """(band, key, least) → edges (a, b) that connect what shares bands: a key with the least of its bands' least keys, and that with the others.

    Keys of one large group have few such least keys in common, so a key gives about one edge, not one for each band.
    """
    first = shared.groupBy("key").agg(F.min("least").alias("a"))
    others = shared.select("key", "least").distinct().join(first, "key").select("a", F.col("least").alias("b"))
    return first.select("a", F.col("key").alias("b")).union(others).where("a <> b").distinct()


def jaccard_links(shared: DataFrame, texts: DataFrame, size: int = 5, percent: int = 80, most: int = 1 << 20, spread: int = 16) -> DataFrame:
    """Edges (a, b) between keys that connect all sets of such a similarity.

    ``shared`` has band, key and the least key of the band; ``texts`` one text (key, text)
    of each key. Clusters are cut into blocks of about ``most`` shingles, and blocks meet two
    by two; a cluster of more than ``spread`` blocks is taken band by band.
    """
    def sets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            made = [shingle_set(t, size).view(np.int64) for t in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(made, pa.list_(pa.int64()))], names=["key", "hashes"])

    held = stored(texts.select("key", "text").mapInArrow(sets, "key long, hashes array<long>"))
    weights = held.select("key", F.size("hashes").alias("w"))

    def cut(members: DataFrame) -> DataFrame:
        n = members.groupBy("unit").agg(F.ceil(F.sum("w") / most).cast("int").alias("blocks"))
        return members.join(n, "unit")

    clusters = connected_components(hooked(shared))
    whole = stored(cut(clusters.select(F.col("member").alias("key"), F.col("root").alias("unit")).join(weights, "key")))
    of_band = whole.where(F.col("blocks") > spread).select("key", "w", "unit").join(shared.select("key", "band"), "key")
    by_band = cut(of_band.select("key", "w", F.xxhash64("unit", "band").alias("unit")))
    parts = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: (F.col("blocks") == 1) | (t != F.col("block")))
    placed = (
        whole.where(F.col("blocks") <= spread).unionByName(by_band, allowMissingColumns=False)
        .withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
        .select("unit", "key", "block", F.explode(parts).alias("t"))
        .select("unit", F.least("block", "t").alias("i"), F.greatest("block", "t").alias("j"), "key")
    )
    found = stored(_linked(placed.join(held, "key"), percent).distinct())
    discard(held)
    return found


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, radius: int = 3, print_size: int = 3) -> DataFrame:
    """The whole rows that stay: of each component the one of smallest doc_id (null last), then smallest text hash.

    Links are Jaccard similarities of ``percent`` or more over word shingles of
    ``size``, and fingerprints within ``radius`` bits. Rows alike in doc_id and
    text stay or go together.
    """
    signed = stored(signatures(docs, size, print_size))
    chosen = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    same = lambda x, y: x["doc_id"].cast("long").eqNullSafe(y["_d"]) & F.xxhash64(x["text"]).eqNullSafe(y["_h"])
    rows = signed.groupBy("key").agg(F.first("bands").alias("bands")).select("key", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).where("n > 1")
    shared = stored(rows.join(sizes, "band").select("band", "key", "least"))
    met = signed.join(shared.select("key").distinct(), "key", "left_semi")
    of_key = stored(met.groupBy("key").agg(F.min(chosen).alias("s")).select("key", "s._d", "s._h"))
    plain = docs.select(F.col("doc_id"), F.col("text"))  # whatever the other columns are called
    texts = stored(plain.join(of_key, same(plain, of_key)).select("key", "text").dropDuplicates(["key"]))
    by_print = stored(signed.join(roots(signed, radius), "fingerprint").groupBy("root", "key").agg(F.lit(1).alias("_")).select("root", "key"))
    stars = by_print.join(by_print.groupBy("root").agg(F.min("key").alias("a")), "root").where("key <> a").select("a", F.col("key").alias("b"))
    edges = stored(jaccard_links(shared, texts, size, percent).union(stars))
    classes = connected_components(edges).select(F.col("member").alias("key"), "root")
    placed = signed.join(classes, "key", "left").withColumn("root", F.coalesce("root", "key"))
    stays = placed.groupBy("root").agg(F.min(chosen).alias("s")).select("s._d", "s._h")
    return docs.join(stays, same(docs, stays), "left_semi")
