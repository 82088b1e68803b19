"""Near-duplicate detection: 64-bit SimHash, joined by covering locality-sensitive hashing.

For radius r every bit position gets a random vector of r + 1 bits. Each of the
2**(r+1) - 1 nonzero vectors v gives a mask: the positions whose vector is
not orthogonal to v. Two fingerprints that differ in r bits or fewer agree under at
least one mask: r vectors cannot span r + 1 dimensions, so some v is orthogonal
to all vectors where they differ. So all pairs within the radius meet in some
table; no link is lost.

Only distinct fingerprints take part, one row each. A bucket with too many of
them is divided again by masks over the bits that its own mask left free, until
it is small; a bucket of n free bits holds 2**n fingerprints at most. Inside a
bucket only edges of a spanning forest come out, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotflow.llm.common import as_bytes, batches, stored
from spotflow.operators.graphs import connected_components


def fingerprint(text: bytes, size: int) -> int:
    """SimHash of word shingles in lower case (A-Z only), repeats included; 0 without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)])) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):  # long texts in parts
        part = hashes[a:a + (1 << 14)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text) → doc_id, text_hash, fingerprint as a signed long. A null text has no words."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            made = np.array([fingerprint(t, size) for t in as_bytes(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(made)], names=["doc_id", "text_hash", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, fingerprint long"
    )


def masks(radius: int, seed: int) -> list[int]:
    """The covering masks of 64 bits, as signed longs."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), 64)
    out = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i, x in enumerate(vectors.tolist()) if (v & x).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _divided(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """(id, fingerprint, free, bucket): each row once per mask, by the free bits under the mask."""
    tables = F.array(*[F.lit(m) for m in masks(radius, 1000 + level)])
    split = rows.select("id", "fingerprint", "free", "bucket", F.posexplode(tables).alias("t", "m"))
    return split.select(
        "id", "fingerprint",
        F.col("free").bitwiseAND(F.bitwise_not("m")).alias("free"),
        F.xxhash64("bucket", "t", F.col("fingerprint").bitwiseAND(F.col("free")).bitwiseAND(F.col("m"))).alias("bucket"),
    )


def _forest(ids: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges within the radius that connect all that is connected in a bucket."""
    edges, left = [], np.arange(len(ids))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):  # breadth first: what is near the front joins it
            found = np.zeros(len(left), bool)
            for i in front:
                near = np.flatnonzero((np.bitwise_count(prints[left] ^ prints[i]) <= radius) & ~found)
                found[near] = True
                edges += [(int(ids[i]), int(ids[j])) for j in left[near]]
            front, left = left[found], left[~found]
    return edges


def links(prints: DataFrame, radius: int = 3, most: int = 2048) -> DataFrame:
    """(id, fingerprint), fingerprints distinct → (a, b): edges that connect what lies within the radius."""
    def edges(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for members in batch["members"]:
                ids = members.values.field("id").to_numpy()
                out += _forest(ids, members.values.field("fingerprint").to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"]
            )

    open_ = prints.select("id", "fingerprint", F.lit(-1).cast("long").alias("free"), F.lit(0).cast("long").alias("bucket"))
    found = None
    for level in range(7):
        rows = _divided(open_, radius, level)
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = stored(rows.join(sizes, "bucket"))
        small = rows.where(F.col("n") <= most).groupBy("bucket").agg(F.collect_list(F.struct("id", "fingerprint")).alias("members"))
        part = stored(small.select("members").mapInArrow(edges, "a long, b long").distinct())
        found = part if found is None else found.union(part)
        open_ = rows.where(F.col("n") > most).select("id", "fingerprint", "free", "bucket")
        if open_.isEmpty():
            return found
    raise ValueError("a bucket without free bits holds distinct fingerprints")


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """(doc_id, text) → doc_id, text_hash, fingerprint, component_id; one row for each row.

    ``fingerprint`` is a signed long, ``component_id`` the smallest doc_id that
    links reach, a link being ``radius`` differing bits or fewer. Texts without
    words (null, empty) have fingerprint zero and link like any other. A null
    doc_id is reached but never the smallest, unless all of its component are
    null. Repeated rows are repeated in the result.
    """
    return components(stored(fingerprints(docs, size)), radius)


def roots(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Each distinct fingerprint and the root of its component, itself a fingerprint."""
    # a fingerprint is its own id among links; only at the end doc_ids take part
    one = stored(prints.select("fingerprint").distinct())
    pairs = links(one.select(F.col("fingerprint").alias("id"), "fingerprint"), radius)
    found = connected_components(pairs).select(F.col("member").alias("fingerprint"), "root")
    return one.join(found, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint) → the same columns and component_id."""
    one = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).select("fingerprint", "first")
    # a fingerprint is its own id among links; only at the end doc_ids take part
    one = stored(one)
    pairs = links(one.select(F.col("fingerprint").alias("id"), "fingerprint"), radius)
    roots = connected_components(pairs).select(F.col("member").alias("fingerprint"), "root")
    rooted = one.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(*prints.columns, "component_id")


def keep_one(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """The whole rows that stay: of each component the one of smallest doc_id (null last), then smallest text hash.

    Rows alike in doc_id and text stay or go together.
    """
    found = near_duplicates(docs, radius, size)
    group = F.struct(F.col("component_id").isNull().alias("n"), "component_id")
    stays = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))).alias("s"))
    stays = stays.select("s._d", "s._h")
    same = docs["doc_id"].cast("long").eqNullSafe(stays["_d"]) & F.xxhash64(docs["text"]).eqNullSafe(stays["_h"])
    return docs.join(stays, same, "left_semi")
