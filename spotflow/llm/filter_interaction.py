"""What the order of filters changes: for every order, what each filter removes that no earlier one did.

Removal ranks are a min-plus product. A document's mask has 0 for each filter that
it fails and infinity elsewhere; the position matrix has, for each filter and order,
the step at which the filter comes (the inverse of the permutation). Mask plus
position, minimised over the filters, is the step that removes the document.

Documents with the same mask share their ranks, so they are counted by part and
mask first; the ranks of all masks then scatter these counts over the steps. What
is counted per part is at most one row for each mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotflow.llm.common import as_bytes, batches, stored

FILTERS = "ABCDE"
_marks = np.zeros(256, bool)
_marks[list(b"#$%&*|")] = True


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()
    out = len(words) < 100
    out |= (100 * len(set(words)) < 80 * len(words)) << 1
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out |= int(100 * seen[65:91].sum() > 10 * (len(text) - seen[128:192].sum())) << 2
    return out | int(seen[_marks].any()) << 3


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) → doc_id, part, digest of the text, mask of the filters that look at the text alone."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches(source):
            texts = as_bytes(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["part"], pa.array([sha256(t).digest() for t in texts], pa.binary()),
                 pa.array([text_mask(t) for t in texts], pa.int32())],
                names=["doc_id", "part", "digest", "mask"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
    ).mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by part and mask: part, mask, docs, good, toxic.

    Filter E fails a document whose whole text a smaller doc_id has, anywhere in the
    table. A null doc_id is neither smaller nor greater than any, and has no label.
    Where ``labels`` has a document several times, one row with the value is enough.
    """
    rows = stored(text_masks(docs))
    # only texts that occur under several ids can fail E; of those the smallest id is looked up
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("digest", "lo")
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("toxic")
    )
    copied = F.when(F.col("doc_id") > F.col("lo"), 1 << FILTERS.index("E")).otherwise(0)
    return (
        rows.join(least, "digest", "left").join(flags, "doc_id", "left")
        .groupBy("part", (F.col("mask") + copied).alias("mask"))
        .agg(F.count(F.lit(1)).alias("docs"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])
    )


def removal_ranks(n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders (orders x steps), and the step at which each mask falls (masks x orders; n_filters: never)."""
    orders = np.array(list(permutations(range(n_filters))), np.int64)
    position = np.argsort(orders, axis=1)  # of each filter in each order
    fails = np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1
    cost = np.where(fails, 0, n_filters)  # n_filters is as good as infinity
    return orders, np.minimum((cost[:, None, :] + position[None]).min(2), n_filters)


def interaction(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, mask, docs, good, toxic) → part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, order and step. ``kept``: documents left after the step;
    ``removed`` by it; ``redundant``: fail its filter, but went before;
    ``unique_fails``: fail its filter only; ``good_lost``, ``toxic_lost``: among the
    removed; ``shapley``: what the filter removes, summed over all orders.
    A part without documents has no rows. ``mask`` has one bit for each letter of ``filters``.
    """
    n = len(filters)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, ranks = removal_ranks(n)
        fails = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool)
        by_step = ranks[:, :, None] == np.arange(n)  # mask, order, step
        late = fails[:, orders] & (ranks[:, :, None] < np.arange(n))
        names = np.array(["".join(filters[i] for i in o) for o in orders])
        for batch in source:
            for part, rows in zip(batch["part"].to_pylist(), batch["rows"]):
                mask = rows.values.field("mask").to_numpy()
                weight = np.zeros((3, 1 << n), np.int64)
                for w, c in zip(weight, ("docs", "good", "toxic")):
                    np.add.at(w, mask, rows.values.field(c).to_numpy())
                gone = np.einsum("wm,mos->wos", weight, by_step.astype(np.int64))
                redundant = np.einsum("m,mos->os", weight[0], late.astype(np.int64))
                unique = weight[0][1 << np.arange(n)]
                shapley = np.bincount(orders.ravel(), gone[0].ravel(), n).astype(np.int64)
                kept = weight[0].sum() - np.cumsum(gone[0], axis=1)
                flat = [kept, gone[0], redundant, unique[orders], gone[1], gone[2], shapley[orders]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * orders.size, pa.string()), pa.array(np.repeat(names, n).tolist()),
                     pa.array(np.tile(np.arange(1, n + 1), len(orders)), pa.int32()), *[pa.array(x.ravel().astype(np.int64)) for x in flat]],
                    names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
                )

    of_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("rows"))
    longs = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return of_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang) and (doc_id, quality, toxic) → the rows of :func:`interaction` for the filters A to E.

    A: under 100 words; B: fewer than 80 distinct words in 100; C: more than 10
    letters A-Z in 100 code points; D: one of ``#$%&*|``; E: a smaller doc_id has the
    same text. Null texts are empty, and fail A. An empty table gives no rows.
    Repeated rows count each; no copy of the same doc_id fails E for the other.
    """
    return interaction(failures(docs, labels))
