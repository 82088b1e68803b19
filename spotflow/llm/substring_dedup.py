"""Substring dedup: word windows that an earlier document has already are removed.

Every window of ``window`` consecutive words gets a Rabin-Karp hash of 64 bits
and a second, independent one that chooses its bucket. Documents lie in blocks
of consecutive doc_ids. A block sends each distinct hash once, so copies inside
a block are counted before the shuffle; a bucket sorts what all blocks sent and
tells each block, one bit a hash, whether an earlier block has it. The block
marks its windows, and marked windows that touch or overlap become one removal
interval. All windows of all documents take part.

Two windows meet wrongly only if both hashes agree: n windows and k buckets
give about n*n/(k*2**65) wrong meetings.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotflow.llm.common import as_bytes, blocked, mix, prefix_sums, spans, total_chars, width, word_hashes


def _sorted_docs(table: pa.Table) -> pa.Table:
    """By doc_id, null first, then text: the same order each time a block is read."""
    return table.sort_by([("_null", "descending"), ("doc_id", "ascending"), ("text", "ascending")])


class _Block:
    """Windows of a block: ``send`` is in bucket and hash order, ``mark`` takes the answers in that order."""

    def __init__(self, docs: pa.Table, window: int, buckets: int):
        self.docs, self.window = docs, window
        hashes, self.counts = word_hashes(as_bytes(docs["text"]))
        ids = list(zip(docs["_null"].to_pylist(), docs["doc_id"].to_pylist()))
        rank = np.cumsum([0] + [a != b for a, b in zip(ids, ids[1:])]) if ids else np.zeros(0, np.int64)
        ends = np.cumsum(self.counts)
        last = np.repeat(ends, self.counts)
        start = np.arange(len(hashes))
        self.start = start = start[start + window <= last]
        self.rank = np.repeat(rank, self.counts)[start]
        self.starts_of_docs = ends - self.counts
        first = spans(prefix_sums(hashes), start, start + window)
        second = mix(spans(prefix_sums(mix(hashes, 0xC4CEB9FE1A85EC53)), start, start + window))
        bucket = ((second >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        self.order = order = np.lexsort((start, first, bucket))
        f, b = first[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (f[1:] != f[:-1]) | (b[1:] != b[:-1])
        self.group = np.cumsum(new) - 1
        self.heads = np.flatnonzero(new)
        self.keys, self.bucket = f[new], b[new]

    def chunks(self):
        edge = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))
        for a, b in zip(edge, edge[1:]):
            yield int(self.bucket[a]), self.keys[a:b]

    def covered(self, earlier: np.ndarray) -> np.ndarray:
        """Of each word: does a window that an earlier document has cover it?"""
        rank = self.rank[self.order]
        marked = earlier[self.group] | (rank > rank[self.heads][self.group])
        hit = self.start[self.order[marked]]
        step = np.zeros(int(self.counts.sum()) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + self.window, -1)
        return np.cumsum(step)[:-1] > 0


def _answers(table: pa.Table) -> pa.Table:
    """Bits for each block of a bucket: which of its hashes does an earlier block have?"""
    table = table.sort_by("block")
    keys = [np.frombuffer(k.as_buffer(), np.uint64) for k in table["keys"]]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")  # blocks stay in order
    again = np.zeros(len(flat), bool)
    again[order[1:]] = flat[order[1:]] == flat[order[:-1]]
    ends = np.cumsum([len(k) for k in keys])
    bits = [np.packbits(again[e - len(k):e]).tobytes() for k, e in zip(keys, ends)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})


def substring_dedup(docs: DataFrame, window: int = 50, buckets: int | None = None) -> DataFrame:
    """(doc_id, text) → doc_id, kept_text, n_words, n_removed, removed.

    ``removed`` lists the maximal intervals of removed words (from, to), ``to``
    exclusive; ``kept_text`` has the other words joined by one space.

    * Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has none and keeps "".
    * A text shorter than the window has no window and stays whole.
    * A null doc_id counts as smaller than all others. Rows of one doc_id are
      no copies of each other, as neither has the smaller id.
    * One row comes back for each row; other columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = total_chars(docs)
    n = buckets or max(width(spark), chars >> 23, 1)
    rows = blocked(docs, chars).select("_block", "doc_id", F.col("doc_id").isNull().cast("int").alias("_null"), "text")

    def send(table: pa.Table) -> pa.Table:
        block = _Block(_sorted_docs(table), window, n)
        sent = list(block.chunks())
        return pa.table({
            "block": pa.array([table["_block"][0].as_py()] * len(sent), pa.int32()),
            "bucket": pa.array([b for b, _ in sent], pa.int32()),
            "keys": pa.array([k.tobytes() for _, k in sent], pa.binary()),
        })

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _sorted_docs(table)
        block = _Block(table, window, n)
        earlier = np.zeros(len(block.keys), bool)
        at = 0
        bits = dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist()))
        for b, keys in block.chunks():
            earlier[at:at + len(keys)] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(keys))
            at += len(keys)
        gone = block.covered(earlier)
        kept, removed = [], []
        for text, a, c in zip(as_bytes(table["text"]), block.starts_of_docs, block.counts):
            own = gone[a:a + c]
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
            words = text.split()
            kept.append(b" ".join(compress(words, (~own).tolist()) if edge else words))
            removed.append([{"from": s, "to": e} for s, e in zip(edge[::2], edge[1::2])])
        return pa.table({
            "doc_id": table["doc_id"],
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            "n_words": pa.array(block.counts, pa.int64()),
            "n_removed": pa.array([sum(r["to"] - r["from"] for r in rs) for rs in removed], pa.int64()),
            "removed": pa.array(removed, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
        })

    sent = rows.groupBy("_block").applyInArrow(send, "block int, bucket int, keys binary")
    answers = sent.groupBy("bucket").applyInArrow(_answers, "block int, bucket int, bits binary")
    return rows.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(
        finish,
        "doc_id long, kept_text string, n_words long, n_removed long, removed array<struct<from: long, to: long>>",
    )
