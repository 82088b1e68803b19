"""How the sources of a language differ: exact term counts per source, compared pair by pair.

As a count vectorizer does, every document becomes a sparse vector of term counts,
and the vocabulary of a language is all terms in at least ``min_df`` of its
documents, however many those are. The vocabulary is a table here, not an array
on the driver: it grows with the corpus. Vectors are summed per language and source
in the task that makes them, so what is shuffled is one row for each term, source
and task.

A pair of sources is evaluated on the terms that either of them has; what all other
terms add is the same number for each of them. Terms are dealt to buckets, and the
sources of a language to blocks, so a task holds a bucket's terms of two blocks, and
hands on one partial sum for each pair of sources.

All arithmetic is on whole numbers: ``share`` is 1 + floor(10**9 (count + 2) / (N + 2 V)) and
``gap`` is floor((p - q)**2 / (p + q)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotflow.llm.common import as_bytes, batches, stored

SCALE = 1_000_000_000
#: Bytes outside of terms become blanks; A-Z become a-z. Bytes from 0x80 on belong to other letters.
_fold = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of UTF-8 text, A-Z in lower case, in order."""
    return text.translate(_fold).split()


class GroupSums:
    """Sparse vectors of documents, added up per group."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.groups: dict[tuple, int] = {}
        self.cells: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []

    def add(self, keys: list[tuple], texts: list[bytes]) -> None:
        """One batch of documents: vectors of all of them, then their sums."""
        ids, groups = self.ids, self.groups
        group = np.array([groups.setdefault(k, len(groups)) for k in keys], np.int64)
        found = [[ids.setdefault(w, len(ids)) for w in terms(t)] for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        term = np.fromiter((i for x in found for i in x), np.int64, len(doc))
        # one entry of a vector is one (document, term) with its count
        entry, count = np.unique(doc << 32 | term, return_counts=True)
        cell, place = np.unique(group[entry >> 32] << 32 | entry & 0xFFFFFFFF, return_inverse=True)
        self.cells.append(cell)
        self.counts.append(np.bincount(place, count, len(cell)).astype(np.int64))
        self.docs.append(np.bincount(place, minlength=len(cell)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, count, docs) of all groups, and one row without term for each group."""
        words = pa.array([w for w in self.ids], pa.binary()).cast(pa.string())
        lang, source = (pa.array([k[i] for k in self.groups], pa.string()) for i in (0, 1))
        zero = pa.array(np.zeros(len(self.groups), np.int64))
        names = ["lang", "source", "term", "count", "docs"]
        yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(self.groups), pa.string()), zero, zero], names=names)
        cells, place = np.unique(np.concatenate(self.cells), return_inverse=True)
        count, docs = np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
        np.add.at(count, place, np.concatenate(self.counts))
        np.add.at(docs, place, np.concatenate(self.docs))
        for a in range(0, len(cells), 1 << 16):
            part = cells[a:a + (1 << 16)]
            group, term = pa.array(part >> 32), pa.array(part & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays(
                [lang.take(group), source.take(group), words.take(term), pa.array(count[a:a + len(part)]), pa.array(docs[a:a + len(part)])],
                names=names,
            )


def group_sums(docs: DataFrame, most: int = 1 << 19) -> DataFrame:
    """(text, lang, source) → lang, source, term, count, docs: one row for each group and term, one without term for each group.

    A task gives back its sums whenever ``most`` cells are held, so its memory is bounded.
    """
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = GroupSums(), 0
        for batch in batches(source):
            keys = list(zip(batch["lang"].to_pylist(), batch["source"].to_pylist()))
            sums.add(keys, as_bytes(batch["text"]))
            held += len(sums.cells[-1])
            if held > 4 * most or len(sums.ids) > most:
                yield from sums.rows()
                sums, held = GroupSums(), 0
        if sums.groups:
            yield from sums.rows()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    partial = docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(
        run, "lang string, source string, term string, count long, docs long"
    )
    return partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 (count + 2) / (n + 2 v)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = (wide(count) + F.lit(2)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = (wide(n) + F.lit(2).cast("decimal(2,0)") * wide(v)).cast("decimal(24,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, under)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most 10**9 + 1, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_sums(one: dict, two: dict, n_terms: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each source of ``one``: sums of gaps with each source of ``two``, and how many terms either has.

    A side has ``base`` (share without the term, one for each source), and its entries
    ``row``, ``term``, ``p`` in order of row.
    """
    rows = len(two["base"])
    q = np.repeat(two["base"][:, None], n_terms, 1)
    has = np.zeros((rows, n_terms), bool)
    q[two["row"], two["term"]] = two["p"]
    has[two["row"], two["term"]] = True
    size = np.bincount(two["row"], minlength=rows)
    edge = np.searchsorted(one["row"], np.arange(len(one["base"]) + 1))
    for i, base in enumerate(one["base"]):
        own = slice(edge[i], edge[i + 1])
        at = one["term"][own]
        there, both = q[:, at], has[:, at]
        value = _gap(one["p"][own], there).sum(1)
        # terms only the other has: all of its terms less those both have
        alone = np.zeros(rows, np.int64)
        np.add.at(alone, two["row"], _gap(base, two["p"]))
        value += alone - (_gap(base, there) * both).sum(1)
        yield i, value, len(at) + size - both.sum(1)


def _evaluate(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of gaps over a bucket's terms for the pairs between two blocks of sources (or within one).

    Every source of the blocks has a row without term, so none is missing for want of terms.
    """
    lang, i, j, _ = (k.as_py() for k in key)
    block, has_term = np.asarray(table["block"]), np.asarray(table["term"].is_valid())
    source, term = (table[c].combine_chunks().dictionary_encode() for c in ("source", "term"))
    code, term_code = (np.asarray(x.indices.fill_null(-1), np.int64) for x in (source, term))
    p, base = np.asarray(table["p"].fill_null(0)), np.asarray(table["base"])
    sides = {}
    for b in {i, j}:
        mine = np.flatnonzero(block == b)
        names, first = np.unique(code[mine], return_index=True)
        held = mine[has_term[mine]]
        held = held[np.argsort(code[held], kind="stable")]
        sides[b] = {"names": names, "base": base[mine[first]], "row": np.searchsorted(names, code[held]), "term": term_code[held], "p": p[held]}
    one, two = sides[i], sides[j]
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for r, value, met in _pair_sums(one, two, len(term.dictionary)):
        row = (np.full(len(value), one["names"][r]), two["names"], value, met, _gap(one["base"][r], two["base"]))
        for column, v in zip(out, row):
            column.append(v)
    left, right, value, met, absent = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
    if i != j:  # the gap is the same seen from either side
        left, right, value, met, absent = (np.concatenate(x) for x in ((left, right), (right, left), (value, value), (met, met), (absent, absent)))
    other = np.flatnonzero(left != right)
    v = table["v"][0].as_py()
    return pa.table({
        "lang": pa.array([lang] * len(other), pa.string()),
        "source": source.dictionary.take(pa.array(left[other])), "item": source.dictionary.take(pa.array(right[other])),
        "value": pa.array(value[other]), "met": pa.array(met[other].astype(np.int64)), "absent": pa.array(absent[other]),
        "v": pa.array(np.full(len(other), v, np.int64)),
    })


def divergence(docs: DataFrame, min_df: int = 10, top: int = 10, bucket_terms: int = 4096, block_sources: int = 256) -> DataFrame:
    """(text, lang, source) → lang, source, part, item, value, rank.

    Part ``pair``: how far a source is from each other source of its language; the
    value is the gap summed over all kept terms, 0 without kept terms. Part ``term``:
    the ``top`` terms a source has more often than its language. Ranks go by falling
    value, then by item.

    Null text, lang and source count as ''. A source without terms, or with none
    that is kept, still takes part in pairs; a language with one source has none. An
    empty table gives no rows, repeated rows count each, other columns do not matter.
    """
    sums = stored(group_sums(docs))
    of_term = Window.partitionBy("lang", "term")
    kept = stored(
        sums.where("term is not null")
        .withColumn("df", F.sum("docs").over(of_term)).withColumn("total", F.sum("count").over(of_term))
        .where(F.col("df") >= min_df)
        .withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
        .select("lang", "source", "term", "count", "total", "first")
    )
    langs = kept.groupBy("lang").agg(
        F.sum(F.col("first").cast("long")).alias("v"), F.sum(F.when(F.col("first"), F.col("total"))).alias("n_lang")
    )
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = stored(
        sums.where("term is null").select("lang", "source").distinct()
        .join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "v", "n_lang")])
        .withColumn("base", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1).cast("long")))
    )
    many = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))

    # a row for each kept term of a source, and one without term for each bucket
    buckets = F.greatest(F.lit(1), F.ceil(F.col("v") / bucket_terms)).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("sources") / block_sources)).cast("int")
    place = ["lang", "source", "base", "v"]
    placed = shares.select(*place, "term", "p", F.pmod(F.xxhash64("term"), buckets).cast("int").alias("bucket")).unionByName(
        groups.select(*place, F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"),
                      F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket"))
    )
    dealt = (
        placed.join(many.where("sources > 1"), "lang")
        .select(*place, "term", "p", "bucket", F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"),
                F.explode(F.sequence(F.lit(0), blocks - 1)).alias("t"))
        .select("*", F.least("block", "t").alias("i"), F.greatest("block", "t").alias("j")).drop("t")
    )
    partial = dealt.groupBy("lang", "i", "j", "bucket").applyInArrow(
        _evaluate, "lang string, source string, item string, value long, met long, absent long, v long"
    )
    pairs = partial.groupBy("lang", "source", "item").agg(
        (F.sum("value") + (F.first("v") - F.sum("met")) * F.first("absent")).alias("value")
    )
    own = (
        shares.withColumn("q", share(F.col("total"), F.col("n_lang"), F.col("v")))
        .where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    )
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair")).withColumn("rank", ranked).select(*cols)
        .unionByName(own.withColumn("part", F.lit("term")).withColumn("rank", ranked).where(F.col("rank") <= top).select(*cols))
    )
