"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``prefix`` nearest reference points (pivots), nearest
first. Vectors near each other have nearly the same nearest pivots, so a pair is a
candidate if it shares ``shared`` pivots or more; candidates are verified by their
cosine in double precision.

Inverted lists keep, for each pivot, the vectors that name it. With its pivots in
order of rarity, a vector needs to stand only in the lists of its first
``prefix - shared + 1``: a pair with enough shared pivots has the rarest of them
there, on both sides. A list that is too long is divided by the next shared pivot,
and what is still too long by hash into blocks that meet two by two. A pair is looked at
in the one list of its rarest shared pivots, so links are counted once, in the
lists themselves; what comes out is one row for each vector of a list, never pairs.

Vectors that are equal are one entry of the index with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from spotflow.llm.common import stored
from spotflow.operators.graphs import connected_components

PREFIX, SHARED = 12, 6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def spread_out(vectors: np.ndarray, n: int, seed: int = 13) -> np.ndarray:
    """n pivots: of the vectors those that are far from each other, then random directions."""
    dim = vectors.shape[1]
    vectors = unit(vectors)
    chosen, nearest = [], np.full(len(vectors), -2.0)
    for _ in range(min(n, len(vectors))):
        at = int(np.argmin(nearest))
        if nearest[at] > 0.9:  # the rest lies close to the pivots there are
            break
        chosen.append(at)
        nearest = np.maximum(nearest, vectors @ vectors[at])
    rest = np.random.default_rng(seed).normal(size=(n - len(chosen), dim))
    return np.concatenate([vectors[chosen], unit(rest) if len(rest) else rest])


def choose_pivots(rows: DataFrame, n: int, total: int, sample: int = 4) -> dict[int, np.ndarray]:
    """n pivots for each number of dimensions, from about ``sample * n`` vectors chosen by hash.

    This bounded sample is all that reaches the driver.
    """
    h = F.xxhash64("dim", "embedding")
    picked = rows.withColumn("h", h)
    fraction = 2 * sample * n / max(total, 1)
    if fraction < 1:
        picked = picked.where(F.col("h") < int(-(1 << 63) + fraction * (1 << 64)))
    one = picked.groupBy("dim", "h").agg(F.first("embedding").alias("embedding"))
    best = one.withColumn("no", F.row_number().over(Window.partitionBy("dim").orderBy("h"))).where(F.col("no") <= sample * n)
    found: dict[int, list] = {}
    for r in best.select("dim", "embedding").toLocalIterator():
        found.setdefault(r["dim"], []).append(r["embedding"])
    return {dim: spread_out(np.array(v, np.float64), n) for dim, v in found.items()}


def describe(rows: DataFrame, pivots: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """(vec_id, label, dim, embedding) → the same, cid (digest of label and vector), near (pivots, nearest first)."""
    n = max((len(p) for p in pivots.values()), default=1)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in source:
            for a in range(0, batch.num_rows, 4096):
                table = pa.Table.from_batches([batch.slice(a, 4096)])
                for dim in pc.unique(table["dim"]).to_pylist():
                    part = table.filter(pc.equal(table["dim"], dim))
                    raw = np.ascontiguousarray(matrix(part["embedding"]))
                    # a dimension the sample did not meet gets random directions
                    points = pivots[dim] if dim in pivots else spread_out(np.ones((1, dim)), n)
                    far = -(unit(raw) @ points.T)
                    k = min(prefix, far.shape[1])
                    near = np.argsort(far, axis=1, kind="stable")[:, :k].astype(np.int32)
                    ids = [xxh3_128_digest(f"{label} ".encode() + v.tobytes()) for label, v in zip(part["label"].to_pylist(), raw)]
                    yield pa.RecordBatch.from_arrays(
                        [part["vec_id"].combine_chunks(), part["label"].combine_chunks(), part["dim"].combine_chunks(),
                         pa.array(ids, pa.binary()), part["embedding"].combine_chunks(),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k, dtype=np.int32)), pa.array(near.ravel()))],
                        names=["vec_id", "label", "dim", "cid", "embedding", "near"],
                    )

    kind = dict(rows.dtypes)
    return rows.select("vec_id", "label", "dim", "embedding").mapInArrow(
        run, f"vec_id long, label {kind['label']}, dim int, cid binary, embedding {kind['embedding']}, near array<int>"
    )


def by_rarity(entries: DataFrame) -> DataFrame:
    """(cid, label, dim, near) → cid, label, dim, ranks: the same pivots as ranks, rarest first."""
    counts = entries.select(F.explode("near").alias("pivot")).groupBy("pivot").count().orderBy("count", "pivot")
    order = np.array([r["pivot"] for r in counts.toLocalIterator()], np.int64)  # one row for each pivot
    rank = np.zeros(int(order.max(initial=-1)) + 1, np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            near = batch["near"]
            lengths = np.diff(np.asarray(near.offsets))
            values = rank[np.asarray(near.flatten())]
            row = np.repeat(np.arange(len(near)), lengths)
            values = values[np.lexsort((values, row))]
            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["cid"], batch["label"], batch["dim"], pa.ListArray.from_arrays(offsets, pa.array(values))],
                names=["cid", "label", "dim", "ranks"],
            )

    kind = dict(entries.dtypes)["label"]
    return entries.select("cid", "label", "dim", "near").mapInArrow(run, f"cid binary, label {kind}, dim int, ranks array<int>")


def lists(ranked: DataFrame, prefix: int, shared: int, most: int) -> DataFrame:
    """(label, dim, p1, p2, i, j, block, cid): the members of all inverted lists with two members or more.

    p2 is -1 in lists that are not divided. Blocks i and j of a list meet in one group.
    """
    here = prefix - shared + 1  # lists in which a vector stands
    own = ["label", "dim", "p1", "p2"]

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), own)

    first = stored(sized(
        ranked.select("cid", "label", "dim", "ranks", F.posexplode(F.slice("ranks", 1, here)).alias("pos", "p1"))
        .withColumn("p2", F.lit(-1))
    ))
    # in a long list the next shared pivot must be one of those that leave enough after it
    divided = sized(
        first.where(F.col("n") > most).drop("n", "p2")
        .withColumn("p2", F.explode(F.slice("ranks", F.col("pos") + 2, F.lit(here) - F.col("pos"))))
    )
    members = first.where(F.col("n") <= most).select(*own, "cid", "n").unionByName(divided.select(*own, "cid", "n"))
    blocks = F.ceil(F.col("n") / most).cast("int")
    return (
        members.select(*own, "cid", F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("t"))
        .select(*own, "cid", "block", F.least("block", "t").alias("i"), F.greatest("block", "t").alias("j"))
    )


def _shared_counts(one: np.ndarray, two: np.ndarray, width: int = 1024) -> Iterator[tuple[int, np.ndarray]]:
    """For growing columns: the first column not yet counted, and how many ones rows have in common so far."""
    out = np.zeros((len(one), len(two)), np.float32)
    for a in range(0, one.shape[1], width):
        out += one[:, a:a + width].astype(np.float32) @ two[:, a:a + width].astype(np.float32).T
        yield a + width, out


def linked(ranks: np.ndarray, vectors: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool,
           last: int, depth: int, shared: int, cosine: float, rows: int = 1024) -> np.ndarray:
    """Which members ``left`` and ``right`` of a list are linked, as a table of flags.

    ``last`` is the rarest-first rank of the list's last pivot, ``depth`` how many pivots the
    list has: a pair belongs here if those are all it shares up to ``last``.
    """
    codes, at = np.unique(ranks, return_inverse=True)
    hot = np.zeros((len(ranks), len(codes)), bool)
    np.put_along_axis(hot, at.reshape(ranks.shape), True, 1)
    upto = int(np.searchsorted(codes, last, side="right"))
    out = np.zeros((len(left), len(right)), bool)
    for a in range(0, len(left), rows):
        part = left[a:a + rows]
        early = np.zeros(0)
        for _, early in _shared_counts(hot[part, :upto], hot[right, :upto]):
            pass
        late = np.zeros_like(early)
        for _, late in _shared_counts(hot[part, upto:], hot[right, upto:]):
            pass
        near = (early == depth) & (early + late >= shared)
        if same:
            near &= part[:, None] != right[None]
        r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if len(r):
            close = vectors[part[r]] @ vectors[right[c]].T >= cosine
            out[np.ix_(a + r, c)] = near[np.ix_(r, c)] & close
    return out


def roots(flags: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The first member of the component of each of n members, by links between left and right."""
    root = np.full(n, -1)
    row, column = np.full(n, -1), np.full(n, -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start], front = start, np.array([start])
        while len(front):
            r, c = row[front], column[front]
            reached = np.r_[right[flags[r[r >= 0]].any(0)], left[flags[:, c[c >= 0]].any(1)]]
            front = np.unique(reached[root[reached] < 0])
            root[front] = start
    return root


def _verify(shared: int, cosine: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        p1, p2, i, j = (k.as_py() for k in key[2:])
        table = table.sort_by("cid")
        block = np.asarray(table["block"])
        ranks = matrix(table["ranks"]).astype(np.int64)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        flags = linked(ranks, unit(matrix(table["embedding"])), left, right, i == j,
                       max(p1, p2), 1 if p2 < 0 else 2, shared, cosine)
        weight, n = np.asarray(table["size"]), np.zeros(len(block), np.int64)
        n[left] += flags @ weight[right]
        if i != j:
            n[right] += weight[left] @ flags
        root = roots(flags, left, right, len(block))
        hit = pa.array(np.flatnonzero(n))
        return pa.table({"cid": table["cid"].take(hit), "n": pa.array(n).take(hit), "root": table["cid"].take(pa.array(root).take(hit))})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, n_pivots: int | None = None, prefix: int = PREFIX,
                    shared: int = SHARED, most: int = 4096) -> DataFrame:
    """(vec_id, label, embedding) → vec_id, n_links, component_id, kept; one row for each row.

    Rows link when their labels are equal and the cosine is ``cosine`` or more, as far as
    they share enough pivots (see the module). ``n_links`` counts other rows,
    ``component_id`` is the smallest vec_id that links reach.

    A null label, a vector that is null, empty, all zero, or holds a null or non-finite
    component, or vectors of different lengths link with nothing. Equal rows are
    rows of their own and link. A null vec_id is reached but never the smallest unless all of its component
    are null; ``kept`` compares null with null as equal. An empty table gives no rows.

    ``n_pivots``: half the square root of the number of vectors unless given, 256 at least and
    16,384 at most. Pivots come from a sample of vectors, eight for each pivot on average; every vector is indexed.
    """
    kind = dict(vectors.dtypes)["embedding"]
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"))
    sound = (
        F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    usable = rows.where(F.coalesce(sound, F.lit(False))).withColumn("dim", F.size("embedding"))
    total = usable.count()
    n_pivots = n_pivots or min(max(256, isqrt(total) // 2), 16384)
    named = stored(describe(usable, choose_pivots(usable, n_pivots, total), prefix))
    entries = stored(named.groupBy("cid").agg(
        F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first"),
        F.first(F.struct("label", "dim", "embedding", "near")).alias("e"),
    ).select("cid", "size", "first", "e.*"))
    ranked = stored(by_rarity(entries))
    met = lists(ranked, prefix, shared, most)
    held = entries.select("cid", "size", "embedding").join(ranked.select("cid", "ranks"), "cid")
    groups = met.join(held, "cid").groupBy("label", "dim", "p1", "p2", "i", "j")
    found = stored(groups.applyInArrow(_verify(shared, cosine), "cid binary, n long, root binary"))
    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    classes = connected_components(found.where("cid <> root").select(F.col("root").alias("a"), F.col("cid").alias("b")))
    placed = (
        entries.select("cid", "size", "first").join(links, "cid", "left")
        .join(classes.select(F.col("member").alias("cid"), "root"), "cid", "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = placed.join(least, "root").select(
        "cid", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    in_index = named.select("vec_id", "cid").join(of_class, "cid").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return in_index.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
