"""Ordered look-behind and look-ahead that survive a hot key.

``lag``/``lead``/running windows partitioned by a key put every row of that key
in one task. Here a key's time line is cut into slices: the window runs inside
(key, slice), one summary row per (key, slice) carries what a slice hands to
the next one, and only these summaries are ordered per key. A key holding a
third of all rows is thus spread over as many tasks as it has slices, and the
answer is the same as that of the plain window.

Rows are ordered by ``order``: a timestamp first, then columns that break ties.
Null is a key value like any other, and rows without a time come first, all in
one slice; the answers are those of the plain window at any width.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotflow.functions.columns import _c

# Seconds of a slice. A key with a third of 100 TB spread over a month leaves a few
# gigabytes per slice; the summaries of one key stay at 105,000 rows a year.
SLICE = 300


def _sliced(df: DataFrame, order: list[str], width: float) -> DataFrame:
    micros = int(width * 1_000_000)
    return df.withColumn("_slice", F.floor(F.unix_micros(_c(order[0])) / micros).cast("long"))


def null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, Column]:
    """The right side with its ``on`` columns renamed, and the condition that joins null with null."""
    named = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return named, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])


def _with_summary(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their (key, slice) summary, null keys and slices included."""
    right, same = null_safe(rows, summary, [*keys, "_slice"])
    return rows.join(right, same, "left")


def _look(df, keys, order, exprs, width, ahead) -> DataFrame:
    base = _sliced(df, order, width)
    for name, expr in exprs.items():
        base = base.withColumn(f"_v_{name}", expr)
    rank = F.struct(*order)
    pick = F.min_by if ahead else F.max_by
    carried = base.groupBy(*keys, "_slice").agg(
        *[
            pick(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_s_{n}")
            for n in exprs
        ]
    )
    direction = (lambda c: F.desc(c)) if ahead else (lambda c: F.asc(c))
    across = (
        W.partitionBy(*keys)
        .orderBy(direction("_slice"))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    carried = carried.select(
        *keys,
        "_slice",
        *[F.last(f"_s_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in exprs],
    )
    within = (
        W.partitionBy(*keys, "_slice")
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(W.unboundedPreceding, -1)
    )
    local = base.select(
        *df.columns,
        "_slice",
        *[F.last(f"_v_{n}", ignorenulls=True).over(within).alias(f"_l_{n}") for n in exprs],
    )
    return _with_summary(local, carried, keys).select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in exprs]
    )


def before(df: DataFrame, keys: list[str], order: list[str], exprs: dict[str, Column],
           width: float = SLICE) -> DataFrame:
    """Add the last non-null value of each expression among earlier rows of the key."""
    return _look(df, keys, order, exprs, width, ahead=False)


def after(df: DataFrame, keys: list[str], order: list[str], exprs: dict[str, Column],
          width: float = SLICE) -> DataFrame:
    """Add the first non-null value of each expression among later rows of the key."""
    return _look(df, keys, order, exprs, width, ahead=True)


def marked(df: DataFrame, keys: list[str], order: list[str], prev: Column,
           mark: Callable[[Callable[[str], Column], Column], Column], needs: list[str],
           width: float = SLICE) -> DataFrame:
    """Marks that depend on the row before, and the last mark up to each row.

    ``mark(get, before)`` builds a nullable expression from columns of the row
    (``get(name)``, names listed in ``needs``) and ``before``, the value of
    ``prev`` in the row before (null at the start of a key). Adds ``before``
    and ``last_mark``, the newest non-null mark at or before the row.

    One pass does both: a slice's summary keeps its first row, its last
    ``prev`` value and its last mark, so the mark of the first row, which needs
    the slice before, is decided on summaries.
    """
    base = _sliced(df, order, width).withColumn("_m_prev", prev)
    rank = F.struct(*order)
    within = W.partitionBy(*keys, "_slice").orderBy(*order)
    upto = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    stepped = base.withColumn("_m_local", F.lag("_m_prev").over(within)).withColumn(
        "_m_first", F.row_number().over(within) == 1
    ).withColumn("_m_mark", F.when(~F.col("_m_first"), mark(F.col, F.col("_m_local"))))
    summary = stepped.groupBy(*keys, "_slice").agg(
        F.min_by(F.struct(*needs), rank).alias("_m_head"),
        F.max_by("_m_prev", rank).alias("_m_tail"),
        F.max_by("_m_mark", F.when(F.col("_m_mark").isNotNull(), rank)).alias("_m_last"),
    )
    across = W.partitionBy(*keys).orderBy("_slice")
    opened = summary.withColumn("_m_before", F.lag("_m_tail").over(across))
    opened = opened.withColumn("_m_open", mark(lambda c: F.col(f"_m_head.{c}"), F.col("_m_before")))
    carried = opened.select(
        *keys, "_slice", "_m_before",
        F.coalesce(
            "_m_open",
            F.last(F.coalesce("_m_last", "_m_open"), ignorenulls=True).over(
                across.rowsBetween(W.unboundedPreceding, -1)
            ),
        ).alias("_m_carry"),
    )
    local = stepped.select(
        *df.columns, "_slice", "_m_first", "_m_local", F.last("_m_mark", ignorenulls=True).over(upto).alias("_m_seen")
    )
    return _with_summary(local, carried, keys).select(
        *df.columns,
        F.when(F.col("_m_first"), F.col("_m_before")).otherwise(F.col("_m_local")).alias("before"),
        F.coalesce("_m_seen", "_m_carry").alias("last_mark"),
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n",
             total: str | None = None, width: float = SLICE) -> DataFrame:
    """Add the 1-based position of a row within its key, and the key's row count."""
    base = _sliced(df, order, width)
    counts = base.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    run = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("_rows").over(run), F.lit(0)).alias("_offset")]
    if total:
        cols.append(F.sum("_rows").over(W.partitionBy(*keys)).alias(total))
    offsets = counts.select(*keys, "_slice", *cols)
    local = base.withColumn(
        "_rn", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order))
    )
    return _with_summary(local, offsets, keys).select(
        *df.columns,
        (F.col("_rn") + F.col("_offset")).alias(name),
        *([total] if total else []),
    )


def chunked(df: DataFrame, seq: str, size: int, ahead: int) -> DataFrame:
    """Spread numbered rows over chunks of ``size``, each with the next ``ahead`` rows.

    ``_chunk`` is the chunk and ``_home`` tells whether the row belongs to it or
    is a copy for look-ahead, so a frame of ``ahead`` rows never leaves its chunk.
    """
    own = F.floor(F.col(seq) / size).cast("long")
    copies = F.when(
        (F.col(seq) % size < ahead) & (own > 0),
        F.array(
            F.struct(own.alias("c"), F.lit(True).alias("h")),
            F.struct((own - 1).alias("c"), F.lit(False).alias("h")),
        ),
    ).otherwise(F.array(F.struct(own.alias("c"), F.lit(True).alias("h"))))
    return df.withColumn("_copy", F.explode(copies)).select(
        *df.columns, F.col("_copy.c").alias("_chunk"), F.col("_copy.h").alias("_home")
    )
