"""Sliced look-behind equals the plain window, also for a hot key."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W, functions as F

from spotflow.operators.ordered import after, before, chunked, marked, numbered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    data = [
        (i, rng.choice("aaaab"), t0 + dt.timedelta(minutes=rng.randrange(3000)), rng.choice([None, 1, 2, 3]))
        for i in range(600)
    ]
    return spark.createDataFrame(data, "id long, k string, ts timestamp, v long").cache()


@pytest.fixture(scope="module")
def holey(spark):
    """Null keys and null times among the others."""
    rng = random.Random(2)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    data = [
        (i, rng.choice(["a", None]), rng.choice(["x", "y", None]), None if i % 17 == 0 else t0 + dt.timedelta(seconds=rng.randrange(4000)), rng.choice([None, 1, 2]))
        for i in range(400)
    ]
    return spark.createDataFrame(data, "id long, k string, l string, ts timestamp, v long").cache()


@pytest.mark.parametrize("width", [1, 300, 86_400])
def test_null_keys_and_times(holey, width):
    keys, order = ["k", "l"], ["ts", "id"]
    w = W.partitionBy(*keys).orderBy(*order)
    part = F.when(F.col("v") == 2, F.col("id"))
    back = w.rowsBetween(W.unboundedPreceding, -1)
    _same(before(holey, keys, order, {"p": F.col("id"), "q": part}, width),
          holey.select("*", F.lag("id").over(w).alias("p"), F.last(part, True).over(back).alias("q")))
    _same(after(holey, keys, order, {"p": F.col("id")}, width), holey.select("*", F.lead("id").over(w).alias("p")))
    _same(numbered(holey, keys, order, "n", "total", width),
          holey.select("*", F.row_number().over(w).cast("long").alias("n"), F.count("id").over(W.partitionBy(*keys)).alias("total")))


def _same(a, b):
    assert sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))


@pytest.mark.parametrize("width", [600, 3600, 10**9])
def test_before_and_after(skewed, width):
    w = W.partitionBy("k").orderBy("ts", "id")
    exprs = {"seen": F.struct("v", "id")}
    part = F.when(F.col("v") == 2, F.col("id"))
    got = before(skewed, ["k"], ["ts", "id"], {"lag_id": F.col("id"), "last2": part}, width)
    back = w.rowsBetween(W.unboundedPreceding, -1)
    want = skewed.select("*", F.lag("id").over(w).alias("lag_id"), F.last(part, True).over(back).alias("last2"))
    _same(got, want)
    got = after(skewed, ["k"], ["ts", "id"], exprs, width)
    _same(got.select("id", "seen"), skewed.select("id", F.lead(exprs["seen"]).over(w).alias("seen")))


def test_numbered(skewed):
    w = W.partitionBy("k").orderBy("ts", "id")
    got = numbered(skewed, ["k"], ["ts", "id"], "n", "total", 1800)
    want = skewed.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.count("id").over(W.partitionBy("k")).alias("total")
    )
    _same(got, want)


def test_chunks_hold_the_next_rows(spark):
    got = chunked(spark.range(1, 26).withColumnRenamed("id", "n"), "n", 10, 4).groupBy("_chunk").agg(
        F.array_sort(F.collect_list("n")).alias("n"), F.count_if("_home").alias("own"))
    rows = {r["_chunk"]: (r["n"], r["own"]) for r in got.collect()}
    assert rows[0] == (list(range(1, 14)), 9)
    assert rows[1] == (list(range(10, 24)), 10)
    assert rows[2] == (list(range(20, 26)), 6)


@pytest.mark.parametrize("width", [600, 3600, 10**9])
def test_marked(skewed, width):
    w = W.partitionBy("k").orderBy("ts", "id")

    def mark(get, prev):
        return F.when(prev.isNull() | (prev.id > get("id")), get("id"))

    got = marked(skewed, ["k"], ["ts", "id"], F.struct("id"), mark, ["id"], width)
    step = skewed.withColumn("before", F.lag(F.struct("id")).over(w))
    step = step.withColumn("m", mark(F.col, F.col("before")))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    _same(got, step.select(*skewed.columns, "before", F.last("m", True).over(upto).alias("last_mark")))
