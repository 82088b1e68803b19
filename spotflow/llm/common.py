"""Parts shared by the operators: rolling hashes in numpy, batches, blocks of documents."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Odd multiplier of the rolling hashes (mod 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
_values = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, drop: Callable[[], None]) -> None:
    """Tables this Python worker keeps between tasks, until a task of another operator begins."""
    _held[owner] = drop


def trim() -> None:
    """Hand memory that numpy and Arrow have freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def release(owner: str | None = None) -> None:
    """Give back what other operators and earlier tasks left in this worker."""
    global _powers
    for name in [name for name in _held if name != owner]:
        _held.pop(name)()
    _powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
    trim()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = n + (1 << 18)
        made = []
        for base in (BASE, INVERSE):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=np.uint64))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def mix(a: np.ndarray, factor: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    """Spread every bit over the word; a bijection."""
    a = (a ^ (a >> np.uint64(33))) * np.uint64(factor)
    return a ^ (a >> np.uint64(29))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums s so that (s[j] - s[i]) * BASE**i is the rolling hash of values[i:j]."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[1], dtype=np.uint64, out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling hashes of values[start:end]."""
    return (sums[end] - sums[start]) * powers(len(sums))[0][start]


def word_bounds(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of UTF-8 text."""
    blank = np.ones(len(buf) + 2, bool)
    blank[1:-1] = _blank[np.frombuffer(buf, np.uint8)]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def byte_sums(buf: bytes) -> np.ndarray:
    return prefix_sums(_values[np.frombuffer(buf, np.uint8)])


def word_hashes(texts: list[bytes], at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in runs(texts, at_once):
        buf = b" ".join(part)
        start, end = word_bounds(buf)
        hashes.append(mix(spans(byte_sums(buf), start, end) + (end - start).astype(np.uint64)))
        ends = np.cumsum([len(t) + 1 for t in part])
        counts.append(np.diff(np.searchsorted(start, ends), prepend=0))
    return np.concatenate(hashes), np.concatenate(counts)


def runs(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Consecutive texts of about so many bytes together, at least one."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def small_batches(spark: SparkSession, most: int = 1 << 22) -> None:
    """Rows go to Python in batches of about so many bytes from now on in this session, not of 10,000 rows or 64 MB.

    An executor and its workers hold several batches a task, in buffers up to twice as large.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def batches(source: Iterator[pa.RecordBatch], most: int = 1 << 22, column: str = "text", owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts take about so many bytes; tables of other operators than ``owner`` go."""
    release(owner)
    for batch in source:
        size = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), np.int64)
        group = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    trim()  # the worker may wait long for its next task


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each value; null gives none."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one all executors share."""
    from spotflow.operators.lineage import shared_folder as base

    return f"{base(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that :func:`stored` made and nothing will read again."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_chars(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def blocked(docs: DataFrame, chars: int, most: int = 1 << 25, per_partition: int = 4) -> DataFrame:
    """Add ``_block``: consecutive ranges of doc_id with some megabytes of text each.

    Rows of one doc_id share a block; null counts as the smallest id. The bounds
    are approximate quantiles of doc_id; only they reach the driver. There are
    ``per_partition`` blocks for each shuffle partition, of 2 MB at least and
    ``most`` bytes at most, on average.
    """
    size = min(max(1 << 21, chars // (per_partition * width(docs.sparkSession))), most)
    n = max(1, -(-chars // size))
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = np.unique(np.asarray(cuts or [], np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def block(ids):
        import pandas as pd

        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(bounds, ids[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    return docs.withColumn("_block", block(F.col("doc_id").cast("long")))
