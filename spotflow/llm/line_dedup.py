"""Line dedup: multi-line passages that occur before are removed.

Each line has a hash; a rolling hash over two neighbouring lines decides where
a chunk ends. Boundaries depend on these lines only, so a passage moved up or
down in another document is cut in the same places. Chunks are counted by hash
over all documents; those that occur more than once are then compared byte by
byte with their first occurrence. All of it is built from DataFrame functions.

Chunks alone miss short passages and the ends of long ones, where a boundary
falls outside the passage. With ``seams`` each pair of neighbouring non-blank
lines is looked at like a chunk too; every passage of two such lines or more is
made of pairs, so all of it is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spotflow.llm.common import stored


def _chunk(lines: Column, first: Column, end: Column) -> Column:
    """The lines first to end as (first, n, hash, full); ``full`` of them are not blank."""
    own = F.slice(lines, first, end - first + 1)
    return F.struct(
        first.alias("first"), (end - first + 1).alias("n"), F.xxhash64(own).alias("hash"),
        F.size(F.filter(own, lambda x: F.trim(x) != "")).alias("full"),
    )


def chunks(lines: Column, mean: int) -> Column:
    """Chunks of an array of lines as (first, n, hash, full); lines are counted from 1, ``mean`` lines a chunk.

    Each line is hashed once and meets the hash before it by position, so the work grows with the lines.
    """
    hashes = F.transform(lines, lambda x: F.xxhash64(x))
    n = F.size(lines)
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(hashes, F.lit(1), n - 1))

    def rolling(b: Column, h: Column) -> Column:
        turned = F.shiftleft(b, 1).bitwiseOR(F.shiftrightunsigned(b, 63))
        return F.pmod(F.xxhash64(F.coalesce(turned, F.lit(0)).bitwiseXOR(h)), F.lit(mean)) == 0

    marked = F.transform(F.zip_with(before, hashes, rolling), lambda cut, i: F.when(cut | (i == n - 1), i + 1))
    ends = F.filter(marked, lambda e: e.isNotNull())
    firsts = F.concat(F.array(F.lit(1)), F.transform(ends, lambda e: e + 1))
    pairs = F.filter(F.arrays_zip(firsts.alias("first"), ends.alias("end")), lambda c: c["end"].isNotNull())
    return F.transform(pairs, lambda c: _chunk(lines, c["first"], c["end"]))


def line_pairs(lines: Column) -> Column:
    """Each non-blank line with the next one, and the blank lines between, as (first, n, hash, full)."""
    full = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.trim(F.get(lines, i - 1)) != "")
    last = F.greatest(F.size(full) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(full, 1, last).alias("first"), F.slice(full, 2, last).alias("end"))
    return F.transform(pairs, lambda c: _chunk(lines, c["first"], c["end"]))


def line_dedup(docs: DataFrame, mean: int = 3, seams: bool = False) -> DataFrame:
    """(doc_id, text) → doc_id, kept_text, n_lines, n_removed; one row for each row.

    Lines end at \\n. A chunk of two non-blank lines or more that has the same
    bytes as one that comes first, by (doc_id, hash of the text, place), is
    removed with its line ends; the first stays. With ``seams`` so is each such
    pair of neighbouring non-blank lines that does not overlap its first.

    * Null counts as empty; an empty text has no line and stays empty.
    * A null doc_id comes before all others.
    * Rows alike in doc_id and text are one document and share their result.
    * A chunk whose hash meets that of another text is kept.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("_h", F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    cut = chunks(F.col("lines"), mean)
    if seams:
        cut = F.concat(cut, line_pairs(F.col("lines")))

    found = stored(
        own.where(F.instr("text", "\n") > 0)
        .select("doc_id", "_h", lines.alias("lines")).select("doc_id", "_h", F.explode(cut).alias("c"))
        .where(F.col("c.full") > 1)
        .select(F.col("doc_id").isNotNull().alias("_id"), "doc_id", "_h", "c.first", "c.n", "c.hash").distinct()
    )
    place = F.struct("_id", "doc_id", "_h", "first")
    repeated = stored(found.groupBy("hash").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("times")).where("times > 1"))
    wanted = (
        found.join(repeated.select("hash", "origin"), "hash")
        .where((F.col("origin") == place) | (F.col("origin._id") != F.col("_id")) | ~F.col("origin.doc_id").eqNullSafe(F.col("doc_id"))
               | (F.col("origin._h") != F.col("_h")) | (F.col("origin.first") + F.col("n") <= F.col("first")))
        .select("doc_id", "_h", F.struct("first", "n", "hash", (F.col("origin") == place).alias("is_first")).alias("c"))
        .groupBy("doc_id", "_h").agg(F.collect_list("c").alias("cs"))
    )
    taken = stored(
        own.join(wanted.withColumnsRenamed({"doc_id": "_d", "_h": "_g"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")))
        .select("doc_id", "_h", lines.alias("lines"), "cs")
        .select("doc_id", "_h", F.explode(F.transform("cs", lambda c: F.struct(
            c["first"].alias("first"), c["n"].alias("n"), c["hash"].alias("hash"), c["is_first"].alias("is_first"),
            F.array_join(F.slice("lines", c["first"], c["n"]), "\n").alias("chunk"),
        ))).alias("c"))  # the texts stay below: no row carries more than its chunk
        .select("doc_id", "_h", "c.*")
    )
    first = taken.where("is_first").select("hash", F.col("chunk").alias("_chunk"))
    copies = (
        taken.where("not is_first").join(first, "hash").where("chunk = _chunk")
        .groupBy("doc_id", "_h").agg(F.collect_set(F.struct("first", "n")).alias("gone"))
    )
    joined = own.join(
        copies.withColumnsRenamed({"doc_id": "_d", "_h": "_g"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")), "left"
    )
    places = F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["first"], g["first"] + g["n"] - 1))))
    joined = joined.withColumn("gone", places)
    # lambda variables hold the lines, so a text is cut once
    kept = F.transform(F.array(lines), lambda ls: F.transform(
        F.array_except(F.sequence(F.lit(1), F.size(ls)), F.col("gone")), lambda i: F.get(ls, i - 1)
    ))[0]
    n_lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(lines)).cast("long")
    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        n_lines.alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
