"""Exact dedup against a digest index that stays on disk.

The index is a table bucketed and sorted by digest. A batch of documents is
first reduced to one row per digest, combined before the shuffle, so copies of
a hot text cost one row per task. These rows meet the index in a sort-merge
anti-join that leaves the index where it lies; unseen digests are appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spotflow.llm.common import stored, width

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. Pure ASCII takes the faster ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def digest(column: str = "text") -> Column:
    """SHA-256 of the text in lower case (A-Z only), as hex; null counts as empty."""
    return F.sha2(lower_ascii(F.coalesce(column, F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, with the document kept for each and the batch that brought it.

    A batch added again under its own name finds the same answer and changes
    nothing: rows of that name do not count as seen before.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.table = spark, table
        at = f"LOCATION '{path}'" if path else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets or width(spark)} BUCKETS {at}"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _before(self, batch: str) -> DataFrame:
        return self.rows().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("_seen_id"), F.lit(True).alias("_seen"))

    def _append(self, groups: DataFrame, batch: str) -> None:
        groups.hint("merge").join(self.rows(), "digest", "left_anti").select(
            "digest", "keep_id", F.lit(batch).alias("batch")
        ).write.insertInto(self.table)

    def decide(self, docs: DataFrame, batch: str) -> DataFrame:
        """(doc_id, text) → doc_id, keep_id, group_size, kept, text_sha256; one row for each row.

        * Of equal texts the row with the largest doc_id stays, or none if an
          earlier batch has the text; ``keep_id`` then is the id kept there.
        * ``group_size`` counts the rows of this batch with the text.
        * Null and empty texts are equal. A null doc_id is smaller than any other.
        * Of rows alike in doc_id and text one stays, whichever.
        """
        one = stored(docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"),
            F.monotonically_increasing_id().alias("_row"),
        ))
        rank = F.struct(F.col("doc_id").isNotNull(), "doc_id", "_row")
        groups = stored(one.groupBy("digest").agg(
            F.max_by(F.struct(F.col("doc_id").alias("keep_id"), F.col("_row").alias("_keep")), rank).alias("_k"),
            F.count(F.lit(1)).alias("group_size"),
        ).select("digest", "_k.*", "group_size").hint("merge").join(self._before(batch), "digest", "left"))
        self._append(groups, batch)
        return one.hint("merge").join(groups, "digest").select(
            "doc_id",
            F.when(F.col("_seen"), F.col("_seen_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            "group_size",
            (F.col("_seen").isNull() & (F.col("_row") == F.col("_keep"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )

    def keep(self, docs: DataFrame, batch: str) -> DataFrame:
        """The whole rows that stay, by the rules of :meth:`decide`; all columns as they came."""
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        rank = F.struct(F.col("doc_id").isNotNull(), "doc_id")
        groups = docs.select(digest().alias("digest"), rank.alias("rank"), row.alias("row")).groupBy("digest").agg(
            F.max_by("row", "rank").alias("row")
        )
        kept = stored(groups.hint("merge").join(self._before(batch), "digest", "left_anti"))
        self._append(kept.select("digest", F.col("row.doc_id").cast("long").alias("keep_id")), batch)
        return kept.select("row.*")
