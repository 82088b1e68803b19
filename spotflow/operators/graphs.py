"""Connected groups of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotflow.operators.lineage import cut


def connected_components(pairs: DataFrame) -> DataFrame:
    """(a, b) pairs → (member, root): root is the smallest id of the group.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so the number of rounds grows with the logarithm of a
    chain's length. Pair rows are only ever joined with one label per id.
    """
    arcs = cut(
        pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct()
    )
    labels = cut(arcs.select(F.col("a").alias("member")).distinct().withColumn("root", F.col("member")))
    while True:
        near = (
            arcs.join(labels.withColumnRenamed("member", "b"), "b")
            .groupBy(F.col("a").alias("member")).agg(F.min("root").alias("_near"))
        )
        stepped = labels.join(near, "member").select(
            "member", F.col("root").alias("_old"), F.least("root", "_near").alias("root")
        )
        stepped = cut(stepped)
        jump = stepped.select(F.col("member").alias("root"), F.col("root").alias("_far"))
        new = cut(
            stepped.join(jump, "root", "left").select(
                "member", F.least("root", "_far").alias("root"), "_old"
            )
        )
        labels = new.drop("_old")
        if new.where("root <> _old").isEmpty():
            return labels


def chain_heads(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(id) rows and (prev_id, id) links → (id, head): the first id of each chain.

    Pointer doubling: every round doubles the distance looked back.
    """
    at = cut(
        rows.select("id").join(links.select("id", "prev_id"), "id", "left")
        .select("id", F.coalesce("prev_id", "id").alias("head"))
    )
    while True:
        far = at.select(F.col("id").alias("head"), F.col("head").alias("_far"))
        new = cut(at.join(far, "head").select("id", F.col("_far").alias("head"), F.col("head").alias("_old")))
        at = new.select("id", "head")
        if new.where("head <> _old").isEmpty():
            return at
