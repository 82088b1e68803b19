"""Road network: segments, dense points, nodes, edges, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from spotflow.functions.columns import euclid, point_along
from spotflow.operators.lineage import cut
from spotflow.operators.ordered import chunked

LEGS = 10_000


def segments(polylines: DataFrame) -> DataFrame:
    """(line_id, points) → consecutive point pairs (line_id, segment, x1, y1, x2, y2)."""
    n = F.size("points")
    head = F.slice(F.col("points"), F.lit(1), F.greatest(n - 1, F.lit(0)))
    tail = F.slice(F.col("points"), F.lit(2), F.greatest(n - 1, F.lit(0)))
    return polylines.select("line_id", F.posexplode(F.arrays_zip(head.alias("a"), tail.alias("b")))).select(
        "line_id", F.col("pos").alias("segment"),
        F.col("col.a.x").alias("x1"), F.col("col.a.y").alias("y1"),
        F.col("col.b.x").alias("x2"), F.col("col.b.y").alias("y2"),
    )


def densify(segs: DataFrame, step: float = 3.0) -> DataFrame:
    """Points every ``step`` along each segment, both ends included: (…, pos, x, y).

    The whole part of the length decides how many inner points there are. They
    are laid out from the end with the smaller x, as the network builder needs
    the same points whichever way a segment is drawn.
    """
    length = euclid("x1", "y1", "x2", "y2")
    inner = F.floor(F.floor(length) / step).cast("int")
    forward = F.col("x2") > F.col("x1")
    offsets = F.transform(F.sequence(F.lit(0), inner), lambda k: k * F.lit(float(step)))
    placed = F.transform(offsets, lambda o: F.when(forward, o).otherwise(length - o))
    stops = F.array_sort(F.array_distinct(F.concat(placed, F.array(F.lit(0.0), length))))
    x, y = point_along(
        "x1", "y1", "x2", "y2",
        F.when(F.col("length") == 0, F.lit(0.0)).otherwise(F.col("at") / F.col("length")),
    )
    return (
        segs.withColumn("length", length)
        .select("*", F.posexplode(stops).alias("pos", "at"))
        .select("line_id", "segment", "pos", x.alias("x"), y.alias("y"))
    )


def node_of(points: DataFrame, size: float = 0.1) -> DataFrame:
    """Add the grid cell that stands for the point's node (``_nx``, ``_ny``)."""
    return points.withColumn("_nx", F.round(F.col("x") / size).cast("long")).withColumn(
        "_ny", F.round(F.col("y") / size).cast("long")
    )


def build_nodes(points: DataFrame, size: float = 0.1) -> DataFrame:
    """One node per cell of the given size: (node_id, x, y), the first point's place.

    Points less than half a cell apart may still fall into two cells; the
    assignment does not depend on the order of arrival.
    """
    order = F.struct("line_id", "segment", "pos")
    return (
        node_of(points, size)
        .groupBy("_nx", "_ny")
        .agg(F.min_by(F.struct("x", "y"), order).alias("p"))
        .select(
            F.concat_ws(":", "_nx", "_ny").alias("node_id"),
            F.col("p.x").alias("x"), F.col("p.y").alias("y"),
        )
    )


def build_edges(points: DataFrame, nodes: DataFrame, size: float = 0.1) -> DataFrame:
    """Undirected edges (a < b) between neighbours on a line, weighted by length."""
    w = W.partitionBy("line_id", "segment").orderBy("pos")
    here = F.concat_ws(":", "_nx", "_ny")
    pairs = (
        node_of(points, size)
        .select("line_id", "segment", here.alias("n"), F.lead(here).over(w).alias("m"))
        .where(F.col("m").isNotNull() & (F.col("n") != F.col("m")))
        .select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b"))
        .distinct()
    )
    na = nodes.select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    nb = nodes.select(F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return (
        pairs.join(na, "a").join(nb, "b")
        .select("a", "b", euclid("ax", "ay", "bx", "by").alias("weight"))
    )


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")
    )


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Distances from each source: (source, node, distance, previous).

    Relaxation in rounds: only nodes whose distance improved send it on, until
    none does. Each round is checkpointed. Nodes out of reach are absent.
    """
    arcs = cut(both_ways(edges))
    start = sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("node")).distinct()
    best = cut(
        start.select("source", "node", F.lit(0.0).alias("distance"), F.lit(None).cast("string").alias("previous"))
    )
    front = best
    while not front.isEmpty():
        offers = (
            front.join(arcs, front["node"] == arcs["src"])
            .select("source", arcs["dst"].alias("node"),
                    (F.col("distance") + F.col("weight")).alias("d"), front["node"].alias("via"))
            .groupBy("source", "node")
            .agg(F.min("d").alias("d_new"), F.min_by("via", F.struct("d", "via")).alias("p_new"))
        )
        merged = cut(
            best.join(offers, ["source", "node"], "full").select(
                "source", "node",
                F.least("distance", "d_new").alias("distance"),
                F.when(F.col("distance").isNull() | (F.col("d_new") < F.col("distance")), F.col("p_new"))
                .otherwise(F.col("previous")).alias("previous"),
                (F.col("distance").isNull() | F.coalesce(F.col("d_new") < F.col("distance"), F.lit(False)))
                .alias("_better"),
            )
        )
        front = merged.where("_better").drop("_better")
        best = merged.drop("_better")
    return best


def paths_to(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Node lists of shortest paths: (source, target, seq, node, distance).

    ``targets``: (source, target). Walks back from all targets at once, one
    node per round.
    """
    at = targets.join(
        found.select("source", F.col("node").alias("target"), "distance", "previous"),
        ["source", "target"],
    ).select("source", "target", F.col("target").alias("node"), "distance", "previous")
    steps = found.select("source", F.col("node").alias("previous"),
                         F.col("distance").alias("_d"), F.col("previous").alias("_p"))
    walked = at = cut(at)
    while not at.where("previous is not null").isEmpty():
        at = cut(
            at.where("previous is not null").join(steps, ["source", "previous"])
            .select("source", "target", F.col("previous").alias("node"),
                    F.col("_d").alias("distance"), F.col("_p").alias("previous"))
        )
        walked = walked.unionByName(at)
    seq = F.row_number().over(W.partitionBy("source", "target").orderBy("distance", "node")) - 1
    return walked.select("source", "target", seq.alias("seq"), "node", "distance")


def interpolate_path(points: DataFrame, times: DataFrame, step_s: float = 0.5) -> DataFrame:
    """Positions every ``step_s`` along each path at constant speed, ends included.

    ``points``: (path_id, seq, x, y), seq without gaps; ``times``: (path_id, t0, t1).
    Each leg emits the ticks that fall on it, so no path is compared with all
    ticks. Lengths are summed in chunks of a path, then over the chunks.
    """
    w = W.partitionBy("path_id", "_chunk").orderBy("seq")
    spread = chunked(points, "seq", LEGS, 1).withColumns(
        {"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}
    )
    legs = spread.where(F.col("_home") & F.col("nx").isNotNull()).withColumn(
        "d", euclid("x", "y", "nx", "ny")
    ).where("d > 0")
    chunks = legs.groupBy("path_id", "_chunk").agg(F.sum("d").alias("_d"))
    past = W.partitionBy("path_id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = chunks.select(
        "path_id", "_chunk", F.coalesce(F.sum("_d").over(past), F.lit(0.0)).alias("_offset")
    )
    totals = legs.groupBy("path_id").agg(F.sum("d").alias("total"), F.max("seq").alias("_end"))
    within = w.rowsBetween(W.unboundedPreceding, -1)
    legs = (
        legs.withColumn("_from", F.coalesce(F.sum("d").over(within), F.lit(0.0)))
        .join(offsets, ["path_id", "_chunk"]).join(totals, "path_id")
        .withColumn("from_d", F.col("_from") + F.col("_offset"))
    )
    micros = F.unix_micros("t1") - F.unix_micros("t0")
    timed = legs.join(times, "path_id").withColumn("_us", micros).where("_us > 0")
    tick = int(step_s * 1_000_000)
    last = F.col("seq") == F.col("_end")
    first_k = F.ceil(F.col("from_d") / F.col("total") * F.col("_us") / tick).cast("long")
    past_k = F.ceil((F.col("from_d") + F.col("d")) / F.col("total") * F.col("_us") / tick).cast("long") - 1
    end_k = F.floor(F.col("_us") / tick).cast("long")
    ks = F.when(last, F.sequence(first_k, end_k)).otherwise(
        F.when(past_k >= first_k, F.sequence(first_k, past_k))
    )
    ks = F.when(~last | (end_k >= first_k), ks)
    at_us = F.transform(ks, lambda k: k * F.lit(tick))
    ended = F.when(
        last & (F.col("_us") % tick != 0), F.array_append(F.coalesce(at_us, F.array().cast("array<bigint>")), F.col("_us"))
    ).otherwise(at_us)
    share = (F.col("us") / F.col("_us") * F.col("total") - F.col("from_d")) / F.col("d")
    x, y = point_along("x", "y", "nx", "ny", share)
    return timed.select("*", F.explode(ended).alias("us")).select(
        "path_id",
        F.timestamp_micros(F.unix_micros("t0") + F.col("us")).alias("ts"),
        x.alias("x"), y.alias("y"),
    )
