"""Joins of points with regions, lines, nodes and camera rectangles.

All of them join on a grid cell (or a sensor) and then test exactly, so no step
compares every point with every region. No side is broadcast by hand: adaptive
execution does that where the measured size of the dimension allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotflow.functions.columns import cell, euclid, inside_polygon, project_on_segment
from spotflow.operators.lineage import cut
from spotflow.operators.quality import is_aisle


def ignore_flags(df: DataFrame, regions: DataFrame, in_aisle: Column | None = None) -> DataFrame:
    """Add ``ignored``: an aisle row strictly inside a region of its own sensor.

    ``regions``: (sensor, ring) with ring an array<struct<x,y>>. The rings of a
    sensor are gathered first, so the join never multiplies rows.
    """
    rings = regions.groupBy("sensor").agg(F.collect_list("ring").alias("_rings"))
    hit = F.exists("_rings", lambda r: inside_polygon("x", "y", r))
    return df.join(rings, "sensor", "left").select(
        *df.columns,
        (is_aisle(in_aisle) & F.coalesce(hit, F.lit(False))).alias("ignored"),
    )


def outside_ignore_regions(df: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, ignored) rows."""
    flagged = ignore_flags(df, regions)
    return (
        flagged.where(~F.col("ignored")).drop("ignored"),
        flagged.where("ignored").drop("ignored"),
    )


def near_cells(v: str, size: float) -> Column:
    """The cell of a coordinate and its two neighbours."""
    return F.sequence(cell(v, size) - 1, cell(v, size) + 1)


def spread(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Copy each row into the 3 x 3 cells around it (``_cx``, ``_cy``)."""
    return df.withColumn("_cx", F.explode(near_cells(x, size))).withColumn(
        "_cy", F.explode(near_cells(y, size))
    )


def snap_to_roads(points: DataFrame, lines: DataFrame, max_d: float = 20.0,
                  key: str = "id") -> DataFrame:
    """Move each point onto the nearest line within ``max_d``; others stay.

    ``lines``: (line_id, x1, y1, x2, y2). A line is walked in steps of
    ``max_d`` or less and put into the cells of that width around each step, so
    its cells grow with its length. A point in reach is 1.5 ``max_d`` from a step
    at most, two cells. Adds ``line_id`` and ``snap_distance``, null where no
    line is near.

    Equal lines, and points of one place, take part once. Cells of points a quarter as wide keep
    the lines that may be the nearest of one of their points. Of what then meets, only the least
    distance of a place is kept while rows stream by; the lines at just that distance are looked up after.
    """
    ends = ["x1", "y1", "x2", "y2"]
    roads = lines.groupBy(*ends).agg(F.min(F.struct("line_id")).alias("_line"))
    steps = F.greatest(F.lit(1), F.ceil(euclid(*ends) / max_d)).cast("int")

    def step_cell(a: str, b: str, i: Column) -> Column:
        return F.floor((F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n")) / max_d).cast("long")

    def around(v: str) -> Column:
        return F.explode(F.sequence(F.col(f"_{v}") - 2, F.col(f"_{v}") + 2))

    last = F.greatest(F.col("_i") - 1, F.lit(0))
    walked = (
        roads.select(*ends, steps.alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(0), "_n")))
        .select(*ends, "_i", *[step_cell(f"{v}1", f"{v}2", i).alias(f"_{n}{v}") for v in "xy" for n, i in (("", F.col("_i")), ("w", last))])
    )
    # steps go one way in x and in y, so a cell that comes again was around the step before
    fresh = (F.col("_i") == 0) | (F.abs(F.col("_ux") - F.col("_wx")) > 2) | (F.abs(F.col("_uy") - F.col("_wy")) > 2)
    cells = walked.withColumn("_ux", around("x")).withColumn("_uy", around("y")).where(fresh).select(*ends, "_ux", "_uy")

    places = points.select("x", "y").distinct().select("x", "y", *[cell(v, max_d / 4).alias(f"_c{v}") for v in "xy"])
    middle = {f"_m{v}": (F.col(f"_lo{v}") + F.col(f"_hi{v}")) / 2 for v in "xy"}
    fine = (
        places.groupBy("_cx", "_cy").agg(*[f(v).alias(f"_{n}{v}") for v in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
        .withColumns({**middle, "_r": euclid("_lox", "_loy", "_hix", "_hiy") / 2})
        .select("_cx", "_cy", "_mx", "_my", "_r", F.shiftright("_cx", 2).alias("_ux"), F.shiftright("_cy", 2).alias("_uy"))
    )
    gap = project_on_segment("_mx", "_my", *ends)[2]
    # no point of a cell is farther than _r from its middle; the last term is for rounding
    slack = 1e-9 * (F.abs("_mx") + F.abs("_my") + max_d)
    # Adaptive execution takes a table whose rows are still to be exploded for as small as it is before; the cells of all lines would be sent to
    # the driver. The cells of points are hashed instead, one part a task.
    met = fine.hint("shuffle_hash").join(cells, ["_ux", "_uy"]).select("_cx", "_cy", "_r", *ends, gap.alias("_gap"), slack.alias("_slack"))
    met = met.where(F.col("_gap") <= max_d + F.col("_r") + F.col("_slack"))
    least = met.groupBy("_cx", "_cy").agg(F.min("_gap").alias("_least"))
    near = (
        fine.join(least, ["_cx", "_cy"]).hint("shuffle_hash").join(cells, ["_ux", "_uy"])
        .where(gap <= F.least(F.col("_least") + F.col("_r"), F.lit(max_d)) + F.col("_r") + slack)
        .select("_cx", "_cy", *ends)
    )
    qx, qy, d = project_on_segment("x", "y", *ends)
    within = places.join(near, ["_cx", "_cy"]).select("x", "y", d.alias("d")).where(F.col("d") <= max_d)
    shortest = within.groupBy("x", "y").agg(F.min("d").alias("_d"))
    hits = (
        places.join(shortest, ["x", "y"]).join(near, ["_cx", "_cy"]).where(d == F.col("_d"))
        .select("x", "y", *ends, qx.alias("sx"), qy.alias("sy"), F.col("_d").alias("d"))
    )
    order = F.struct("d", "line_id")
    best = (
        points.select(key, "x", "y").join(hits.join(roads, ends), ["x", "y"])
        .select(key, "_line.line_id", "sx", "sy", "d")
        .groupBy(key).agg(F.min_by(F.struct("line_id", "sx", "sy", "d"), order).alias("_s"))
    )
    rest = [c for c in points.columns if c not in ("x", "y")]
    return points.join(best, key, "left").select(
        *rest,
        F.coalesce("_s.sx", "x").alias("x"), F.coalesce("_s.sy", "y").alias("y"),
        F.col("_s.line_id").alias("line_id"), F.col("_s.d").alias("snap_distance"),
    )


def nearest_within(points: DataFrame, nodes: DataFrame, radius: float,
                   key: str = "id") -> DataFrame:
    """Nearest node (node_id, x, y) within the radius: (key, node_id, distance)."""
    near = spread(
        nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny")), radius, "nx", "ny"
    )
    at = points.select(key, "x", "y", cell("x", radius).alias("_cx"), cell("y", radius).alias("_cy"))
    return (
        at.join(near, ["_cx", "_cy"])
        .select(key, "node_id", euclid("x", "y", "nx", "ny").alias("d"))
        .where(F.col("d") <= radius)
        .groupBy(key)
        .agg(F.min_by("node_id", F.struct("d", "node_id")).alias("node_id"), F.min("d").alias("distance"))
    )


#: A cell has 2**BITS x 2**BITS cells on the next grid level; DEEPEST levels at most.
BITS, DEEPEST = 2, 12


def _cell_levels(places: DataFrame, low_x: float, low_y: float, side: float, depth: int, clamp: bool) -> DataFrame:
    """Occupied cells of levels 0 to ``depth``: (level, cx, cy, n, and the box of the places inside).

    ``clamp``: the upper border of the whole square belongs to its last cells.
    """
    finest = places.select("x", "y", *_cell_of(low_x, low_y, side, depth, clamp), F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    up = f"{BITS} * ({depth} - level)"
    return finest.groupBy("level", F.expr(f"shiftright(cx, {up})").alias("cx"), F.expr(f"shiftright(cy, {up})").alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"),
    )


def _cell_of(low_x: float, low_y: float, side: float, level: int, clamp: bool) -> list[Column]:
    n = 2 ** (BITS * level)
    found = [F.floor((F.col(v) - low) / side * n) for v, low in (("x", low_x), ("y", low_y))]
    return [(F.least(c, F.lit(n - 1)) if clamp else c).cast("long").alias(f"c{v}") for c, v in zip(found, "xy")]


def _nearest_only(met: DataFrame) -> DataFrame:
    """Of the boxes (x1, x2, y1, y2) that a place's box (``_x1`` ...) met, those that may hold the node nearest to one of its points.

    Each box holds a node, so no point has farther to go than to the far corner
    of any of them; a box that begins beyond the least such distance is out.
    """
    def gap(v: str) -> Column:
        return F.greatest(F.col(f"_{v}1") - F.col(f"{v}2"), F.col(f"{v}1") - F.col(f"_{v}2"), F.lit(0.0))

    def reach(v: str) -> Column:
        return F.greatest(F.col(f"_{v}2") - F.col(f"{v}1"), F.col(f"{v}2") - F.col(f"_{v}1"))

    bound = F.min(F.hypot(reach("x"), reach("y"))).over(W.partitionBy("_qx", "_qy"))
    return met.withColumn("_bound", bound).where(F.hypot(gap("x"), gap("y")) <= F.col("_bound") * (1 + 1e-9)).drop("_bound")


def nearest_node(points: DataFrame, nodes: DataFrame, key: str = "id", few: int = 16) -> DataFrame:
    """Nearest node of every point, however far: (key, node_id, distance); of equally near ones the least node_id.

    The occupied cells of a grid on several levels are walked from the top, those
    of the points beside those of the nodes: a cell of points keeps the cells of nodes that may hold the
    nearest of one of its points, and only these are opened for the cells inside it. It keeps
    a few on each level, whether it is far from all nodes or beside very many. The levels
    depend on the nodes only: the finest is the first without more than ``few`` nodes in a cell,
    or ``DEEPEST``. Points meet single nodes once, at the end.

    A point without finite coordinates, and every point if no node has them, has
    a null node and distance. Nodes without finite coordinates take no part.
    """
    finite = "x - x = 0 and y - y = 0"
    sites = cut(nodes.where(finite).groupBy("x", "y").agg(F.min("node_id").alias("node_id")))
    box = sites.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        kind = nodes.schema["node_id"].dataType
        return points.select(key, F.lit(None).cast(kind).alias("node_id"), F.lit(None).cast("double").alias("distance"))
    low_x, low_y, side = box[0], box[2], max(box[1] - box[0], box[3] - box[2]) or 1.0
    cells = cut(_cell_levels(sites, low_x, low_y, side, DEEPEST, True))
    fullest = cells.groupBy("level").agg(F.max("n").alias("n")).where((F.col("n") <= few) & (F.col("level") > 0))
    depth = fullest.agg(F.min("level")).first()[0] or DEEPEST
    renamed = {"cx": "_qx", "cy": "_qy", "x1": "_x1", "x2": "_x2", "y1": "_y1", "y2": "_y2"}
    places = cut(points.where(finite).select("x", "y").distinct())
    wanted = cut(_cell_levels(places, low_x, low_y, side, depth, False).withColumnsRenamed(renamed))
    own = list(renamed.values())
    root = F.lit(0).cast("long")
    open_ = wanted.where("level = 0").select(F.col("_qx").alias("_ux"), F.col("_qy").alias("_uy"), root.alias("_px"), root.alias("_py"))
    for level in range(1, depth + 1):
        inside = wanted.where(F.col("level") == level).select(F.shiftright("_qx", BITS).alias("_ux"), F.shiftright("_qy", BITS).alias("_uy"), *own)
        inner = cells.where(F.col("level") == level).select(
            F.shiftright("cx", BITS).alias("_px"), F.shiftright("cy", BITS).alias("_py"), "cx", "cy", "x1", "x2", "y1", "y2"
        )
        if BITS * level <= 4:  # 256 cells at most
            inner = F.broadcast(inner)
        met = inside.join(open_, ["_ux", "_uy"]).join(inner, ["_px", "_py"])
        kept = _nearest_only(met).select(*own, F.col("cx").alias("_px"), F.col("cy").alias("_py"))
        if level % 4 == 0:
            kept = cut(kept)
        open_ = kept.select(F.col("_qx").alias("_ux"), F.col("_qy").alias("_uy"), "_px", "_py")
    open_ = kept
    places = places.select("x", "y", *_cell_of(low_x, low_y, side, depth, False)).withColumnsRenamed({"cx": "_qx", "cy": "_qy"})
    single = sites.select("node_id", "x", "y", *_cell_of(low_x, low_y, side, depth, True)).select(
        F.col("cx").alias("_px"), F.col("cy").alias("_py"),
        "node_id", F.col("x").alias("x1"), F.col("x").alias("x2"), F.col("y").alias("y1"), F.col("y").alias("y2"),
    )
    near = _nearest_only(open_.join(single, ["_px", "_py"])).select("_qx", "_qy", "node_id", F.col("x1").alias("nx"), F.col("y1").alias("ny"))
    found = (
        places.join(near, ["_qx", "_qy"]).select("x", "y", "node_id", euclid("x", "y", "nx", "ny").alias("d"))
        .groupBy("x", "y").agg(F.min_by("node_id", F.struct("d", "node_id")).alias("node_id"), F.min("d").alias("distance"))
    )
    return points.select(key, "x", "y").join(found, ["x", "y"], "left").select(key, "node_id", "distance")


def entrance_node(entrances: DataFrame, nodes: DataFrame, radius: float = 0.005,
                  key: str = "id") -> DataFrame:
    """Entrances with the id of their graph node, null where none is that near."""
    hits = nearest_within(entrances, nodes, radius, key).select(key, "node_id")
    return entrances.join(hits, key, "left")


def covering(points: DataFrame, rects: DataFrame) -> DataFrame:
    """(point, rectangle) pairs, borders included.

    ``rects``: (camera, x1, y1, x2, y2), lower-left and upper-right corner. A
    rectangle lives on the grid level whose cells are just as wide as its
    longer side, so it lies in at most four cells whatever its size. The levels in
    use (a few, at most one per power of two) are the only thing collected.
    """
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1e-9))
    level = F.ceil(F.log2(side)).cast("int")
    graded = rects.withColumn("_level", level).withColumn("_size", F.pow(F.lit(2.0), F.col("_level")))
    levels = [r[0] for r in graded.select("_level").distinct().collect()]

    def idx(v):
        return F.floor(F.col(v) / F.col("_size")).cast("long")

    cells = graded.withColumn("_cx", F.explode(F.sequence(idx("x1"), idx("x2")))).withColumn(
        "_cy", F.explode(F.sequence(idx("y1"), idx("y2")))
    ).drop("_size")
    at = (
        points.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels] or [F.lit(0)])))
        .withColumn("_size", F.pow(F.lit(2.0), F.col("_level")))
        .withColumn("_cx", idx("x")).withColumn("_cy", idx("y")).drop("_size")
    )
    return (
        at.join(cells, ["_level", "_cx", "_cy"])
        .where(F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2")))
        .select(*points.columns, "camera")
    )


def camera_roles(rects: DataFrame, gates: DataFrame) -> DataFrame:
    """Cameras that see an entry or an exit. ``gates``: (type, x, y)."""
    seen = (
        covering(gates.select("type", "x", "y"), rects)
        .groupBy("camera")
        .agg(
            F.max((F.col("type") == "entry").cast("int")).alias("_in"),
            F.max((F.col("type") == "exit").cast("int")).alias("_out"),
        )
    )
    return rects.join(seen, "camera", "left").select(
        "camera",
        F.coalesce("_in", F.lit(0)).alias("is_entry_camera"),
        F.coalesce("_out", F.lit(0)).alias("is_exit_camera"),
    )
