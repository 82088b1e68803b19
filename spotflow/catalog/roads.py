"""Road network queries. Lines are the ways of vehicles, one per vehicle and day."""

from pyspark.sql import functions as F

from spotflow.catalog.base import query, r4, us
from spotflow.operators import roads


def _polylines(d, grid=None):
    def place(c):
        return (F.floor(F.col(c) / grid) * float(grid)) if grid else F.col(c)

    point = F.struct("ts", "id", place("x").alias("x"), place("y").alias("y"))
    way = F.array_sort(F.collect_list(point))
    return d.groupBy(F.concat_ws("/", "license", F.to_date("ts").cast("string")).alias("line_id")).agg(
        F.transform(way, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("points")
    )


SEG = """s AS (SELECT license || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS line_id, row_number() OVER w - 1 AS segment,
    gx AS x1, gy AS y1, lead(gx) OVER w AS x2, lead(gy) OVER w AS y2
  FROM (SELECT *, {x} AS gx, {y} AS gy FROM d) WINDOW w AS (PARTITION BY license, CAST(ts AS DATE) ORDER BY ts, id)
  QUALIFY x2 IS NOT NULL)"""
PLAIN = SEG.format(x="x", y="y")
GRID = SEG.format(x="floor(x / 20) * 20.0", y="floor(y / 20) * 20.0")


@query("segments", f"WITH {{D}}, {PLAIN} SELECT line_id, segment, x1, y1, x2, y2 FROM s")
def segments(d):
    return roads.segments(_polylines(d)).select("line_id", F.col("segment").cast("long"), "x1", "y1", "x2", "y2")


DENSE = """t AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM s),
k AS (SELECT *, unnest(range(0, CAST(floor(floor(len) / 3) AS BIGINT) + 1)) AS i FROM t),
a AS (SELECT line_id, segment, len, x1, y1, x2, y2, CASE WHEN x2 > x1 THEN i * 3.0 ELSE len - i * 3.0 END AS pt FROM k
  UNION SELECT line_id, segment, len, x1, y1, x2, y2, CAST(0 AS DOUBLE) FROM t UNION SELECT line_id, segment, len, x1, y1, x2, y2, len FROM t),
q AS (SELECT line_id, segment, row_number() OVER (PARTITION BY line_id, segment ORDER BY pt) - 1 AS pos,
  CASE WHEN len = 0 THEN x1 ELSE x1 + (x2 - x1) * pt / len END AS x, CASE WHEN len = 0 THEN y1 ELSE y1 + (y2 - y1) * pt / len END AS y FROM a)"""


@query("densify", f"""WITH {{D}}, {PLAIN}, {DENSE}
SELECT line_id, segment, count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(max(x + 2 * y), 3) AS far FROM q GROUP BY ALL""")
def densify(d):
    points = roads.densify(roads.segments(_polylines(d)), 3.0)
    return points.groupBy("line_id", F.col("segment").cast("long").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("y"), 3).alias("y"),
        F.round(F.max(F.col("x") + 2 * F.col("y")), 3).alias("far"))


def _graph(d):
    segs = roads.segments(_polylines(d, 20))
    ends = segs.select("line_id", "segment", F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y")),
        F.struct(F.lit(1).alias("pos"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select(
        "line_id", "segment", "p.*")
    nodes = roads.build_nodes(ends)
    return nodes, roads.build_edges(ends, nodes)


NODE = "CAST(CAST(round({x} * 10) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round({y} * 10) AS BIGINT) AS VARCHAR)"
GRAPH = f"""e0 AS (SELECT {NODE.format(x='x1', y='y1')} AS n, {NODE.format(x='x2', y='y2')} AS m, x1, y1, x2, y2 FROM s),
nodes AS (SELECT DISTINCT n AS node_id, x1 AS x, y1 AS y FROM e0 UNION SELECT DISTINCT m, x2, y2 FROM e0),
edges AS (SELECT DISTINCT least(n, m) AS a, greatest(n, m) AS b, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS weight FROM e0 WHERE n <> m)"""


@query("build_nodes", f"WITH {{D}}, {GRID}, {GRAPH} SELECT node_id, x, y FROM nodes")
def build_nodes(d):
    return _graph(d)[0]


@query("build_edges", f"WITH {{D}}, {GRID}, {GRAPH} SELECT a, b, round(weight, 4) AS weight FROM edges")
def build_edges(d):
    return _graph(d)[1].select("a", "b", r4("weight"))


def _sources(nodes):
    """The two nodes at the ends of the alphabet."""
    ends = nodes.agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"))
    return ends.select(F.explode(F.array("a", "b")).alias("node_id"))


@query("shortest_paths", f"""WITH RECURSIVE {{D}}, {GRID}, {GRAPH},
arcs AS (SELECT a AS src, b AS dst, weight FROM edges UNION ALL SELECT b, a, weight FROM edges),
t(source, node, distance) USING KEY (source, node) AS (
  SELECT node_id, node_id, CAST(0 AS DOUBLE) FROM (SELECT min(node_id) AS node_id FROM nodes UNION SELECT max(node_id) FROM nodes)
  UNION SELECT t.source, arcs.dst, min(t.distance + arcs.weight) FROM t JOIN arcs ON arcs.src = t.node
    LEFT JOIN recurring.t AS r ON r.node = arcs.dst AND r.source = t.source
    WHERE r.distance IS NULL OR t.distance + arcs.weight < r.distance - 1e-9 GROUP BY t.source, arcs.dst)
SELECT source, node, round(distance, 3) AS distance FROM t""")
def shortest_paths(d):
    nodes, edges = _graph(d)
    return roads.shortest_paths(edges, _sources(nodes)).select("source", "node", F.round("distance", 3).alias("distance"))


@query("path_nodes")
def path_nodes(d):
    nodes, edges = _graph(d)
    found = roads.cut(roads.shortest_paths(edges, _sources(nodes)))
    targets = found.select("source", F.col("node").alias("target"))
    return roads.paths_to(found, targets).select("source", "target", F.col("seq").cast("long"), "node", r4("distance"))


@query("interpolate_path", f"""WITH {{D}},
p AS (SELECT license AS path_id, row_number() OVER (PARTITION BY license ORDER BY ts, id) AS seq, x, y FROM d),
l AS (SELECT path_id, seq, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM p WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
m AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS dd FROM l WHERE nx IS NOT NULL),
c AS (SELECT *, sum(dd) OVER (PARTITION BY path_id ORDER BY seq) AS till, sum(dd) OVER (PARTITION BY path_id) AS total FROM m WHERE dd > 0),
k AS (SELECT DISTINCT path_id, total, unnest([i * 500000 for i in range(0, 120)] || [59750000]) AS us FROM c),
f AS (SELECT k.path_id, k.us, arg_min(c.x + (c.nx - c.x) * (k.us / 59750000 * k.total - (c.till - c.dd)) / c.dd, c.seq) AS x,
    arg_min(c.y + (c.ny - c.y) * (k.us / 59750000 * k.total - (c.till - c.dd)) / c.dd, c.seq) AS y
  FROM k JOIN c ON c.path_id = k.path_id AND k.us / 59750000 * k.total <= c.till + 1e-7 GROUP BY ALL)
SELECT path_id, 1704067200000000 + us AS ts, round(x, 2) AS x, round(y, 2) AS y FROM f""")
def interpolate_path(d):
    from spotflow.operators.ordered import numbered

    points = numbered(d.select("license", "ts", "id", "x", "y"), ["license"], ["ts", "id"], "seq").withColumnRenamed("license", "path_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    times = points.select("path_id").distinct().select(
        "path_id", start.alias("t0"), F.timestamp_micros(F.unix_micros(start) + 59_750_000).alias("t1"))
    out = roads.interpolate_path(points, times, 0.5)
    return out.select("path_id", us("ts"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))
