"""Queries of the geometry, spatial and graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroute.functions import geometry as G
from skyroute.jobs import oracles as O
from skyroute.jobs import world
from skyroute.operators import graph, measures, spatial, vertices
from skyroute.sources.staging import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return vertices.explode_vertices(world.obstacles(spark, sf, raw=True))


def _obstacles(spark: SparkSession, sf: str) -> DataFrame:
    return vertices.explode_vertices(world.obstacles(spark, sf))


_KEY = "area, polygon_id, ring_idx, vertex_idx"


@query(f"WITH {O.RINGS}, {O.vertices('raw_turn')} SELECT {_KEY}, x, y FROM verts")
def explode_vertices(spark, sf):
    return _raw(spark, sf).select("area", "polygon_id", "ring_idx", "vertex_idx", "x", "y")


@query(f"WITH {O.RINGS}, {O.vertices('raw_turn')} SELECT {_KEY}, n, left_x, left_y, right_x, right_y FROM verts")
def with_neighbors(spark, sf):
    return _raw(spark, sf).select("area", "polygon_id", "ring_idx", "vertex_idx", "n", "left_x", "left_y", "right_x", "right_y")


@query(f"WITH {O.RINGS}, {O.vertices('norm_turn')} SELECT area, polygon_id, ring_idx, x, y, left_x, left_y FROM verts")
def normalize_winding(spark, sf):
    fixed = vertices.explode_vertices(vertices.normalize_winding(world.obstacles(spark, sf, raw=True)))
    return fixed.select("area", "polygon_id", "ring_idx", "x", "y", "left_x", "left_y")


@query(f"WITH {O.RINGS}, {O.vertices('raw_turn')} SELECT {_KEY}, x x1, y y1, left_x x2, left_y y2 FROM verts")
def ring_edges(spark, sf):
    return vertices.ring_edges(_raw(spark, sf))


_TAU = "6.283185307179586"


def _angle_sql(x, y, tx, ty):
    a = f"atan2({ty} - {y}, {tx} - {x})"
    return f"(CASE WHEN {a} < 0 THEN {a} + {_TAU} ELSE {a} END)"


@query(
    f"WITH {O.PATHS}, p AS (SELECT *, 500.0 cx, 499.5 cy FROM paths) SELECT path_id, seq, round({_angle_sql('cx', 'cy', 'x', 'y')}, 9) angle, "
    f"round({O.direction('cx', 'cy', 'x', 'y')}, 12) direction, {O.between(O.direction('cx', 'cy', 'x', 'y'), '3.5', '1.0')} between_sides FROM p"
)
def angles(spark, sf):
    at = (F.lit(500.0), F.lit(499.5), "x", "y")
    d = G.direction(*at)
    return world.paths(spark, sf).select(
        "path_id", "seq", F.round(G.angle_to(*at), 9).alias("angle"), F.round(d, 12).alias("direction"), G.angle_is_between(d, 3.5, 1.0).alias("between_sides")
    )


@query(
    f"WITH {O.PATHS} SELECT path_id, seq, CAST(row_number() OVER (PARTITION BY path_id ORDER BY "
    f"{O.direction('500.0', '499.5', 'x', 'y')}, {O.distance('500.0', '499.5', 'x', 'y')}, seq) AS INTEGER) place FROM paths"
)
def angular_rank(spark, sf):
    return measures.angular_rank(world.paths(spark, sf), "path_id", F.lit(500.0), F.lit(499.5), "seq").select("path_id", "seq", "place")


@query(
    f"WITH {O.RINGS}, {O.vertices('norm_turn')} SELECT {_KEY}, {_angle_sql('x', 'y', 'right_x', 'right_y')} - {_angle_sql('x', 'y', 'left_x', 'left_y')} "
    "> 3.141592653589793 concave FROM verts"
)
def is_locally_concave(spark, sf):
    fixed = vertices.explode_vertices(vertices.normalize_winding(world.obstacles(spark, sf, raw=True)))
    return fixed.select("area", "polygon_id", "ring_idx", "vertex_idx", G.is_locally_concave().alias("concave"))


@query(
    f"WITH {O.OBSTACLES} SELECT area, polygon_id, vertex_idx, {O.enters('v', '500.0', '500.0')} inside, "
    f"CAST({O.turn(('x', 'y'), ('left_x', 'left_y'), ('500.0', '500.0'))} AS INTEGER) side FROM obst v"
)
def intersects_polygon_locally(spark, sf):
    """With the side of the next edge on which the target lies."""
    side = G.orientation("x", "y", "left_x", "left_y", 500.0, 500.0).cast("int")
    return _obstacles(spark, sf).select("area", "polygon_id", "vertex_idx", G.enters_polygon(F.lit(500.0), F.lit(500.0)).alias("inside"), side.alias("side"))


def _segments(spark, sf):
    """Each order's path segment, and a wall."""
    w = world.paths(spark, sf)
    return w.select("path_id", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 300).alias("bx"), (F.col("y") + F.col("seq") % 7 * 100 - 300).alias("by"))


_SEG = f"{O.PATHS}, seg AS (SELECT path_id, seq, x ax, y ay, x + 300 bx, y + seq % 7 * 100 - 300 by_ FROM paths)"
_T = "((600 - ax) * 300 - (300 - ay) * 0) / d"


@query("""SELECT o_orderkey, CAST(sign((12 * o - ax) * (24 * o - ay) - (12 * o - ay) * (24 * o - ax)) AS INTEGER) turn
FROM (SELECT o_orderkey, 9007199254740992::HUGEINT o, 4503599627370496 + o_orderkey % 256 ax, 4503599627370496 + o_custkey % 256 ay FROM orders)""")
def orientation_exact(spark, sf):
    """Points within a few last places of (0.5, 0.5) against the diagonal, where doubles often turn the wrong way."""
    o = world.table(spark, sf, "orders").selectExpr("o_orderkey", "0.5D + o_orderkey % 256 * pow(2D, -53) ax", "0.5D + o_custkey % 256 * pow(2D, -53) ay")
    return o.select("o_orderkey", G.orientation_exact("ax", "ay", 12.0, 12.0, 24.0, 24.0).cast("int").alias("turn"))


@query(f"""WITH {_SEG}, rel AS (
  SELECT *, bx - ax rx, by_ - ay ry, 600 - ax qx, 300 - ay qy, (bx - ax) * 300 - (by_ - ay) * 0 d FROM seg
), tu AS (SELECT *, CASE WHEN d <> 0 THEN qx * (300 / d) - qy * (0 / d) END t, CASE WHEN d <> 0 THEN qx * (ry / d) - qy * (rx / d) END u FROM rel)
SELECT path_id, seq, CASE WHEN d = 0 THEN CASE WHEN qx * ry - qy * rx = 0 THEN 'collinear' ELSE 'parallel' END
  WHEN t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN 'intersecting' ELSE 'disjoint' END relation,
  CASE WHEN t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN round(ax + t * rx, 6) END x, CASE WHEN t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN round(ay + t * ry, 6) END y FROM tu""")
def line_relation(spark, sf):
    """Segments of 300 units against a wall from (600, 300) to (600, 600)."""
    s = _segments(spark, sf)
    rel = G.line_relation(("ax", "ay", "bx", "by", 0.0, 1.0), (600.0, 300.0, 600.0, 600.0, 0.0, 1.0))
    return s.select("path_id", "seq", rel.alias("r")).select("path_id", "seq", "r.relation", F.round("r.x", 6).alias("x"), F.round("r.y", 6).alias("y"))


@query(f"""WITH {_SEG}, rel AS (
  SELECT *, bx - ax rx, by_ - ay ry, 600 - ax qx, 300 - ay qy, (bx - ax) * 300 - (by_ - ay) * 0 d FROM seg
), tu AS (SELECT *, CASE WHEN d <> 0 THEN qx * (300 / d) - qy * (0 / d) END t, CASE WHEN d <> 0 THEN qx * (ry / d) - qy * (rx / d) END u FROM rel)
SELECT path_id, seq, CASE WHEN t >= 0 AND u > 0 AND u < 1 THEN round(ax + t * rx, 6) END x, CASE WHEN t >= 0 AND u > 0 AND u < 1 THEN round(ay + t * ry, 6) END y FROM tu""")
def proper_ray_hit(spark, sf):
    """Rays along the same segments against the wall."""
    s = _segments(spark, sf)
    hit = G.proper_ray_hit(("ax", "ay", "bx", "by"), (600.0, 300.0, 600.0, 600.0))
    return s.select("path_id", "seq", hit.alias("h")).select("path_id", "seq", F.round("h.x", 6).alias("x"), F.round("h.y", 6).alias("y"))


@query(f"""WITH {O.PATHS}, steps AS (
  SELECT *, lead(x) OVER w nx, lead(y) OVER w ny FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY seq)
), cum AS (
  SELECT *, {O.distance('x', 'y', 'nx', 'ny')} len, sum({O.distance('x', 'y', 'nx', 'ny')}) OVER (PARTITION BY path_id ORDER BY seq) total FROM steps WHERE nx IS NOT NULL
), first_hit AS (SELECT path_id, arg_min(struct_pack(x := x, y := y, nx := nx, ny := ny, len := len, total := total), seq) h FROM cum WHERE total >= 1500 GROUP BY path_id)
SELECT path_id, round(h.x + (1500 - (h.total - h.len)) / h.len * (h.nx - h.x), 4) x, round(h.y + (1500 - (h.total - h.len)) / h.len * (h.ny - h.y), 4) y
FROM (SELECT DISTINCT path_id FROM paths) LEFT JOIN first_hit USING (path_id)""")
def point_at_length(spark, sf):
    p = measures.point_at_length(world.paths(spark, sf), F.lit(1500.0))
    return p.select("path_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""SELECT o_orderkey, CAST(1000 + 0.25 * (o_orderkey % 1000) AS DOUBLE) x, CAST(9000 - 0.5 * (o_orderkey // 7 % 1000) AS DOUBLE) y,
  CAST(trunc((o_totalprice / 100 - 1000) / 0.25) AS INTEGER) px, CAST(trunc((o_totalprice / 50 - 9000) / -0.5) AS INTEGER) py FROM orders""")
def pixel_to_geo(spark, sf):
    """Both directions of a raster's affine transform."""
    t = world.table(spark, sf, "orders")
    a = (1000.0, 0.25, 0.0, 9000.0, 0.0, -0.5)
    x, y = G.pixel_to_geo(F.col("o_orderkey") % 1000, F.floor(F.col("o_orderkey") / 7) % 1000, *a)
    px, py = G.geo_to_pixel(F.col("o_totalprice") / 100, F.col("o_totalprice") / 50, *a)
    return t.select("o_orderkey", x.alias("x"), y.alias("y"), px.alias("px"), py.alias("py"))


_IN = """(SELECT p.area, p.{id} id, polygon_id FROM {points} p JOIN obst o ON p.area = o.area AND o.y <> o.left_y AND least(o.y, o.left_y) <= p.y AND p.y < greatest(o.y, o.left_y)
  AND o.x + (p.y - o.y) * (o.left_x - o.x) / (o.left_y - o.y) > p.x GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(f"WITH {O.OBSTACLES}, {O.PROBES} SELECT id point_id, polygon_id FROM {_IN.format(points='probes', id='point_id')}")
def points_in_polygons(spark, sf):
    return spatial.points_in_polygons(world.probes(spark, sf), world.obstacles(spark, sf))


@query(f"WITH {O.OBSTACLES}, {O.PROBES} SELECT area, point_id, x, y FROM probes WHERE point_id NOT IN (SELECT id FROM {_IN.format(points='probes', id='point_id')})")
def points_in_polygons__anti(spark, sf):
    return spatial.points_in_polygons(world.probes(spark, sf), world.obstacles(spark, sf), "anti").select("area", "point_id", "x", "y")


@query(f"""WITH {O.ZONES} SELECT o_orderkey query_id, zone_id FROM (SELECT o_orderkey, CAST(o_orderkey % 2000 AS DOUBLE) x, CAST(o_orderkey // 10 % 2000 AS DOUBLE) y FROM orders)
  JOIN zones ON min_x <= x + 120 AND max_x >= x AND min_y <= y + 80 AND max_y >= y""")
def bbox_intersects(spark, sf):
    """The zones that each order's box of 120 x 80 meets."""
    q = world.table(spark, sf, "orders").selectExpr("o_orderkey query_id", "double(o_orderkey % 2000) min_x", "double(o_orderkey div 10 % 2000) min_y")
    q = q.selectExpr("*", "min_x + 120 max_x", "min_y + 80 max_y")
    return spatial.bbox_intersects(world.zones(spark, sf), q)


NODES = f"""{O.OBSTACLES}, {O.WATERS}, every AS (
  SELECT area, CAST(polygon_id AS BIGINT) * 268435456 + ring_idx * 1048576 + vertex_idx node_id, 'obstacle' kind, x, y, left_x, left_y, right_x, right_y FROM obst
  UNION ALL SELECT area, 4611686018427387904 + CAST(polygon_id AS BIGINT) * 268435456 + ring_idx * 1048576 + vertex_idx, 'water', x, y, left_x, left_y, right_x, right_y FROM lake
)"""
# a way is blocked where it crosses an edge, or where a vertex lies on it and it enters the corner there on either side
_ON = f"""({O.turn(('a.x', 'a.y'), ('b.x', 'b.y'), ('e.x', 'e.y'))} = 0 AND (e.x - a.x) * (b.x - a.x) + (e.y - a.y) * (b.y - a.y) > 0
      AND (e.x - b.x) * (a.x - b.x) + (e.y - b.y) * (a.y - b.y) > 0 AND ({O.enters('e', 'b.x', 'b.y')} OR {O.enters('e', 'a.x', 'a.y')}))"""
PAIR = f"""({O.distance('a.x', 'a.y', 'b.x', 'b.y')} <= 0.5 OR (
    NOT (a.kind = 'obstacle' AND {O.enters('a', 'b.x', 'b.y')}) AND NOT (b.kind = 'obstacle' AND {O.enters('b', 'a.x', 'a.y')})
    AND NOT EXISTS (SELECT 1 FROM obst e WHERE e.area = a.area AND greatest(e.x, e.left_x) >= least(a.x, b.x) AND least(e.x, e.left_x) <= greatest(a.x, b.x)
      AND greatest(e.y, e.left_y) >= least(a.y, b.y) AND least(e.y, e.left_y) <= greatest(a.y, b.y)
      AND ({O.crosses(('a.x', 'a.y'), ('b.x', 'b.y'), ('e.x', 'e.y'), ('e.left_x', 'e.left_y'))} OR {_ON}))))"""
_GRAPH = f"""edges AS (
  SELECT a.area, a.node_id src, b.node_id dst, {O.distance('a.x', 'a.y', 'b.x', 'b.y')} length FROM every a JOIN every b ON a.area = b.area AND a.node_id < b.node_id WHERE {PAIR}
)"""


@query(f"""WITH {O.OBSTACLES}, p AS (SELECT area, CAST(polygon_id AS BIGINT) * 268435456 + vertex_idx node_id, x, y FROM obst) SELECT a.node_id src, b.node_id dst FROM p a JOIN p b
  ON a.area = b.area AND a.node_id < b.node_id AND abs(a.x - b.x) <= 12 AND {O.distance('a.x', 'a.y', 'b.x', 'b.y')} <= 12""")
def same_location_pairs(spark, sf):
    """With a tolerance of 12 units, so that the towns have such pairs."""
    nodes = graph.node_table(_obstacles(spark, sf), "obstacle", 0).select("area", "node_id", "x", "y")
    return spatial.same_location_pairs(nodes, 12.0)


@query(f"""WITH {O.OBSTACLES}, every AS (SELECT area, CAST(polygon_id AS BIGINT) * 268435456 + vertex_idx node_id, 'obstacle' kind, x, y, left_x, left_y, right_x, right_y FROM obst), {_GRAPH}
  SELECT src, dst, round(length, 6) length FROM edges""")
def visible_pairs(spark, sf):
    nodes = graph.node_table(_obstacles(spark, sf), "obstacle", 0)
    pairs = spatial.visible_pairs(cut(nodes, "nodes"), cut(vertices.walls(_obstacles(spark, sf)), "walls"))
    return pairs.select("src", "dst", F.round("length", 6).alias("length"))


@query(f"""WITH {O.REQUESTS}, {O.WATERS}, w AS (SELECT area, CAST(polygon_id AS BIGINT) * 268435456 + vertex_idx node_id, x, y FROM lake)
  SELECT request_id, node_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY {O.distance('x', 'y', 'end_x', 'end_y')}, node_id) AS INTEGER) place
  FROM reqs JOIN w USING (area) WHERE {O.distance('start_x', 'start_y', 'x', 'y')} <= max_initial""")
def recharge_candidates(spark, sf):
    """Lakes in range of each request's start, those nearest to its end first."""
    state = world.requests(spark, sf).selectExpr("request_id", "area", "start_x x", "start_y y", "max_initial range", "end_x last_x", "end_y last_y")
    lakes = graph.node_table(vertices.explode_vertices(world.waters(spark, sf)), "water", 0)
    return spatial.recharge_candidates(state, lakes)


@query(f"WITH {NODES}, {_GRAPH} SELECT area, src, dst, round(length, 6) length FROM edges")
def build_nav_graph(spark, sf):
    _, edges = graph.build_nav_graph(world.obstacles(spark, sf), world.waters(spark, sf))
    return edges.select("area", "src", "dst", F.round("length", 6).alias("length"))


@query(f"""WITH {NODES}, {O.REQUESTS}, a AS (SELECT request_id node_id, area, 'point' kind, start_x x, start_y y, NULL::DOUBLE left_x, NULL::DOUBLE left_y, NULL::DOUBLE right_x,
  NULL::DOUBLE right_y FROM reqs) SELECT a.node_id src, b.node_id dst, round({O.distance('a.x', 'a.y', 'b.x', 'b.y')}, 6) length FROM a JOIN every b ON a.area = b.area
  AND a.node_id <> b.node_id WHERE {PAIR}""")
def attach_points(spark, sf):
    """The nodes that each request's start sees."""
    nodes = graph.graph_nodes(world.obstacles(spark, sf), world.waters(spark, sf))
    points = world.requests(spark, sf).selectExpr("area", "request_id node_id", "start_x x", "start_y y")
    return graph.attach_points(nodes, world.obstacles(spark, sf), points).select("src", "dst", F.round("length", 6).alias("length"))



