"""SQL of the derived world, for DuckDB."""

from __future__ import annotations

#: Raw outer and inner rings of the buildings as stored, without the closing vertex, and normalised ones.
RINGS = """
parts AS (
  SELECT p_partkey k, CAST(p_partkey // 100 AS INTEGER) area, p_partkey % 100 % 10 * 100 + p_partkey * 37 % 30 x0,
         p_partkey % 100 // 10 * 100 + p_partkey * 53 % 30 y0, 2 * (5 + p_size // 2) s FROM part
), rings AS (
  SELECT *, 0 AS ring_idx, CASE WHEN k % 4 = 0 THEN [[0, 0], [s, 0], [s, s // 2], [s // 2, s // 2], [s // 2, s], [0, s]]
                           ELSE [[0, 0], [s, 0], [s, s], [0, s]] END AS pts FROM parts
  UNION ALL
  SELECT *, 1, [[s // 4, s // 4], [s - s // 4, s // 4], [s - s // 4, s - s // 4], [s // 4, s - s // 4]] FROM parts WHERE k % 7 = 0 AND k % 4 <> 0
), turned AS (  -- orientation +1 as listed, -1 reversed around the first vertex
  SELECT k, area, ring_idx, x0, y0, pts, len(pts) n, CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END AS raw_turn, CASE WHEN ring_idx = 0 THEN 1 ELSE -1 END AS norm_turn FROM rings
)"""


def vertices(turn: str, where: str = "TRUE", name: str = "verts") -> str:
    """CTE of vertices with neighbours; ``turn`` is raw_turn or norm_turn, or 1."""
    at = lambda i: f"pts[CAST(1 + (({turn} * ({i})) % n + n) % n AS INTEGER)]"
    cols = ", ".join(
        f"CAST(x0 + {at(i)}[1] AS DOUBLE) {p}x, CAST(y0 + {at(i)}[2] AS DOUBLE) {p}y" for p, i in (("", "i"), ("left_", "i + 1"), ("right_", "i - 1"))
    )
    return f"""{name} AS (
  SELECT area, k polygon_id, CAST(ring_idx AS INTEGER) ring_idx, CAST(i AS INTEGER) vertex_idx, CAST(n AS INTEGER) n, {cols}
  FROM (SELECT *, unnest(range(n)) i FROM turned WHERE {where})
)"""


#: Vertices of the buildings without holes, counter-clockwise.
OBSTACLES = RINGS + ", " + vertices("1", "ring_idx = 0", "obst")
WATERS = """lakes AS (
  SELECT s_suppkey t, CAST(s_suppkey // 5 AS INTEGER) area, (s_suppkey % 5 * 3 + 1) % 10 * 100 + 92 x0, (s_suppkey % 5 * 7 + 2) % 10 * 100 + 92 y0,
         [[0, 0], [6, 0], [6, 6], [0, 6]] pts FROM supplier
), lake AS (
  SELECT area, t polygon_id, 0 ring_idx, CAST(i AS INTEGER) vertex_idx, CAST(x0 + pts[i + 1][1] AS DOUBLE) x, CAST(y0 + pts[i + 1][2] AS DOUBLE) y,
         CAST(x0 + pts[(i + 1) % 4 + 1][1] AS DOUBLE) left_x, CAST(y0 + pts[(i + 1) % 4 + 1][2] AS DOUBLE) left_y,
         CAST(x0 + pts[(i + 3) % 4 + 1][1] AS DOUBLE) right_x, CAST(y0 + pts[(i + 3) % 4 + 1][2] AS DOUBLE) right_y
  FROM (SELECT *, unnest(range(4)) i FROM lakes)
)"""
PROBES = """probes AS (
  SELECT CAST(o_orderkey % 20 AS INTEGER) area, o_orderkey point_id, o_orderkey % 1000 + CAST(0.5 AS DOUBLE) x, o_orderkey // 1000 % 1000 + CAST(0.5 AS DOUBLE) y FROM orders
)"""
REQUESTS = """reqs AS (
  SELECT c_custkey request_id, CAST(c_custkey // 75 AS INTEGER) area, CAST(c_custkey % 10 * 100 + 95 AS DOUBLE) start_x, CAST(c_custkey // 10 % 10 * 100 + 91 AS DOUBLE) start_y,
         CAST((c_custkey * 3 + 7) % 10 * 100 + 91 AS DOUBLE) end_x, CAST((c_custkey * 7 + 3) % 10 * 100 + 96 AS DOUBLE) end_y,
         CAST(200 + c_custkey % 5 * 100 AS DOUBLE) max_initial, CAST(400 + c_custkey % 3 * 100 AS DOUBLE) max_after FROM customer
)"""
PATHS = "paths AS (SELECT o_custkey path_id, o_orderkey seq, CAST(o_orderkey % 1000 AS DOUBLE) x, CAST(o_orderkey * 7 % 1000 AS DOUBLE) y FROM orders)"
ZONES = """zones AS (
  SELECT n_nationkey zone_id, n_name AS name, n_nationkey * 10 + CAST(0.7 AS DOUBLE) AS lower_limit, n_nationkey * 10 + CAST(50.2 AS DOUBLE) AS upper_limit,
         CASE WHEN n_nationkey % 2 = 0 THEN upper(r_name) ELSE lower(r_name) END category, CAST(n_nationkey % 5 * 400 AS DOUBLE) min_x, CAST(n_nationkey // 5 * 400 AS DOUBLE) min_y,
         CAST(n_nationkey % 5 * 400 + 300 AS DOUBLE) max_x, CAST(n_nationkey // 5 * 400 + 300 AS DOUBLE) max_y FROM nation JOIN region ON n_regionkey = r_regionkey
), conds AS (
  SELECT r_name category, unnest(['ask the ' || r_name, 'avoid ' || r_name]) AS condition FROM region WHERE r_regionkey <> 4
)"""
PIXELS = """pixels AS (
  SELECT o_orderkey // 10000 image_id, CAST(o_orderkey % 100 AS INTEGER) px, CAST(o_orderkey // 100 % 100 AS INTEGER) py,
         CASE WHEN o_orderkey % 4999 = 0 THEN 'ignore' WHEN o_orderpriority = '1-URGENT' THEN 'building' WHEN o_orderpriority = '2-HIGH' THEN 'water'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'vegetation' ELSE 'background' END colour FROM orders
)"""
CHIP_LABELS = """chips AS (
  SELECT lang dataset, source || '-' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(6, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') stem,
         CASE WHEN quality = 1 THEN n_chars * 13 % 40000 ELSE 0 END building, CASE WHEN toxic = 1 THEN n_chars * 7 % 40000 ELSE 0 END water
  FROM documents LEFT JOIN labels USING (doc_id)
), chip_labels AS (
  SELECT dataset, stem, 'building' AS label, building pixels FROM chips WHERE building > 0 UNION ALL SELECT dataset, stem, 'water', water FROM chips WHERE water > 0
)"""


def direction(x: str, y: str, tx: str, ty: str) -> str:
    """Pseudo-angle in [0, 4)."""
    dx, dy = f"({tx} - {x})", f"({ty} - {y})"
    value = f"abs(1 - {dx} / (abs({dx}) + abs({dy})))"
    return f"(CASE WHEN abs({dx}) + abs({dy}) = 0 THEN 'NaN'::DOUBLE WHEN {dy} >= 0 THEN {value} WHEN {value} = 0 THEN 0 ELSE 4 - {value} END)"


def between(a: str, low: str, high: str) -> str:
    return f"(CASE WHEN {low} < {high} THEN {low} <= {a} AND {a} <= {high} ELSE {low} <= {a} OR {a} <= {high} END)"


def enters(v: str, tx: str, ty: str) -> str:
    """Whether the way from vertex alias v to a target starts inside its corner."""
    d = lambda px, py: direction(f"{v}.x", f"{v}.y", px, py)
    return f"(NOT {between(d(tx, ty), d(f'{v}.right_x', f'{v}.right_y'), d(f'{v}.left_x', f'{v}.left_y'))})"


def turn(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> str:
    return f"sign(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


def crosses(a, b, c, d) -> str:
    return f"({turn(a, b, c)} * {turn(a, b, d)} < 0 AND {turn(c, d, a)} * {turn(c, d, b)} < 0)"


def distance(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"sqrt(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"


