"""Queries of the readers, writers, airspace and shape operators, with their SQL.

Each reader's query writes a table of the derived world in the reader's format to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyroute.functions import geometry as G
from skyroute.functions import projections
from skyroute.jobs import oracles as O
from skyroute.jobs import vision_queries as vision
from skyroute.jobs import world
from skyroute.operators import airspace, chips, design, overlay, shapes, vertices
from skyroute.sources import collection, readers, writers
from skyroute.sources.staging import scratch, shuffled, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _files(spark, sf):
    return world.table(spark, sf, "part").selectExpr(
        "concat('maps/', element_at(array('Gba', 'Gbg', 'Wtz', 'Wgr'), p_size % 4 + 1), '_20220704_', p_partkey div 10, '_Shapefile.zip') path"
    )


_FILES = "f AS (SELECT ['Gba', 'Gbg', 'Wtz', 'Wgr'][p_size % 4 + 1] code, CAST(p_partkey // 10 AS VARCHAR) sheet FROM part)"


@query(f"WITH {_FILES} SELECT sheet, code, CASE WHEN code = 'Wtz' THEN 'water' ELSE 'building' END AS label, 'maps/' || code || '_20220704_' || sheet || '_Shapefile.zip' path FROM f WHERE code <> 'Wgr'")
def sheet_catalogue(spark, sf):
    return readers.sheet_catalogue(_files(spark, sf))


@query(f"WITH {_FILES} SELECT sheet, code FROM (SELECT DISTINCT sheet FROM f), (SELECT unnest(['Gba', 'Gbg', 'Wtz']) code) EXCEPT SELECT sheet, code FROM f")
def sheet_catalogue__missing(spark, sf):
    files = _files(spark, sf)
    return readers.missing_codes(readers.sheet_catalogue(files), files, list(readers.CATEGORY_LABELS))


@query(f"WITH {O.ZONES} SELECT name, CAST(trunc(lower_limit) AS INTEGER) AS lower, CAST(ceil(upper_limit) AS INTEGER) AS upper, category, min_x, min_y, max_x, max_y FROM zones")
def read_geozones(spark, sf):
    z = world.zones(spark, sf)
    ring = F.array(*(F.array(x, y) for x, y in (("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"), ("min_x", "min_y"))))
    many = F.col("zone_id") % 3 == 0
    one = F.struct(F.lit("Polygon").alias("type"), F.to_json(F.array(ring)).alias("c"))
    shape = F.when(many, F.struct(F.lit("MultiPolygon").alias("type"), F.to_json(F.array(F.array(ring))).alias("c"))).otherwise(one)
    text = F.concat(
        F.lit('{"type": "FeatureCollection", "features": [{"properties": '), F.to_json(F.struct("name", F.col("lower").alias("lowerLimit"), F.col("upper").alias("upperLimit"), F.col("category").alias("categories"))),
        F.lit(', "geometry": {"type": "'), shape["type"], F.lit('", "coordinates": '), shape["c"], F.lit("}}]}"),
    )
    path = scratch(spark, "geozones")
    z.select(text.alias("value")).write.text(path)
    zones = readers.read_geozones(spark, path)
    outer = F.element_at(F.element_at("polygons", 1), 1)
    xs, ys = F.transform(outer, lambda p: p[0]), F.transform(outer, lambda p: p[1])
    return zones.select("name", "lower", "upper", "category", F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


@query(f"WITH {O.ZONES} SELECT category, condition FROM conds")
def read_conditions(spark, sf):
    path = scratch(spark, "conditions")
    feature = F.struct(F.struct(F.col("condition").alias("condition_en"), F.col("category").alias("Generieke_categorie_geozone")).alias("attributes"))
    world.conditions(spark, sf).select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value")).write.text(path)
    return readers.read_conditions(spark, path)


@query(f"WITH {O.CHIP_LABELS} SELECT c.stem, l.label, CAST(l.pixels AS BIGINT) pixels FROM chips c LEFT JOIN chip_labels l USING (stem)")
def read_chip_metadata(spark, sf):
    path = scratch(spark, "metadata")
    chip = F.struct(F.array(F.lit(300), F.lit(300)).alias("size"), F.array(F.lit(300), F.lit(300)).alias("stride"), F.create_map("stem", "labels").alias("nbroLabelPixels"))
    world.chip_labels(spark, sf).select(F.to_json(chip).alias("value")).write.text(path)
    return readers.read_chip_metadata(spark, path)


@query(f"""WITH {O.CHIP_LABELS} SELECT c.stem, l.label, CAST(l.pixels AS BIGINT) pixels, CAST(300 AS INTEGER) width, CAST(200 AS INTEGER) height, CAST(150 AS INTEGER) stride_x, CAST(100 AS INTEGER) stride_y
FROM chips c LEFT JOIN chip_labels l USING (stem)""")
def write_chip_metadata(spark, sf):
    """Label pixels of chips written with the chips' size and stride, and read back."""
    path = scratch(spark, "metadata")
    counts = world.chip_labels(spark, sf).select("stem", F.explode_outer("labels").alias("label", "pixels"))
    writers.write_chip_metadata(counts, path, (300, 200), (150, 100))
    return readers.read_chip_metadata(spark, path).join(readers.read_chip_grids(spark, path), "stem")


@query("""WITH l AS (SELECT l_suppkey sheet, l_linenumber = 1 AS whole, l_extendedprice price, l_quantity n FROM lineitem),
s AS (SELECT sheet, count(*) parts, sum(CASE WHEN whole THEN price ELSE price * n END) total FROM l GROUP BY sheet)
SELECT CAST(sheet AS BIGINT) sheet, parts, round(total, 1) total, CASE WHEN sheet % 7 = 0 THEN NULL WHEN sheet % 5 = 0 THEN round(total, 1) + 10 ELSE round(total, 1) END printed, sheet % 7 <> 0 AND sheet % 5 <> 0 agrees FROM s""")
def reconcile(spark, sf):
    """A weight sheet of each supplier, with blank lines and a printed total (wrong on some, lacking on others), written, read and summed up."""
    from pyarrow import fs

    line = world.table(spark, sf, "lineitem").selectExpr("bigint(l_suppkey) of", "l_linenumber k", "concat('part ', l_partkey) part", "double(l_extendedprice) price", "double(l_quantity) n")
    blank = "double(null)"
    lines = line.selectExpr("of", "part", f"{blank} volume", f"{blank} solid", "IF(k = 1, null, price) unit", f"{blank} area", "IF(k = 1, null, n) count", "IF(k = 1, price, price * n) total")
    empty = line.where("k = 2").selectExpr("of", "string(null) part", *(f"{blank} {c}" for c in ("volume", "solid", "unit", "area", "count", "total")))
    sums = lines.where("of % 7 <> 0").groupBy("of").agg(F.round(F.sum("total"), 1).alias("total"))
    totals = sums.selectExpr("of", "'Total' part", *(f"{blank} {c}" for c in ("volume", "solid", "unit", "area", "count")), "IF(of % 5 = 0, total + 10, total) total")
    folder = scratch(spark, "sheets")

    def write(batches):
        for batch in batches:
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            for of, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_output_stream(f"{root}/sheet-{of}.tsv") as f:
                    f.write(text.encode())
            yield batch.select(["of"])

    rows = lines.union(empty).union(totals)
    named = [c for c in rows.columns if c != "of"]
    text = F.concat_ws("\n", F.lit("\t".join(named)), F.collect_list(F.to_csv(F.struct(*named), {"sep": "\t"})))
    # files of one folder, each by the task that has the sheet: a folder for each would be moved and listed one by one in the end
    sheets = spread(rows, "of").groupBy("of").agg(text.alias("text"))
    sheets.mapInArrow(write, "of long").write.parquet(scratch(spark, "sheets-written"))
    read = design.reconcile(*readers.read_parts_sheet(spark, folder, readers.WEIGHT_SHEET, "\t"), tolerance=0.06)
    sheet = F.regexp_extract("sheet", r"/sheet-(\d+)\.tsv$", 1).cast("long")
    return read.select(sheet.alias("sheet"), "parts", F.round("total", 1).alias("total"), "printed", "agrees")


@query("SELECT 'chip-' || o_orderkey chip, CAST(o_orderkey % 1000 * 25 AS DOUBLE) x, CAST(o_orderkey // 1000 * 25 AS DOUBLE) y FROM orders")
def read_chip_offsets(spark, sf):
    return _offsets(spark, sf)


def _offsets(spark, sf):
    path = scratch(spark, "offsets")
    world.table(spark, sf, "orders").selectExpr("concat('chip-', o_orderkey) chip", "double(o_orderkey % 1000 * 25) x", "double(o_orderkey div 1000 * 25) y").write.csv(path, header=True)
    return readers.read_chip_offsets(spark, path)


@query("SELECT coalesce(d.doc_id, l.doc_id) doc_id, d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL paired FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def pair_examples(spark, sf):
    images = world.table(spark, sf, "documents").selectExpr("doc_id stem", "encode(source, 'UTF-8') content")
    masks = world.table(spark, sf, "labels").selectExpr("doc_id stem", "encode(string(quality), 'UTF-8') content")
    pairs, mismatches = readers.pair_examples(images, masks)
    return pairs.select(F.col("stem").alias("doc_id"), F.lit(True).alias("paired")).union(mismatches.select("stem", F.lit(False)))


@query("""WITH p AS (SELECT d.doc_id, md5(coalesce(d.text, '')) image, CAST(l.quality AS VARCHAR) label_mask, row_number() OVER (ORDER BY d.doc_id) i, count(*) OVER () n
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
  SELECT doc_id, image, label_mask, CASE WHEN i <= trunc(n * 0.75) THEN 'train' WHEN i <= trunc(n * (0.75::DOUBLE + 0.24::DOUBLE)) THEN 'validation' ELSE 'test' END split FROM p""")
def write_examples(spark, sf):
    """Pairs written by split and read back; images are texts of documents, masks their labels."""
    path = scratch(spark, "examples")
    images = world.table(spark, sf, "documents").selectExpr("doc_id stem", "encode(coalesce(text, ''), 'UTF-8') content")
    masks = world.table(spark, sf, "labels").selectExpr("doc_id stem", "encode(string(quality), 'UTF-8') content")
    pairs, _ = readers.pair_examples(images, masks)
    writers.write_examples(chips.split(pairs), path)
    back = spark.read.schema("stem long, image binary, label_mask binary, split string").parquet(path)
    return back.select(F.col("stem").alias("doc_id"), F.md5("image").alias("image"), F.decode("label_mask", "UTF-8").alias("label_mask"), "split")


@query("""SELECT d.source || '-' || d.doc_id AS stem, CASE WHEN quality IS NOT NULL THEN md5(coalesce(d.text, '')) END image, md5(CAST(quality AS VARCHAR)) label_mask, quality IS NOT NULL AS paired
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.source IS NOT NULL""")
def read_pairs(spark, sf):
    """Texts of documents as images and their labels as masks, each a file that a task writes, paired by name; documents without label are mismatches.

    A folder holds about 4,096 files, whatever their number.  Rows of one id are written by one task, which numbers them, so that each has a file, and a task that is run again writes the same ones.
    """
    import uuid

    import pyarrow as pa
    from pyarrow import fs

    folder = scratch(spark, "pairs")
    store, root = fs.FileSystem.from_uri(folder)
    for side in ("images", "masks"):  # a side may have no file
        store.create_dir(f"{root}/{side}", recursive=True)

    def write(batches):
        store, made, times = fs.FileSystem.from_uri(folder)[0], set(), {}
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['side']}/{row['stem']}"
                times[name] = times.get(name, -1) + 1
                place = f"{root}/{row['side']}/{row['part']}-{times[name]}"
                if place not in made:
                    store.create_dir(place, recursive=True)
                    made.add(place)
                # hidden until it is whole
                with store.open_output_stream(temporary := f"{place}/.{uuid.uuid4().hex}", compression=None) as f:
                    f.write(row["content"])
                store.move(temporary, f"{place}/{row['stem']}.{'jpg' if row['side'] == 'images' else 'png'}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["stem"])

    d, labels = world.table(spark, sf, "documents").where("source is not null"), world.table(spark, sf, "labels").where("quality is not null")
    parts = -(-d.count() // 4096) or 1
    # a name without anything that a path, a pattern or a hidden file would be known by
    name = F.replace(F.replace(F.url_encode(F.concat("source", F.lit("-"), F.col("doc_id"))), F.lit("."), F.lit("%2E")), F.lit("_"), F.lit("%5F"))
    file = lambda side, content: [name.alias("stem"), F.lit(side).alias("side"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"), F.expr(content).alias("content")]
    images = spread(d, "doc_id").select(*file("images", "encode(coalesce(text, ''), 'UTF-8')"))
    masks = spread(labels.select("doc_id", "quality").join(shuffled(d.select("doc_id", "source").distinct()), "doc_id"), "doc_id").select(*file("masks", "encode(string(quality), 'UTF-8')"))
    images.union(masks).mapInArrow(write, "stem string").write.parquet(scratch(spark, "stems"))
    pairs, mismatches = readers.read_pairs(spark, f"{folder}/images/*", f"{folder}/masks/*", empty=True)
    left = mismatches.select("stem", F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("label_mask"), F.lit(False).alias("paired"))
    both = pairs.select("stem", F.md5("image").alias("image"), F.md5("label_mask").alias("label_mask"), F.lit(True).alias("paired")).union(left)
    return both.withColumn("stem", F.url_decode("stem"))


@query("""WITH h AS (SELECT CAST(user_id AS VARCHAR) run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) epoch, value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)
SELECT run, epoch, 'val_loss' metric, value FROM h""")
def read_run_history(spark, sf):
    """The runs, each in a file of its name that the task with the run writes, read back."""
    from pyarrow import fs

    folder = scratch(spark, "history")

    def write(batches):
        for batch in batches:
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            for run, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_output_stream(f"{root}/{run}_metrics.json") as f:
                    f.write(text.encode())
            yield batch.select(["run"])

    rows = world.history(spark, sf).select(F.col("run").cast("string").alias("run"), F.to_json(F.struct("val_loss")).alias("text"))
    rows.mapInArrow(write, "run string").write.parquet(scratch(spark, "runs"))
    return readers.read_run_history(spark, f"{folder}/*_metrics.json")


@query(f"""WITH {O.RINGS} SELECT k polygon_id, 'building' AS "type", CAST(count(*) AS INTEGER) rings, CAST(sum(len(pts) + 1) AS INTEGER) points FROM rings GROUP BY k""")
def write_class_geojson(spark, sf):
    """Features written and read back."""
    path = scratch(spark, "classes")
    p = world.obstacles(spark, sf, raw=True).withColumn("class", F.concat(F.lit("building-"), F.col("polygon_id").cast("string")))
    writers.write_features(writers.class_features(p, "class"), path)
    back = spark.read.schema("type string, properties struct<type:string>, geometry struct<type:string,coordinates:array<array<array<double>>>>").json(path)
    name = F.split("properties.type", "-")
    rings = F.col("geometry.coordinates")
    return back.select(
        name[1].cast("long").alias("polygon_id"), name[0].alias("type"), F.size(rings).alias("rings"), F.aggregate(rings, F.lit(0), lambda a, r: a + F.size(r)).alias("points")
    )


@query(f"WITH {O.PATHS} SELECT path_id request_id, CAST(count(*) AS INTEGER) points, CAST(max(seq) AS DOUBLE) distance FROM paths GROUP BY path_id")
def write_path_geojson(spark, sf):
    path = scratch(spark, "paths")
    p = world.paths(spark, sf).selectExpr("path_id request_id", "seq place", "x", "y", "double(seq) cumulated")
    writers.write_features(writers.path_features(p), path)
    back = spark.read.schema("properties struct<request_id:long,distance:double>, geometry struct<coordinates:array<array<double>>>").json(path)
    return back.select("properties.request_id", F.size("geometry.coordinates").alias("points"), "properties.distance")


#: Where the towns lie in EPSG 3035, so that their rings are metres of it.
_EAST, _NORTH = 3_900_000.0, 3_100_000.0


def _moved(point):
    return F.struct((point["x"] + _EAST).alias("x"), (point["y"] + _NORTH).alias("y"))


def _metres(lng, lat):
    x, y = projections.to_internal(lng, lat)
    return F.round(x - _EAST, 3).alias("x"), F.round(y - _NORTH, 3).alias("y")


@query(f"""WITH {O.RINGS} SELECT k polygon_id, 'building' AS "type", CAST(ring_idx AS INTEGER) ring_idx, CAST(i AS INTEGER) i, CAST(x0 + pts[p][1] AS DOUBLE) x, CAST(y0 + pts[p][2] AS DOUBLE) y
FROM (SELECT *, CASE WHEN raw_turn > 0 THEN i % n ELSE (n - i) % n END + 1 p FROM (SELECT *, unnest(range(n + 1)) i FROM turned))""")
def write_class_collection(spark, sf):
    """The buildings in degrees as one FeatureCollection in one file, read back: every corner in metres."""
    rings = F.transform("rings", lambda r: F.transform(r, _moved))
    p = world.obstacles(spark, sf, raw=True).select("polygon_id", rings.alias("rings"), F.concat(F.lit("building-"), F.col("polygon_id").cast("string")).alias("class"))
    path = scratch(spark, "map") + ".geojson"
    collection.write_collection(writers.class_features(writers.rings_in_degrees(p), "class"), path)
    back = readers.read_collection(spark, path, "properties struct<type:string>, geometry struct<type:string,coordinates:array<array<array<double>>>>")
    name = F.split("f.properties.type", "-")
    corners = back.select(name[1].cast("long").alias("polygon_id"), name[0].alias("type"), F.posexplode("f.geometry.coordinates").alias("ring_idx", "ring"))
    corners = corners.select("polygon_id", "type", "ring_idx", F.posexplode("ring").alias("i", "c"))
    return corners.select("polygon_id", "type", "ring_idx", "i", *_metres(F.col("c")[0], F.col("c")[1]))


@query(f"""WITH {O.PATHS}, l AS (SELECT path_id, max_by(x, seq) tx, max_by(y, seq) ty, count(*) n FROM paths GROUP BY path_id)
SELECT path_id request_id, 'Point' AS "type", 0 AS i, tx x, ty y FROM l
UNION ALL SELECT path_id, 'LineString', CAST(row_number() OVER (PARTITION BY path_id ORDER BY seq) - 1 AS INTEGER), x, y FROM paths JOIN l USING (path_id) WHERE n > 1""")
def write_leg_geojson(spark, sf):
    """Paths as legs in degrees, written and read back: where each ends, and the points of its line in metres."""
    points = world.paths(spark, sf).groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    line = F.transform("p", _moved)
    target = F.element_at(line, -1)
    legs = points.select(
        F.col("path_id").alias("request_id"), F.lit(0).alias("leg_no"), F.lit("end").alias("status"), target["x"].alias("target_x"), target["y"].alias("target_y"), line.alias("line"), F.lit(0.0).alias("length")
    )
    path = scratch(spark, "legs")
    writers.write_features(writers.leg_features(writers.legs_in_degrees(legs)), path)
    back = spark.read.schema("properties struct<request_id:long,status:string>, geometry struct<type:string,coordinates:string>").json(path).where("properties.status = 'end'")
    text = F.col("geometry.coordinates")
    at = F.when(F.col("geometry.type") == "Point", F.array(F.from_json(text, "array<double>"))).otherwise(F.from_json(text, "array<array<double>>"))
    rows = back.select("properties.request_id", "geometry.type", F.posexplode(at).alias("i", "c"))
    return rows.select("request_id", "type", "i", *_metres(F.col("c")[0], F.col("c")[1]))


@query(f"WITH {O.RINGS}, {O.vertices('norm_turn')} SELECT area, polygon_id, ring_idx, x, y, left_x, left_y FROM verts")
def read_polygon_layer(spark, sf):
    """The buildings as well-known binary, and back."""
    import pyarrow as pa

    def encode(batches):
        for b in batches:
            wkb = [readers.encode_wkb([[(p["x"], p["y"]) for p in r] for r in rings]) for rings in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(wkb, pa.binary())], names=["area", "polygon_id", "geom"])

    rows = world.obstacles(spark, sf, raw=True).select("area", "polygon_id", "rings").mapInArrow(encode, "area int, polygon_id long, geom binary")
    polygons, _ = readers.read_polygon_layer(rows)
    return vertices.explode_vertices(polygons).select("area", "polygon_id", "ring_idx", "x", "y", "left_x", "left_y")


@query(f"""WITH {O.ZONES} SELECT zone_id, coalesce(array_to_string(list_sort((SELECT list(condition) FROM conds c WHERE lower(c.category) = lower(z.category))), ' / '), '') conditions FROM zones z""")
def geozones_with_conditions(spark, sf):
    both, _ = airspace.geozones_with_conditions(world.zones(spark, sf), world.conditions(spark, sf))
    return both.select("zone_id", F.array_join("conditions", " / ").alias("conditions"))


@query(f"WITH {O.ZONES} SELECT zone_id FROM zones WHERE lower(category) NOT IN (SELECT lower(category) FROM conds)")
def geozones_with_conditions__warnings(spark, sf):
    return airspace.geozones_with_conditions(world.zones(spark, sf), world.conditions(spark, sf))[1].select("zone_id")


_S, _E = ("s.x", "s.y"), ("s.nx", "s.ny")
_DIAGONALS = " OR ".join(O.crosses(_S, _E, (f"z.min_x", f"z.{a}"), ("z.max_x", f"z.{b}")) for a, b in (("min_y", "max_y"), ("max_y", "min_y")))


@query(f"""WITH {O.PATHS}, {O.ZONES}, s AS (SELECT * FROM (SELECT *, lead(x) OVER w nx, lead(y) OVER w ny FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY seq)) WHERE nx IS NOT NULL)
SELECT DISTINCT s.path_id, z.zone_id FROM s JOIN zones z ON z.lower_limit <= 120 AND z.upper_limit >= 120 AND (
  (s.x BETWEEN z.min_x AND z.max_x AND s.y BETWEEN z.min_y AND z.max_y) OR (s.nx BETWEEN z.min_x AND z.max_x AND s.ny BETWEEN z.min_y AND z.max_y) OR {_DIAGONALS})""")
def path_zone_conflicts(spark, sf):
    """Paths at an altitude of 120 that enter a zone."""
    return airspace.path_zone_conflicts(world.paths(spark, sf), world.zones(spark, sf), 120.0)


_EDGES = ", ".join(
    f"[{part}, {g}, {a[0]}, {a[1]}, {b[0]}, {b[1]}]"
    for part, g, corners in ((0, 1, world.ZONE_OUTER), (0, 1, world.ZONE_HOLE), (1, 3, world.ZONE_PART))
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True)
)


@query(f"""WITH {O.PATHS}, {O.ZONES}, e AS (SELECT zone_id, e[1] part, min_x + e[3] x1, min_y + e[4] y1, min_x + e[5] x2, min_y + e[6] y2
  FROM (SELECT zone_id, min_x, min_y, unnest([{_EDGES}]) e FROM zones WHERE trunc(lower_limit) <= 120 AND ceil(upper_limit) >= 120) WHERE zone_id % e[2] = 0),
s AS (SELECT *, {O.distance('x', 'y', 'nx', 'ny')} len FROM (SELECT *, lead(x) OVER w nx, lead(y) OVER w ny FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY seq)) WHERE nx IS NOT NULL),
st AS (SELECT *, sum(len) OVER (PARTITION BY path_id ORDER BY seq) - len AS before FROM s),
m AS (SELECT path_id, seq, ((x1 - x) * (y2 - y1) - (y1 - y) * (x2 - x1)) / d t, ((x1 - x) * (ny - y) - (y1 - y) * (nx - x)) / d u
  FROM (SELECT *, (nx - x) * (y2 - y1) - (ny - y) * (x2 - x1) d FROM st, e) WHERE d <> 0),
c AS (SELECT DISTINCT path_id, seq, t FROM m WHERE t > 0 AND t < 1 AND u BETWEEN -1e-9 AND 1 + 1e-9 UNION SELECT path_id, seq, 0 FROM st),
w AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY path_id, seq ORDER BY t), 1) til FROM c JOIN st USING (path_id, seq)),
p AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY seq, t) n, x + (t + til) / 2 * (nx - x) mx, y + (t + til) / 2 * (ny - y) my FROM w WHERE (til - t) * len > 1e-9),
h AS (SELECT path_id, n, zone_id, part, count(*) FILTER (my >= least(y1, y2) AND my < greatest(y1, y2) AND x1 + (my - y1) * (x2 - x1) / nullif(y2 - y1, 0) > mx) k,
    count(*) FILTER (my BETWEEN least(y1, y2) AND greatest(y1, y2) AND x1 + (my - y1) * (x2 - x1) / nullif(y2 - y1, 0) = mx) on_edge FROM p, e GROUP BY ALL),
i AS (SELECT *, n - row_number() OVER (PARTITION BY path_id, zone_id ORDER BY n) run FROM (SELECT DISTINCT path_id, n, zone_id FROM h WHERE k % 2 = 1 AND on_edge = 0))
SELECT i.path_id, zone_id, round(min(p.before + p.t * p.len), 6) enters, round(max(p.before + p.til * p.len), 6) leaves,
  coalesce(array_to_string(list_sort((SELECT list(condition) FROM conds k, zones z WHERE lower(k.category) = lower(z.category) AND z.zone_id = i.zone_id)), ' / '), '') conditions
FROM i JOIN p USING (path_id, n) GROUP BY i.path_id, zone_id, run""")
def zone_passages(spark, sf):
    """Where paths at an altitude of 120 enter and leave zones that are no boxes, written as GeoJSON and read back, with the zones' conditions."""
    z = world.shaped_zones(spark, sf)
    many = F.size("polygons") > 1
    feature = F.struct(
        F.struct(F.format_string("%d %s", "zone_id", "name").alias("name"), F.col("lower").alias("lowerLimit"), F.col("upper").alias("upperLimit"), F.col("category").alias("categories")).alias("properties"),
        F.when(many, F.struct(F.lit("MultiPolygon").alias("type"), F.to_json("polygons").alias("coordinates"))).otherwise(F.struct(F.lit("Polygon").alias("type"), F.to_json(F.col("polygons")[0]).alias("coordinates"))).alias("geometry"),
    )
    path = scratch(spark, "geozones")
    z.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value")).write.text(path)
    zones = readers.read_geozones(spark, path).withColumn("zone_id", F.split("name", " ")[0].cast(z.schema["zone_id"].dataType))
    passages = airspace.zone_passages(world.paths(spark, sf), zones, world.conditions(spark, sf), 120.0)
    return passages.select("path_id", "zone_id", F.round("enters", 6).alias("enters"), F.round("leaves", 6).alias("leaves"), F.array_join("conditions", " / ").alias("conditions"))


_AREA = f"""{O.RINGS}, sizes AS (SELECT area, k polygon_id, CASE WHEN k % 4 = 0 THEN s * s * 3 / 4 ELSE s * s END
  - CASE WHEN k % 7 = 0 AND k % 4 <> 0 THEN (s - 2 * (s // 4)) * (s - 2 * (s // 4)) ELSE 0 END px FROM parts)"""


@query(f"WITH {_AREA} SELECT area, polygon_id, round(CAST(px AS DOUBLE), 6) total FROM sizes")
def clip_to_tiles(spark, sf):
    """The parts of each building in tiles of 37 units, summed up again."""
    parts = shapes.clip_to_tiles(vertices.normalize_winding(world.obstacles(spark, sf, raw=True)), 37.0)
    return parts.groupBy("area", "polygon_id").agg(F.round(F.sum("clipped_area"), 6).alias("total"))


@query(f"WITH {_AREA} SELECT area, polygon_id, CAST(px AS BIGINT) pixels FROM sizes WHERE px > 0")
def rasterize(spark, sf):
    """Pixels of each building."""
    return shapes.rasterize(world.obstacles(spark, sf, raw=True)).groupBy("area", "polygon_id").agg(F.count("*").alias("pixels"))


#: Pixels of a tile's side, the labels in the order in which they are painted, and the ground.
_SIDE, _LAYERS, _GROUND = 70, {"building": (75, 25, 230), "water": (48, 130, 245)}, (255, 255, 255)


@query(f"""WITH {O.RINGS}, tri AS (SELECT k, area, x0 + 15 x0, y0 + 10 y0, [[0, 0], [s, s // 3], [s // 4, s]] pts FROM parts),
c AS (SELECT 1 r, k, area, x0, y0, pts, unnest(range(len(pts))) i FROM rings UNION ALL SELECT 2, k, area, x0, y0, pts, unnest(range(3)) FROM tri),
e AS (SELECT r, k, area, x0 + pts[i + 1][1] x1, y0 + pts[i + 1][2] y1, x0 + pts[(i + 1) % len(pts) + 1][1] x2, y0 + pts[(i + 1) % len(pts) + 1][2] y2 FROM c),
box AS (SELECT r, k, area, min(x1) x_min, max(x1) x_max, min(y1) y_min, max(y1) y_max FROM e GROUP BY ALL),
px AS (SELECT *, unnest(range(y_min, y_max + 1)) py FROM (SELECT *, unnest(range(x_min, x_max + 1)) px FROM box)),
inside AS (SELECT r, k, area, px, py FROM px JOIN e USING (r, k, area) WHERE y1 <> y2 AND py >= least(y1, y2) AND py < greatest(y1, y2)
  AND x1 + (py - y1) * (x2 - x1) / (y2 - y1)::DOUBLE > px GROUP BY ALL HAVING count(*) % 2 = 1),
border AS (SELECT r, k, area, floor(x1 + (py - y1) * (x2 - x1) / (y2 - y1)::DOUBLE + 0.5)::BIGINT px, py FROM (SELECT *, unnest(range(least(y1, y2), greatest(y1, y2) + 1)) py FROM e WHERE abs(x2 - x1) <= abs(y2 - y1))
  UNION ALL SELECT r, k, area, px, floor(y1 + (px - x1) * (y2 - y1) / (x2 - x1)::DOUBLE + 0.5)::BIGINT FROM (SELECT *, unnest(range(least(x1, x2), greatest(x1, x2) + 1)) px FROM e WHERE abs(x2 - x1) > abs(y2 - y1))),
top AS (SELECT area, px, py, max(r) r FROM (SELECT area, px, py, r FROM inside UNION ALL SELECT area, px, py, r FROM border) GROUP BY ALL),
t AS (SELECT area, px // {_SIDE} tx, py // {_SIDE} ty, r, count(*) n, sum(px % {_SIDE} + py % {_SIDE} * {_SIDE}) places FROM top GROUP BY ALL),
g AS (SELECT area, tx, ty FROM (SELECT DISTINCT area FROM parts), (SELECT unnest(range(15)) tx), (SELECT unnest(range(15)) ty)),
a AS (SELECT g.*, coalesce(sum(n), 0) n, coalesce(sum(places), 0) places FROM g LEFT JOIN t USING (area, tx, ty) GROUP BY ALL)
SELECT area, CAST(tx AS BIGINT) tx, CAST(ty AS BIGINT) ty, CASE r WHEN 1 THEN 'building' ELSE 'water' END AS label, CAST(n AS BIGINT) pixels, CAST(places AS BIGINT) places FROM t
UNION ALL SELECT area, CAST(tx AS BIGINT), CAST(ty AS BIGINT), 'ground', CAST({_SIDE * _SIDE} - n AS BIGINT), CAST({_SIDE * _SIDE * (_SIDE * _SIDE - 1) // 2} - places AS BIGINT) FROM a WHERE n < {_SIDE * _SIDE}""")
def paint_tiles(spark, sf):
    """Masks of each town in tiles, buildings with borders and triangles over them: pixels of each label, and the sum of their places in the tile."""
    import numpy as np
    import pyarrow as pa

    buildings = world.obstacles(spark, sf, raw=True).withColumn("label", F.lit("building"))
    over = world.triangles(spark, sf).selectExpr("area", "polygon_id + 1000000000000 polygon_id", "rings", "'water' label")
    tiles = buildings.select("area").distinct().selectExpr("area", "explode(sequence(0, 14)) tx").selectExpr("area", "tx", "explode(sequence(0, 14)) ty")
    images = shapes.paint_tiles(tiles, buildings.select("area", "polygon_id", "rings", "label").unionByName(over), _LAYERS, _GROUND, _SIDE)
    names = {**_LAYERS, "ground": _GROUND}
    code = lambda colour: colour[0] | colour[1] << 8 | colour[2] << 16
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    place = np.arange(_SIDE * _SIDE, dtype=np.float64)  # sums of places are whole numbers far below 2 ** 53

    def counted(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                pixels = np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column("data")]).reshape(batch.num_rows, -1, 3).astype(np.int32)
                pixels = code(np.moveaxis(pixels, 2, 0))
                for name, colour in names.items():
                    same = pixels == code(colour)
                    n = same.sum(axis=1)
                    some = np.flatnonzero(n)
                    columns = [batch.column(c).take(pa.array(some)) for c in ("area", "tx", "ty")] + [[name] * len(some), n[some], (same[some] @ place).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["area", "tx", "ty", "label", "pixels", "places"])

    return images.mapInArrow(counted, "area int, tx long, ty long, label string, pixels long, places long")


@query(f"""WITH {O.PIXELS} SELECT image_id, CAST(CASE colour WHEN 'building' THEN 1 ELSE 2 END AS INTEGER) category, CAST(count(*) AS DOUBLE) pixels FROM pixels WHERE colour IN ('building', 'water') GROUP BY ALL""")
def mask_to_polygons(spark, sf):
    """Outlines of each category; their signed areas sum up to its pixels."""
    p = chips.recode_colors(world.pixels(spark, sf), vision.CLASSES).select("image_id", "px", "py", "category")
    rings = shapes.mask_outlines(p)
    return rings.groupBy("image_id", "category").agg(F.sum(G.signed_area("ring")).alias("pixels"))


@query(f"""WITH {O.PIXELS} SELECT image_id, CASE colour WHEN 'building' THEN 'building' ELSE 'water' END kind, CAST(count(*) AS DOUBLE) pixels FROM pixels WHERE colour IN ('building', 'water') GROUP BY ALL""")
def write_mask_map(spark, sf):
    """Masks as polygons with holes on a map file, read back: what the polygons cover without their holes are the masks' pixels."""
    p = chips.recode_colors(world.pixels(spark, sf), vision.CLASSES).select("image_id", "px", "py", "category")
    polygons = overlay.polygons_from_rings(shapes.mask_outlines(p), ["image_id", "category"])
    path = scratch(spark, "mask-map")
    kind = F.concat_ws("-", F.when(F.col("category") == 1, "building").otherwise("water"), "image_id")
    writers.write_features(writers.class_features(polygons.withColumn("kind", kind), "kind"), path)
    back = spark.read.schema("properties struct<type:string>, geometry struct<coordinates:array<array<array<double>>>>").json(path)
    rings = F.transform("geometry.coordinates", lambda r: F.transform(r, lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))))
    size = F.aggregate(rings, F.lit(0.0), lambda total, r: total + G.signed_area(r))
    name = F.split("properties.type", "-")
    return back.select(name[1].cast("long").alias("image_id"), name[0].alias("kind"), size.alias("size")).groupBy("image_id", "kind").agg(F.sum("size").alias("pixels"))


@query(f"""WITH {O.RINGS}, outers AS (SELECT * FROM rings WHERE ring_idx = 0), h AS (SELECT k, s - 2 * (s // 4) side FROM rings WHERE ring_idx = 1)
SELECT area, CAST(x0 AS DOUBLE) x, CAST(y0 AS DOUBLE) y, CAST(CASE WHEN h.k IS NULL THEN 0 ELSE 1 END AS INTEGER) holes, CAST(coalesce(side * side, 0) AS DOUBLE) hole_size FROM outers LEFT JOIN h ON h.k = outers.k""")
def polygons_from_rings(spark, sf):
    """The buildings' rings, each by itself, as polygons again: where each begins, its holes and their size."""
    rings = vertices.normalize_winding(world.obstacles(spark, sf, raw=True)).select("area", F.explode("rings").alias("ring"))
    p = overlay.polygons_from_rings(rings, ["area"])
    corner = lambda c: F.array_min(F.transform(F.col("rings")[0], lambda v: v[c]))
    holes = F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(1)))
    return p.select("area", corner("x").alias("x"), corner("y").alias("y"), (F.size("rings") - 1).alias("holes"), F.aggregate(holes, F.lit(0.0), lambda t, r: t - G.signed_area(r)).alias("hole_size"))


@query(f"""WITH {O.PIXELS}, c AS (SELECT image_id, CASE colour WHEN 'building' THEN 1 ELSE 2 END category, px, py FROM pixels WHERE colour IN ('building', 'water'))
SELECT CAST(category AS INTEGER) category, min(px + image_id * 1000)::DOUBLE min_x, max(px + 1 + image_id * 1000)::DOUBLE max_x, min(py + image_id)::DOUBLE min_y, max(py + 1 + image_id)::DOUBLE max_y FROM c GROUP BY category""")
def chips_to_map(spark, sf):
    """Outlines moved to their image's place, and the extent of each category."""
    p = chips.recode_colors(world.pixels(spark, sf), vision.CLASSES).select("image_id", "px", "py", "category")
    rings = shapes.mask_outlines(p).withColumnRenamed("image_id", "chip")
    offsets = p.select(F.col("image_id").alias("chip")).distinct().selectExpr("chip", "double(chip * 1000) x", "double(chip) y")
    at = shapes.place_on_map(rings, offsets).select("category", F.explode("ring").alias("p"))
    return at.groupBy("category").agg(F.min("p.x").alias("min_x"), F.max("p.x").alias("max_x"), F.min("p.y").alias("min_y"), F.max("p.y").alias("max_y"))


def _to_internal_sql() -> str:
    _, e, qp, beta0, rq, d = projections._laea_constants()
    lat0, lng0, east, north = projections.LAEA
    return f"""WITH t AS (SELECT o_orderkey, 2.5::DOUBLE + o_orderkey % 400 / 100.0::DOUBLE lng, 49.5::DOUBLE + o_orderkey // 7 % 200 / 100.0::DOUBLE lat FROM orders),
s AS (SELECT *, sin(radians(lat)) s, radians(lng - {lng0}) dl FROM t),
b AS (SELECT *, asin({1 - e * e!r}::DOUBLE * (s / (1 - {e * e!r}::DOUBLE * s * s) - {1 / (2 * e)!r}::DOUBLE * ln((1 - {e!r}::DOUBLE * s) / (1 + {e!r}::DOUBLE * s))) / {qp!r}::DOUBLE) beta FROM s),
k AS (SELECT *, {rq!r}::DOUBLE * sqrt(2 / (1 + sin({beta0!r}::DOUBLE) * sin(beta) + cos({beta0!r}::DOUBLE) * cos(beta) * cos(dl))) bb FROM b)
SELECT o_orderkey, round({east} + bb * {d!r}::DOUBLE * cos(beta) * sin(dl), 3) x,
  round({north} + bb / {d!r}::DOUBLE * (cos({beta0!r}::DOUBLE) * sin(beta) - sin({beta0!r}::DOUBLE) * cos(beta) * cos(dl)), 3) y, round(lng, 7) lng, round(lat, 7) lat FROM k"""


@query(_to_internal_sql())
def to_internal(spark, sf):
    """Degrees to metres, and back again."""
    t = world.table(spark, sf, "orders").selectExpr("o_orderkey", "2.5D + o_orderkey % 400 / 100D lng", "49.5D + o_orderkey div 7 % 200 / 100D lat")
    x, y = projections.to_internal(F.col("lng"), F.col("lat"))
    lng, lat = projections.to_external(F.col("x"), F.col("y"))
    there = t.select("o_orderkey", x.alias("x"), y.alias("y"))
    return there.select("o_orderkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lng, 7).alias("lng"), F.round(lat, 7).alias("lat"))


@query()
def grb_to_internal(spark, sf):
    t = world.table(spark, sf, "orders").selectExpr("o_orderkey", "150000D + o_orderkey % 1000 * 50 gx", "170000D + o_orderkey div 1000 * 50 gy")
    return projections.grb_to_internal(t, "gx", "gy").select("o_orderkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"""WITH {O.RINGS}, h AS (SELECT *, CASE WHEN k % 7 = 0 AND k % 4 <> 0 THEN s - 2 * (s // 4) ELSE 0 END hole FROM parts)
SELECT area, k polygon_id, round(CASE WHEN k % 4 = 0 THEN 0.75 * s * s + 20 * s + 125 * sqrt(0.5) - 25 ELSE s * s + 20 * s + 100 * sqrt(0.5) END
  - CASE WHEN hole > 10 THEN (hole - 10) * (hole - 10) ELSE 0 END, 3) size FROM h""")
def buffer_polygons(spark, sf):
    """Buildings grown by five units: the size of each, without what is left of its courtyard."""
    grown = overlay.buffer_polygons(vertices.normalize_winding(world.obstacles(spark, sf, raw=True)), 5.0)
    size = F.aggregate("rings", F.lit(0.0), lambda a, r: a + G.signed_area(r))
    return grown.select("area", "polygon_id", F.round(size, 3).alias("size"))



@query(f"WITH {O.RINGS} SELECT CAST(k // 50 AS INTEGER) sheet, count(*) rings, CAST(sum(len(pts) + 1) AS BIGINT) points, CAST(sum(DISTINCT k) AS BIGINT) ids FROM rings GROUP BY ALL")
def read_shapefile_zips(spark, sf):
    """The buildings as zipped shapefiles of fifty, written by the tasks that hold them, and read back."""
    import io
    import zipfile

    import pyarrow as pa
    from pyarrow import fs

    folder = scratch(spark, "shapefiles")

    def write(table: pa.Table) -> pa.Table:
        sheet = table.column("sheet")[0].as_py()
        shapes_ = readers.encode_shapes([[[(p["x"], p["y"]) for p in r] for r in rings] for rings in table.column("rings").to_pylist()])
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr(f"Shapefile/Gba{sheet}.shp", shapes_)
            archive.writestr(f"Shapefile/Gba{sheet}.shx", readers.encode_index(shapes_))
            archive.writestr(f"Shapefile/Gba{sheet}.dbf", readers.encode_attributes([{"ID": str(k)} for k in table.column("polygon_id").to_pylist()]))
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/Gba_20220704_{sheet}_Shapefile.zip") as f:
            f.write(out.getvalue())
        return pa.table({"sheet": pa.array([sheet], pa.int32())})

    # a sheet is fifty buildings, whatever the size of the table
    rows = world.obstacles(spark, sf, raw=True).selectExpr("int(polygon_id div 50) sheet", "polygon_id", "rings")
    rows.groupBy("sheet").applyInArrow(write, "sheet int").write.parquet(scratch(spark, "sheets"))
    read = readers.read_shapefile_zips(spark, f"{folder}/*_Shapefile.zip", range_bytes=4096)
    points = F.aggregate("rings", F.lit(0).cast("long"), lambda a, r: a + F.size(r))
    sheet = F.regexp_extract("member", r"Gba(\d+)\.shp", 1).cast("int")
    return read.groupBy(sheet.alias("sheet")).agg(F.sum(F.size("rings")).alias("rings"), F.sum(points).alias("points"), F.sum(F.col("attributes")["ID"].cast("long")).alias("ids"))


@query(f"WITH {O.OBSTACLES} SELECT polygon_id * 10000 + vertex_idx src, x, y, left_x, left_y FROM obst")
def write_graph_geojson(spark, sf):
    """The buildings' outlines as a graph of nodes and edges, written and read back: each edge with its ends."""
    v = vertices.explode_vertices(world.obstacles(spark, sf)).withColumn("node_id", F.col("polygon_id") * 10_000 + F.col("vertex_idx"))
    edges = v.select(F.col("node_id").alias("src"), (F.col("polygon_id") * 10_000 + F.pmod(F.col("vertex_idx") + 1, F.col("n"))).alias("dst"), G.distance("x", "y", "left_x", "left_y").alias("length"))
    path = scratch(spark, "graph")
    writers.write_features(writers.graph_features(v, edges), path)
    back = spark.read.schema("properties struct<src:long,dst:long>, geometry struct<type:string,coordinates:string>").json(path).where("geometry.type = 'LineString'")
    line = F.from_json("geometry.coordinates", "array<array<double>>")
    rows = back.select("properties.src", line.alias("c"))
    return rows.select("src", *(F.col("c")[i][j].alias(n) for n, i, j in (("x", 0, 0), ("y", 0, 1), ("left_x", 1, 0), ("left_y", 1, 1))))


@query(f"""WITH {O.RINGS}, sq AS (SELECT area, x0 - 12 x, y0 - 12 y, s + 24 s FROM parts), px AS (SELECT area, x + i x, y + j y FROM (SELECT *, unnest(range(s)) i FROM sq), range(84) b(j) WHERE j < s)
SELECT area, CAST(count(DISTINCT (x, y)) AS DOUBLE) size FROM px GROUP BY area""")
def dissolve(spark, sf):
    """Squares 12 units around each building, united: the size of each town's union."""
    b = vertices.boxes(world.obstacles(spark, sf)).selectExpr("area", "polygon_id", "min_x - 12 a", "min_y - 12 b", "max_x + 12 c", "max_y + 12 d")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("a", "b"), corner("c", "b"), corner("c", "d"), corner("a", "d"), corner("a", "b"))
    return overlay.dissolve(b.select("area", "polygon_id", F.array(ring).alias("rings"))).groupBy("area").agg(F.round(F.sum("size"), 6).alias("size"))


def _packed(spark, sf):
    """Each image of 100 x 100 as bytes; pixels without an order are black."""
    import numpy as np
    import pyarrow as pa

    def pack(table: pa.Table) -> pa.Table:
        image = np.zeros((vision.SIDE, vision.SIDE, 3), dtype=np.uint8)
        at = (table.column("py").to_numpy(), table.column("px").to_numpy())
        for k, c in enumerate("bgr"):
            image[(*at, k)] = table.column(c).to_numpy()
        size = pa.array([vision.SIDE], pa.int32())
        return pa.table({"stem": [str(table.column("image_id")[0].as_py())], "width": size, "height": size, "data": pa.array([image.tobytes()], pa.binary())})

    return world.pixels(spark, sf).groupBy("image_id").applyInArrow(pack, overlay.IMAGE)


@query()
def resize_bilinear(spark, sf):
    return overlay.resize_bilinear(_packed(spark, sf), 40, 40).select("stem", "width", "height", F.sha2("data", 256).alias("digest"))


@query()
def augment_colors(spark, sf):
    return overlay.augment_colors(_packed(spark, sf), 2, 11).select("stem", "width", "height", F.sha2("data", 256).alias("digest"))
