"""Readers of the layers' file formats; schemas are always given, never inferred.

JSON readers take one document per line, or one per file with ``multi_line``.
"""

from __future__ import annotations

import re
import struct
import zipfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroute.functions import ring_arrays
from skyroute.operators.vertices import normalize_winding
from skyroute.sources.staging import cut, spread

RINGS = "array<array<struct<x:double,y:double>>>"

#: Building and water codes of the map sheets.
CATEGORY_LABELS = {"Gba": "building", "Gbg": "building", "Wtz": "water"}

GEOZONES = (
    "features array<struct<properties:struct<name:string,lowerLimit:double,upperLimit:double,categories:string>,"
    "geometry:struct<type:string,coordinates:string>>>"
)
CONDITIONS = "features array<struct<attributes:struct<condition_en:string,Generieke_categorie_geozone:string>>>"


def sheet_catalogue(files: DataFrame, labels: dict[str, str] = CATEGORY_LABELS) -> DataFrame:
    """(sheet, code, label, path) of archives ``{code}_…_{sheet}_Shapefile.zip``; files of other codes are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.split_part(name, F.lit("_"), F.lit(1)).alias("code"), F.regexp_extract(name, r"_([^_]+)_Shapefile\.zip$", 1).alias("sheet"), "path")
    label = F.coalesce(*(F.when(F.col("code") == k, F.lit(v)) for k, v in labels.items()))
    return rows.withColumn("label", label).where("label is not null").select("sheet", "code", "label", "path")


def missing_codes(catalogue: DataFrame, files: DataFrame, codes: list[str]) -> DataFrame:
    """(sheet, code) of wanted codes that a sheet has no file of."""
    sheet = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"_([^_]+)_Shapefile\.zip$", 1)
    wanted = files.select(sheet.alias("sheet")).distinct().withColumn("code", F.explode(F.array(*map(F.lit, codes))))
    return wanted.join(catalogue.select("sheet", "code"), ["sheet", "code"], "left_anti")


def read_geozones(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """(name, lower, upper, category, polygons) of GeoJSON collections: lower limits cut, upper ones raised to whole numbers.

    A Polygon is a MultiPolygon of one; another geometry is an error.
    """
    f = spark.read.schema(GEOZONES).json(path, multiLine=multi_line).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.array(F.from_json(text, "array<array<array<double>>>"))
    many = F.from_json(text, "array<array<array<array<double>>>>")
    polygons = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).otherwise(F.raise_error(F.concat(F.lit("geometry "), kind)).cast("array<array<array<array<double>>>>"))
    p = F.col("f.properties")
    return f.select(
        p["name"].alias("name"), p["lowerLimit"].cast("int").alias("lower"), F.ceil(p["upperLimit"]).cast("int").alias("upper"), p["categories"].alias("category"), polygons.alias("polygons")
    )


def read_conditions(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """(category, condition)."""
    f = spark.read.schema(CONDITIONS).json(path, multiLine=multi_line).select(F.explode("features").alias("f"))
    return f.select(F.col("f.attributes.Generieke_categorie_geozone").alias("category"), F.col("f.attributes.condition_en").alias("condition"))


def read_chip_metadata(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """(stem, label, pixels) of chip metadata; a chip without labels has one row of nulls."""
    meta = spark.read.schema("size array<int>, stride array<int>, nbroLabelPixels map<string,map<string,bigint>>").json(path, multiLine=multi_line)
    return meta.select(F.explode("nbroLabelPixels").alias("stem", "labels")).select("stem", F.explode_outer("labels").alias("label", "pixels"))


def read_chip_grids(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """(stem, width, height, stride_x, stride_y): the size of each chip and the step from chip to chip, null where the metadata has none."""
    meta = spark.read.schema("size array<int>, stride array<int>, nbroLabelPixels map<string,map<string,bigint>>").json(path, multiLine=multi_line)
    at = lambda c, k, name: F.get(c, F.lit(k)).alias(name)
    return meta.select(F.explode(F.map_keys("nbroLabelPixels")).alias("stem"), at("size", 0, "width"), at("size", 1, "height"), at("stride", 0, "stride_x"), at("stride", 1, "stride_y"))


def read_chip_offsets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chip string, x double, y double").csv(path, header=True)


def read_run_history(spark: SparkSession, path: str) -> DataFrame:
    """(run, epoch, metric, value) of files that hold one run each, {metric: [value per epoch]}; epochs count from 1.

    The run is the file's name without ``.json`` and ``_metrics``.  A file that is no such map gives no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"(_metrics)?\.json$", "").alias("run"), "value")
    rows = files.select("run", F.from_json("value", "map<string,array<double>>").alias("metrics"))
    return rows.select("run", F.explode("metrics").alias("metric", "values")).select("run", "metric", F.posexplode("values").alias("i", "value")).select(
        "run", (F.col("i") + 1).cast("long").alias("epoch"), "metric", "value"
    )


def pair_examples(images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, mismatches) of images and masks (stem, content): stems that only one side has are mismatches."""
    stems = images.select("stem").withColumn("has_image", F.lit(True)).join(masks.select("stem").withColumn("has_mask", F.lit(True)), "stem", "full")
    mismatches = stems.where("has_image is null or has_mask is null").select("stem", F.col("has_image").isNotNull().alias("has_image"), F.col("has_mask").isNotNull().alias("has_mask"))
    pairs = images.withColumnRenamed("content", "image").join(masks.withColumnRenamed("content", "label_mask"), "stem")
    return pairs, mismatches


_GLOB = re.compile(r"[*?\[{]")
#: A file or folder of a listing: where it is in its store.
_LISTED = "path string, size long, folder boolean"


def _component(pattern: str) -> re.Pattern:
    """A part of a path with ``*``, ``?``, ``[..]`` and ``{.., ..}`` as a regular expression."""
    out, depth, k = "", 0, 0
    while k < len(pattern):
        c, end = pattern[k], pattern.find("]", k + 2)
        if c == "[" and end > 0:
            out += "[" + re.sub(r"^[!^]", "^", pattern[k + 1 : end]).replace("\\", "\\\\") + "]"
            k = end
        elif c in "{}" or (c == "," and depth):
            depth += {"{": 1, "}": -1}.get(c, 0)
            out += {"{": "(?:", "}": ")", ",": "|"}[c]
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        k += 1
    return re.compile(out, re.DOTALL)


def listed_files(spark: SparkSession, uri: str) -> DataFrame:
    """(path, size) of the files of a folder or pattern, by ``pyarrow.fs``: folders are listed by tasks, level by level, so that the driver holds no list of them.

    As in Spark's own sources, names that begin with a dot or an underscore are hidden, a folder's files are those right in it and in folders named
    key=value, and a pattern's are the files that it fits and those of the folders that it fits.  Empty files are among them.
    """
    parts = uri.rstrip("/").split("/")
    first = next((k for k, part in enumerate(parts) if _GLOB.search(part)), len(parts))
    base, rest = "/".join(parts[:first]), parts[first:]

    def children(name: str | None, last: bool):
        wanted = _component(name) if name is not None else None

        def run(batches):
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(base)
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    own = store.get_file_info(path if path is not None else root)
                    if own.type == fs.FileType.NotFound:
                        raise FileNotFoundError(own.path)
                    found = [own] if own.type == fs.FileType.File else store.get_file_info(fs.FileSelector(own.path))
                    rows = []
                    for f in found:
                        folder, shown = f.type == fs.FileType.Directory, "=" in f.base_name or f.base_name[:1] != "_"
                        fits = wanted.fullmatch(f.base_name) if wanted else not folder or "=" in f.base_name
                        if fits and shown and f.base_name[:1] != "." and (folder or last):
                            rows.append({"path": f.path, "size": f.size, "folder": folder})
                    for k in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], schema)

        return run

    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
    here, found = spark.createDataFrame([(None,)], "path string"), []
    for k, name in enumerate(rest):
        last = k == len(rest) - 1
        here = cut(here.select("path").mapInArrow(children(name, last), _LISTED), "folders")
        if last:
            found, here = [here.where("not folder")], here.where("folder")
            if not here.limit(1).count():
                return found[0].select("path", "size")
        here = spread(here, "path")
    while True:
        names = cut(here.select("path").mapInArrow(children(None, True), _LISTED), "names")
        found.append(names.where("not folder"))
        here = spread(names.where("folder"), "path")
        if not here.limit(1).count():
            return reduce(DataFrame.union, found).select("path", "size")


def read_pairs(spark: SparkSession, images: str, masks: str, *, empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, mismatches) of the files of two folders or patterns: (stem, image, label_mask), and stems that only one side has.

    Names are listed by tasks and paired before any file is read, so that contents are never shuffled: each task opens its pairs by ``pyarrow.fs``.  A stem is the name
    without its last extension; where a side has a stem more than once, every file of it is paired.  An empty file counts as none: what
    the other side has for it is a mismatch.  With ``empty``, it counts as a file like others.
    """
    name = F.element_at(F.split("path", "/"), -1)
    listed = lambda p: listed_files(spark, p).where(F.lit(empty) | (F.col("size") > 0)).select(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"), F.col("path").alias("content"))
    paths, mismatches = pair_examples(listed(images), listed(masks))
    folders = {"image": _GLOB.split(images)[0], "label_mask": _GLOB.split(masks)[0]}

    def run(batches):
        from pyarrow import fs

        stores = {side: fs.FileSystem.from_uri(folder)[0] for side, folder in folders.items()}

        def content(side: str, path: str) -> bytes:
            with stores[side].open_input_stream(path, compression=None) as f:
                return f.read()

        kinds = pa.schema([("stem", pa.string()), ("image", pa.binary()), ("label_mask", pa.binary())])
        for batch in batches:
            rows, size = [], 0
            for row in batch.to_pylist():  # a batch of paths is short, one of contents may not be
                rows.append({"stem": row["stem"], **{side: content(side, row[side]) for side in stores}})
                size += sum(len(rows[-1][side]) for side in stores)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return spread(paths.select("stem", "image", "label_mask"), "stem").mapInArrow(run, "stem string, image binary, label_mask binary"), mismatches


#: Columns of the three parts sheets in their order, under the names that ``design.parts_rollup`` and ``design.store_costs`` take.
WEIGHT_SHEET = "part string, volume double, solid double, unit double, area double, count double, total double"
PRICE_SHEET = "part string, name string, store string, link string, unit double, count double, total double"
RECEIPT_SHEET = "store string, link string, price double, paid double, fees double"


def read_parts_sheet(spark: SparkSession, path: str, schema: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(lines, printed) of sheets with a header: the lines with their file as ``sheet``, and the line of totals that each sheet has.

    A line without anything in it is no line; the printed one is that whose first column is ``Total``, whatever its case.  Files are read once, however short.
    """
    rows = spark.read.schema(schema).csv(path, header=True, sep=sep, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    names = [f.name for f in rows.schema.fields]
    names = names[: len(schema.split(","))]  # folders named key=value add columns
    empty = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in names)).isNull()
    rows = cut(rows.select(F.col("_metadata.file_path").alias("sheet"), *names).where(~empty), "sheet-lines", many_files=True)
    total = F.lower(F.coalesce(F.col(names[0]), F.lit(""))) == "total"
    return rows.where(~total), rows.where(total)


def read_collection(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """(f): the features, of the given schema, of a FeatureCollection that has each in a line of its own, as ``collection.write_collection`` lays it out.

    Lines are dealt to tasks, so that a file of any size is read by many.  A line that is neither a feature nor the collection's head or end is an error.
    """
    line = F.regexp_replace(F.trim("value"), ",$", "")
    frame = line.isin("", '{"type":"FeatureCollection","features":[', "]}")
    error = F.raise_error(F.concat(F.lit("no line of a feature: "), F.substring(line, 1, 80))).cast("string")
    # in one expression, as Spark may try another filter before one for the frame
    sure = F.when(F.get_json_object(line, "$.type") == "Feature", line).when(~frame, error)
    return spark.read.text(path).select(F.from_json(sure, feature, {"mode": "FAILFAST"}).alias("f")).where("f is not null")


# ----------------------------------------------------------------------------------------------- well-known binary


def encode_wkb(rings: list[list[tuple[float, float]]]) -> bytes:
    """A MultiPolygon of one polygon."""
    body = b"".join(struct.pack("<I", len(r)) + np.asarray(r, dtype="<f8").tobytes() for r in rings)
    return struct.pack("<BII", 1, 6, 1) + struct.pack("<BII", 1, 3, len(rings)) + body


def decode_wkb(data: bytes) -> list[list[list[tuple[float, float]]]] | None:
    """Polygons (lists of rings) of a Polygon or MultiPolygon; None for any other geometry."""
    at = 0

    def take(order: str, n: int = 1) -> tuple[int, ...]:
        nonlocal at
        at += 4 * n
        return struct.unpack_from(f"{order}{n}I", data, at - 4 * n)

    def polygon() -> list[list[tuple[float, float]]] | None:
        nonlocal at
        order = "<" if data[at] else ">"
        at += 1
        (kind,) = take(order)
        if kind != 3:
            return None
        rings = []
        for _ in range(take(order)[0]):
            (n,) = take(order)
            xy = np.frombuffer(data, dtype=f"{order}f8", count=2 * n, offset=at).reshape(n, 2)
            at += 16 * n
            rings.append([tuple(p) for p in xy.tolist()])
        return rings

    order = "<" if data[0] else ">"
    kind = struct.unpack_from(f"{order}I", data, 1)[0]
    if kind == 3:
        return [polygon()]
    if kind != 6:
        return None
    at = 5
    return [polygon() for _ in range(take(order)[0])]


def read_polygon_layer(rows: DataFrame, geom_col: str = "geom") -> tuple[DataFrame, DataFrame]:
    """(polygons, rejected) of rows (area, polygon_id, WKB): every polygon of every row, wound as usual; other geometries are rejected.

    Polygons of a multipolygon are told apart by ``part``.
    """

    def run(batches):
        for batch in batches:
            out = {"area": [], "polygon_id": [], "part": [], "rings": []}
            for area, key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = decode_wkb(data) if data else None
                for part, rings in enumerate(found if found else [None]):
                    out["area"].append(area)
                    out["polygon_id"].append(key)
                    out["part"].append(part)
                    out["rings"].append(None if rings is None else [[{"x": x, "y": y} for x, y in r] for r in rings])
            point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("area", pa.int32()), ("polygon_id", pa.int64()), ("part", pa.int32()), ("rings", pa.list_(pa.list_(point)))]))

    read = rows.select(F.col("area").cast("int"), F.col("polygon_id").cast("long"), geom_col).mapInArrow(run, f"area int, polygon_id long, part int, rings {RINGS}")
    return normalize_winding(read.where("rings is not null")), read.where("rings is null").select("area", "polygon_id")


# ----------------------------------------------------------------------------------------------- shapefiles


def encode_shapes(polygons: list[list[list[tuple[float, float]]]]) -> bytes:
    """A .shp file of polygon records."""
    records = b""
    for k, rings in enumerate(polygons):
        points = np.array([p for r in rings for p in r], dtype="<f8").reshape(-1, 2)
        parts = np.cumsum([0] + [len(r) for r in rings[:-1]]).astype("<i4")
        box = np.concatenate([points.min(axis=0), points.max(axis=0)]).astype("<f8")
        body = struct.pack("<i", 5) + box.tobytes() + struct.pack("<ii", len(parts), len(points)) + parts.tobytes() + points.tobytes()
        records += struct.pack(">ii", k + 1, len(body) // 2) + body
    return struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<ii", 1000, 5) + bytes(64) + records


#: Shape types with rings: polygons, those with z and those with measures; parts and xy points lie at the same places in all.
_POLYGONS = (5, 15, 25)


def shape_arrays(data: bytes) -> pa.Array:
    """Rings of the polygon records that ``data`` consists of, and null for each record of another type; rings of fewer than three points are dropped."""
    at, xy, sizes, counts, null = 0, [], [], [], []
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        body = memoryview(data)[at + 8 : at + 8 + size]
        at += 8 + size
        known = struct.unpack_from("<i", body)[0] in _POLYGONS
        null.append(not known)
        counts.append(0)
        if known:
            n_parts, n_points = struct.unpack_from("<ii", body, 36)
            points = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
            lengths = np.diff(np.frombuffer(body, "<i4", n_parts, 44), append=n_points)
            xy.append(points[np.repeat(lengths >= 3, lengths)])
            sizes.append(lengths[lengths >= 3])
            counts[-1] = len(sizes[-1])
    points = np.concatenate([np.zeros((0, 2)), *xy])
    return ring_arrays.nested(points[:, 0], points[:, 1], np.concatenate([np.zeros(0, dtype=np.int64), *sizes]), np.array(counts, dtype=np.int64), np.array(null, dtype=bool))


def decode_shapes(data: bytes) -> list[list[list[tuple[float, float]]] | None]:
    """Rings of every record of a .shp file, as ``shape_arrays`` gives them."""
    return [None if r is None else [[(p["x"], p["y"]) for p in ring] for ring in r] for r in shape_arrays(data[100:]).to_pylist()]


def encode_index(shapes: bytes) -> bytes:
    """The .shx file of a .shp file: where each record begins, and the length of its content."""
    out, at = b"", 100
    while at + 8 <= len(shapes):
        (words,) = struct.unpack_from(">i", shapes, at + 4)
        out += struct.pack(">ii", at // 2, words)
        at += 8 + 2 * words
    return shapes[:24] + struct.pack(">i", (100 + len(out)) // 2) + shapes[28:100] + out


def encode_attributes(rows: list[dict[str, str]]) -> bytes:
    """A .dbf table of text fields, those of the first row."""
    names = list(rows[0]) if rows else []
    cells = [[str(r[n]).encode() for n in names] for r in rows]
    widths = [max(1, *(len(c[k]) for c in cells)) for k in range(len(names))]
    fields = b"".join(struct.pack("<11sc4xB15x", n.encode(), b"C", w) for n, w in zip(names, widths, strict=True))
    body = b"".join(b" " + b"".join(c.ljust(w) for c, w in zip(row, widths, strict=True)) for row in cells)
    return struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + len(fields), 1 + sum(widths)) + fields + b"\r" + body + b"\x1a"


def decode_attributes(data: bytes) -> list[dict[str, str | None]]:
    """Field values of every record of a .dbf table as trimmed text, deleted ones included; null where blank.

    Text is UTF-8, or Latin-1 where it is not.
    """
    n, start, width = struct.unpack_from("<IHH", data, 4)
    return _attribute_rows(data[:start], data[start : start + n * width])


def _attribute_rows(head: bytes, body: bytes) -> list[dict[str, str | None]]:
    def text(value: bytes) -> str:
        try:
            return value.decode()
        except UnicodeDecodeError:
            return value.decode("latin-1")

    start, width = struct.unpack_from("<HH", head, 8)
    fields, at, place = [], 32, 1
    while at + 32 <= start and head[at] != 0x0D:
        fields.append((text(head[at : at + 11].split(b"\0")[0]), place, place + head[at + 16]))
        place += head[at + 16]
        at += 32
    rows = (body[k : k + width] for k in range(0, len(body) - width + 1, width))
    return [{name: text(r[a:b]).strip(" \0") or None for name, a, b in fields} for r in rows]


def _opened(path: str) -> zipfile.ZipFile:
    """An archive of which only what is asked for is read."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    return zipfile.ZipFile(store.open_input_file(place))


def _record_starts(archive: zipfile.ZipFile, name: str, index: str | None) -> np.ndarray:
    """Where each record of a member begins, and where the last one ends: from the index if it lists the file's records one after the other, else from their heads."""
    size = archive.getinfo(name).file_size
    if index:
        at, words = np.frombuffer(archive.read(index)[100:], ">i4").reshape(-1, 2).astype(np.int64).T
        starts, ends = 2 * at, 2 * (at + words) + 8
        if len(starts) and starts[0] == 100 and ends[-1] <= size and (starts[1:] == ends[:-1]).all():
            return np.append(starts, ends[-1])
    found, at = [100], 100
    with archive.open(name) as member:
        while at + 8 <= size:
            member.seek(at)
            at += 8 + 2 * struct.unpack(">i", member.read(8)[4:])[0]
            found.append(at)
    return np.array(found, dtype=np.int64)


def shapefile_ranges(spark: SparkSession, pattern: str, member: str = r"(^|/)Shapefile/[^/]+\.shp$", range_bytes: int = 16 << 20) -> DataFrame:
    """(path, member, first, last, start, stop): the records from ``first`` up to ``last`` of every member, at the bytes from ``start`` up to ``stop``.

    Planned by tasks, not by the driver: an archive's task reads its directory and its indexes only.  A range has ``range_bytes`` of shapes, or one record.
    """
    import re

    kinds = pa.schema([("path", pa.string()), ("member", pa.string()), *((c, pa.int64()) for c in ("first", "last", "start", "stop"))])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _opened(path) as archive:
                    indexes = {n[:-4]: n for n in archive.namelist() if n.lower().endswith(".shx")}
                    for name in archive.namelist():
                        if re.search(member, name):
                            at = _record_starts(archive, name, indexes.get(name[:-4]))
                            first = np.flatnonzero(np.diff((at[:-1] - 100) // range_bytes, prepend=-1))
                            last = np.append(first[1:], len(at) - 1) if len(first) else first
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([path] * len(first), [name] * len(first), first, last, at[first], at[last]), kinds.types, strict=True)], schema=kinds)

    return spark.read.format("binaryFile").load(pattern).select("path").mapInArrow(run, "path string, member string, first long, last long, start long, stop long")


def read_shapefile_zips(spark: SparkSession, pattern: str, member: str = r"(^|/)Shapefile/[^/]+\.shp$", range_bytes: int = 16 << 20) -> DataFrame:
    """(path, member, record, rings, attributes) of all polygons in all archives that the pattern matches.

    A range of records (``shapefile_ranges``) is one task's row, so an archive is read by as many tasks as it has ranges, each of which holds one
    range.  Stored members are read from the range's first byte on, compressed ones are unpacked up to it.
    Records that are no polygons are rejected: they have a row with null rings.  Attributes are those of the same record in the
    table (.dbf) beside the shapes; they are null where there is no table or no such record.  Archives are opened by ``pyarrow.fs``.
    """
    kinds = [("path", pa.string()), ("member", pa.string()), ("record", pa.int32()), ("rings", ring_arrays.RINGS), ("attributes", pa.map_(pa.string(), pa.string()))]

    def attributes(archive: zipfile.ZipFile, table: str, first: int, last: int) -> list[dict[str, str | None]]:
        with archive.open(table) as f:
            head = f.read(32)
            n, start, width = struct.unpack_from("<IHH", head, 4)
            head += f.read(start - 32)
            f.seek(start + min(first, n) * width)
            return _attribute_rows(head, f.read((min(last, n) - min(first, n)) * width))

    def run(batches):
        for batch in batches:
            for path, name, first, last, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(path) as archive:
                    tables = {n[:-4]: n for n in archive.namelist() if n.lower().endswith(".dbf")}
                    with archive.open(name) as f:
                        f.seek(start)
                        rings = shape_arrays(f.read(stop - start))
                    table, n = tables.get(name[:-4]), last - first
                    fields = attributes(archive, table, first, last) if table else []
                    found = [list(f.items()) for f in fields] + [None] * (n - len(fields))
                    columns = [[path] * n, [name] * n, list(range(first, last)), rings, found]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

    # a fixed number of partitions, as the rows are small but what they stand for is not
    ranges = shapefile_ranges(spark, pattern, member, range_bytes).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "member", "first")
    return ranges.mapInArrow(run, f"path string, member string, record int, rings {RINGS}, attributes map<string,string>")
