"""Shapefiles whose polygons have z or measures, and their attributes."""

import io
import struct
import zipfile

from skyroute.sources.readers import decode_attributes, decode_shapes, encode_attributes, encode_shapes, read_shapefile_zips

RINGS = [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (1.0, 2.0)]]


def record(kind, extra):
    plain = encode_shapes([RINGS])[108:]
    body = struct.pack("<i", kind) + plain[4:] + extra
    return struct.pack(">ii", 1, len(body) // 2) + body


def test_types_with_z_and_measures():
    values = struct.pack("<10d", 0, 9, *range(8))  # range and a value for each point
    point = struct.pack("<idd", 1, 5.0, 6.0)
    data = bytes(100) + record(5, b"") + record(15, values * 2) + record(25, values) + struct.pack(">ii", 4, len(point) // 2) + point
    assert decode_shapes(data) == [RINGS, RINGS, RINGS, None]


def test_attributes():
    rows = [{"ID": "1", "NAME": "Grote Markt"}, {"ID": "20", "NAME": ""}, {"ID": "", "NAME": "Café"}]
    assert decode_attributes(encode_attributes(rows)) == [{"ID": "1", "NAME": "Grote Markt"}, {"ID": "20", "NAME": None}, {"ID": None, "NAME": "Café"}]
    assert decode_attributes(encode_attributes([])) == []
    # a table as other programs write it: a number padded on the left, a deleted record, Latin-1
    fields = struct.pack("<11sc4xBB14x", b"LBLTYPE", b"N", 5, 0) + struct.pack("<11sc4xB15x", b"STREET", b"C", 4)
    data = struct.pack("<4BIHH20x", 3, 122, 7, 4, 2, 33 + len(fields), 10) + fields + b"\r" + b"    12abc " + b"*    3\xe9   " + b"\x1a"
    assert decode_attributes(data) == [{"LBLTYPE": "12", "STREET": "abc"}, {"LBLTYPE": "3", "STREET": "é"}]


def test_archives_with_and_without_attributes(spark, tmp_path):
    for name, table in (("a", encode_attributes([{"ID": "7"}])), ("b", None)):
        content = io.BytesIO()
        with zipfile.ZipFile(content, "w") as archive:
            archive.writestr(f"Shapefile/{name}.shp", encode_shapes([RINGS, RINGS]))
            if table:
                archive.writestr(f"Shapefile/{name}.dbf", table)
        (tmp_path / f"{name}.zip").write_bytes(content.getvalue())
    rows = sorted(((r.member, r.record, r.attributes, len(r.rings)) for r in read_shapefile_zips(spark, f"file://{tmp_path}/*.zip").collect()), key=lambda r: r[:2])
    assert [r[:2] for r in rows] == [("Shapefile/a.shp", 0), ("Shapefile/a.shp", 1), ("Shapefile/b.shp", 0), ("Shapefile/b.shp", 1)]
    assert [r[2] for r in rows] == [{"ID": "7"}, None, None, None] and all(r[3] == 2 for r in rows)


def test_one_archive_by_several_tasks(spark, tmp_path):
    from skyroute.sources.readers import encode_index, shapefile_ranges

    def ring(k):
        return [[(float(k), float(i)) for i in range(4 + k % 7)]]

    shapes = encode_shapes([ring(k) for k in range(200)])
    for name, how, index in (("deflated", zipfile.ZIP_DEFLATED, True), ("stored", zipfile.ZIP_STORED, True), ("unlisted", zipfile.ZIP_DEFLATED, False)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", how) as archive:
            archive.writestr(f"Shapefile/{name}.shp", shapes)
            archive.writestr(f"Shapefile/{name}.dbf", encode_attributes([{"ID": str(k)} for k in range(150)]))
            if index:
                archive.writestr(f"Shapefile/{name}.shx", encode_index(shapes))
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as archive:
        archive.writestr("Shapefile/none.shp", shapes[:100])
    pattern = f"file://{tmp_path}/*.zip"
    ranges = [r for r in shapefile_ranges(spark, pattern, range_bytes=1000).collect() if r.member == "Shapefile/stored.shp"]
    assert len(ranges) > 10 and sum(r["last"] - r["first"] for r in ranges) == 200
    by_range = read_shapefile_zips(spark, pattern, range_bytes=1000)
    assert by_range.selectExpr("spark_partition_id() p").distinct().count() > 1
    rows = by_range.collect()
    assert len(rows) == 600 and sorted(map(repr, rows)) == sorted(map(repr, read_shapefile_zips(spark, pattern).collect()))
    for r in rows:
        assert [[tuple(p) for p in x] for x in r.rings] == ring(r.record)
        assert r.attributes == ({"ID": str(r.record)} if r.record < 150 else None)
