"""Parts sheets, pairs of files and chip metadata."""

from skyroute.operators.design import parts_rollup, reconcile, store_costs
from skyroute.sources import readers, writers

WEIGHTS = "Part\tVolume\tSolid\tWeight\tArea\tCount\tTotal\nWing\t10\t0.3\t250.5\t\t2\t501\n\n\t\t\t\t\t\t\nServo\t\t\t35\t\t4\t140\nCamera\t\t\t\t\t\t74\n\nTotal\t\t\t\t\t\t715\n"
PRICES = 'Part,Name,Store,Link,Each,#,Total\n"Servo, big","25T ""s""",Shop,http://x,8.88,4,35.52\n,,,,,,\n"Total",,,,,,36\n'
RECEIPT = "Name,Link,Price,Paid,Fees\nShop,http://x,348.37,397.59,49.22\nFriend,,40,40,0\n,,,,\nTotal,,,437.59,49.22\n"


def sheet(spark, tmp_path, name, text, schema, sep=","):
    (tmp_path / name).write_text(text)
    return readers.read_parts_sheet(spark, f"file://{tmp_path}/{name}", schema, sep)


def test_weights(spark, tmp_path):
    lines, printed = sheet(spark, tmp_path, "weights.csv", WEIGHTS, readers.WEIGHT_SHEET, "\t")
    assert sorted(r.part for r in lines.collect()) == ["Camera", "Servo", "Wing"] and [r.total for r in printed.collect()] == [715.0]
    (r,) = reconcile(lines, printed).collect()
    assert (r.parts, r.total, r.printed, r.difference, r.agrees) == (3, 715.0, 715.0, 0.0, True)
    assert max(r.total for r in parts_rollup(lines, ["part"]).collect()) == 715.0


def test_prices_and_receipts(spark, tmp_path):
    lines, printed = sheet(spark, tmp_path, "prices.csv", PRICES, readers.PRICE_SHEET)
    assert [(r.part, r.name, r["count"]) for r in lines.collect()] == [("Servo, big", '25T "s"', 4.0)]
    (r,) = reconcile(lines, printed).collect()
    assert (round(r.difference, 2), r.agrees) == (0.48, False)
    receipts, totals = sheet(spark, tmp_path, "receipt.csv", RECEIPT, readers.RECEIPT_SHEET)
    assert {r.store: round(r.fees, 2) for r in store_costs(receipts).collect()} == {"Shop": 49.22, "Friend": 0.0}
    assert [(r.paid, r.fees) for r in totals.collect()] == [(437.59, 49.22)]


def test_sheets_without_lines_or_totals(spark):
    kind = "sheet string, unit double, count double, total double"
    lines = spark.createDataFrame([("a", 2.0, 3.0, None), ("c", 1.0, 1.0, None)], kind)
    printed = spark.createDataFrame([("b", None, None, 5.0), ("c", None, None, 1.0), ("c", None, None, 2.0)], kind)
    out = {r.sheet: (r.parts, r.total, r.printed, r.agrees) for r in reconcile(lines, printed).collect()}
    assert out == {"a": (1, 6.0, None, False), "b": (0, 0.0, 5.0, False), "c": (1, 1.0, None, False)}


def test_pairs_of_folders(spark, tmp_path):
    files = {"images": {"a.png": b"A", "b.v2.png": b"B", "only.png": b"O", "none.png": b"N", ".hidden": b"H"}, "masks": {"a.png": b"a", "b.v2.gif": b"b", "none.png": b"", "left.png": b"L"}}
    for folder, content in files.items():
        (tmp_path / folder).mkdir()
        for name, data in content.items():
            (tmp_path / folder / name).write_bytes(data)
    pairs, mismatches = readers.read_pairs(spark, f"file://{tmp_path}/images", f"file://{tmp_path}/masks")
    assert sorted((r.stem, bytes(r.image), bytes(r.label_mask)) for r in pairs.collect()) == [("a", b"A", b"a"), ("b.v2", b"B", b"b")]
    assert sorted(tuple(r) for r in mismatches.collect()) == [("left", False, True), ("none", True, False), ("only", True, False)]


def test_chip_metadata_round_trip(spark, tmp_path):
    rows = [("s-1", "water", 5), ("s-1", "building", 7), ("s-2", None, None)]
    path = f"file://{tmp_path}/meta"
    writers.write_chip_metadata(spark.createDataFrame(rows, "stem string, label string, pixels long"), path, (512, 256), (128, 64))
    assert sorted(map(tuple, readers.read_chip_metadata(spark, path).collect()), key=repr) == sorted(rows, key=repr)
    assert sorted(map(tuple, readers.read_chip_grids(spark, path).collect())) == [("s-1", 512, 256, 128, 64), ("s-2", 512, 256, 128, 64)]
    (tmp_path / "old.json").write_text('{"nbroLabelPixels": {"x": {}}}')
    assert [tuple(r) for r in readers.read_chip_grids(spark, f"file://{tmp_path}/old.json").collect()] == [("x", None, None, None, None)]
