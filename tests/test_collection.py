"""Features in one file."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skyroute.sources import collection, readers
from skyroute.sources.collection import write_collection
from skyroute.sources.writers import class_features, leg_features


def test_one_file_in_the_order_of_partitions(spark, tmp_path):
    path = tmp_path / "deep" / "map.geojson"
    ring = "array(array(named_struct('x', double(id), 'y', 0.5D), named_struct('x', 1D, 'y', 2D), named_struct('x', double(id), 'y', 0.5D)))"
    # of ten partitions some are empty
    df = spark.range(0, 100, 1, 10).where("id % 20 < 10").selectExpr(f"{ring} rings", "concat('été-', id) kind")
    for _ in range(2):  # what is there is replaced
        write_collection(class_features(df, "kind"), f"file://{path}")
        data = json.loads(path.read_text())
        assert data["type"] == "FeatureCollection" and [f["properties"]["type"] for f in data["features"]] == [f"été-{k}" for k in range(100) if k % 20 < 10]
        assert data["features"][3]["geometry"] == {"type": "Polygon", "coordinates": [[[3.0, 0.5], [1.0, 2.0], [3.0, 0.5]]]}
        assert [f.name for f in path.parent.iterdir() if not f.name.endswith(".crc")] == ["map.geojson"]


def test_no_features(spark, tmp_path):
    write_collection(spark.createDataFrame([], "value string"), f"file://{tmp_path}/none.geojson")
    assert json.loads((tmp_path / "none.geojson").read_text()) == {"type": "FeatureCollection", "features": []}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    broken = spark.range(0, 20, 1, 4).select(F.when(F.col("id") == 17, F.raise_error(F.lit("no such shape"))).otherwise("{}").alias("value"))
    with pytest.raises(Exception, match="no such shape"):
        write_collection(broken, f"file://{tmp_path}/map.geojson")
    assert not [f for f in tmp_path.iterdir() if "map" in f.name]


def test_legs_without_target_or_line(spark):
    kind = "request_id int, leg_no int, status string, target_x double, target_y double, line array<struct<x:double,y:double>>, length double"
    rows = [(1, 0, "end", 2.0, 3.0, [(0.0, 1.0), (2.0, 3.0)], 2.8), (2, 0, "no path to end", None, None, None, None), (3, 0, "end", 4.0, 4.0, [(4.0, 4.0)], 0.0)]
    out = [json.loads(r.value) for r in leg_features(spark.createDataFrame(rows, kind)).collect()]
    assert [(f["properties"]["request_id"], f["geometry"]["type"], f["geometry"]["coordinates"]) for f in out] == [
        (1, "Point", [2.0, 3.0]), (1, "LineString", [[0.0, 1.0], [2.0, 3.0]]), (3, "Point", [4.0, 4.0]),
    ]


def test_a_task_that_goes_on_after_an_abort_leaves_nothing(tmp_path, monkeypatch):
    monkeypatch.setattr(collection, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    writer = collection.CollectionSource({"path": f"file://{tmp_path}/map.geojson"}).writer(None, False)
    writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([("{}",)]))
    assert not list(tmp_path.iterdir())


def test_a_collection_is_read_by_many_tasks(spark, tmp_path):
    ring = "array(array(named_struct('x', double(id), 'y', 0.5D), named_struct('x', 1D, 'y', 2D), named_struct('x', double(id), 'y', 0.5D)))"
    path = f"file://{tmp_path}/map.geojson"
    write_collection(class_features(spark.range(1000).selectExpr(f"{ring} rings", "concat('été, ]}-', id) kind"), "kind"), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        read = readers.read_collection(spark, path, "properties struct<type:string>, geometry struct<type:string,coordinates:array<array<array<double>>>>")
        assert read.rdd.getNumPartitions() > 4
        assert sorted((r.f.properties.type, r.f.geometry.coordinates[0][0][0]) for r in read.collect()) == sorted((f"été, ]}}-{k}", float(k)) for k in range(1000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_collection_of_another_layout_is_no_silent_loss(spark, tmp_path):
    for text in ('{"type":"FeatureCollection","features":[{"type":"Feature"}]}', '{"type":"FeatureCollection","features":[\n{"type":"Feature","properties":\n{}}\n]}'):
        (tmp_path / "other.geojson").write_text(text)
        with pytest.raises(Exception, match="no line of a feature"):
            readers.read_collection(spark, f"file://{tmp_path}/other.geojson", "properties struct<type:string>").collect()
    write_collection(spark.createDataFrame([], "value string"), f"file://{tmp_path}/none.geojson")
    assert readers.read_collection(spark, f"file://{tmp_path}/none.geojson", "properties struct<type:string>").count() == 0
