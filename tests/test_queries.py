"""Every registered query with SQL gives the SQL's rows."""

import duckdb
import pytest

from skyroute.jobs import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    return sorted(tuple(repr(float(x)) if type(x).__name__ == "Decimal" else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, base, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    expected = base.sql(queries.oracle_sql()[name])
    assert sorted(expected.columns) == cols
    order = [expected.columns.index(c) for c in cols]
    assert _plain(tuple(r) for r in df.select(*cols).collect()) == _plain(tuple(r[k] for k in order) for r in expected.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(queries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


# what these rows must be is tested in test_images_and_batches.py and test_geometry.py
@pytest.mark.parametrize("name", ["shuffled_batches", "augment_chips", "augment_colors", "resize_bilinear", "grb_to_internal"])
def test_rows_of_queries_without_sql(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["points_in_polygons", "visible_pairs", "bbox_intersects", "recharge_candidates", "path_zone_conflicts", "zone_passages", "rasterize", "propulsion_sweep"])
def test_plans_without_nested_loops(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_store_costs_with_nulls(spark):
    from skyroute.operators.design import store_costs

    rows = [("a", 2.0, 3.0), ("a", None, 1.0), (None, 5.0, 5.5), ("b", 1.0, None)]
    out = {r.store: tuple(r)[1:] for r in store_costs(spark.createDataFrame(rows, "store string, price double, paid double")).collect()}
    assert out == {"a": (2, 2.0, 4.0, 2.0), None: (1, 5.0, 5.5, 0.5), "b": (1, 1.0, None, None)}
    assert store_costs(spark.createDataFrame([], "store string, price double, paid double")).count() == 0


def test_coco_categories(spark):
    from skyroute.operators.chips import coco_categories

    assert [tuple(r) for r in coco_categories(spark, ["building", "water"]).orderBy("id").collect()] == [(0, "building"), (1, "water")]


def test_equal_designs_meet_motors_once(spark):
    """The join with motors has a row for each mass and speed, not for each design."""
    from skyroute.operators import design

    motors = spark.createDataFrame([(k, 1000.0, 900.0, 50.0 + k) for k in range(5)], "motor_id long, kv double, thrust_g double, mass_g double")
    designs = spark.range(1000).selectExpr("id design_id", "double(400 + id % 2 * 100) mass_g", "10D speed_ms")
    found = design.propulsion_sweep(designs, motors)
    assert found.count() == 3000
    assert {(r.motor_id, r.cells, r.place) for r in found.collect()} == {(0, 4, 1), (1, 4, 2), (2, 4, 3)}
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [mass_g" in joined
