"""Jump hashing against the published loop; slots, growth and written shards."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyroute.llm.sharding import jump_shard, moved, sharded, write_shards


def _key(value):
    part = "-" if value is None else f"{len(str(value).encode())}:{value}"
    return int(hashlib.md5(part.encode()).hexdigest()[:16], 16)


def _jump(key, shards):
    at, following = -1, 0
    while following < shards:
        at, key = following, (key * 2862933555777941757 + 1) % 2**64
        following = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 3000])
def test_shards_of_the_published_loop(spark, shards):
    ids = spark.range(-50, 250).union(spark.createDataFrame([(2**63 - 1,), (-(2**63),), (None,)], "id long"))
    found = {r.id: r.shard for r in ids.select("id", jump_shard(shards, F.col("id")).alias("shard")).collect()}
    assert found == {i: _jump(_key(i), shards) for i in found}


def test_keys_of_several_columns(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None), (None, "a")], "x string, y string")
    one = [r.s for r in rows.select(jump_shard(1 << 20, F.col("x"), F.col("y")).alias("s")).collect()]
    assert len(set(one)) == 4


def test_odd_rows(spark):
    rows = [(1, "aé"), (1, "aé"), (1, None), (None, ""), (None, "x" * 300_000), (2, None)] + [(7, "same")] * 500
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, shard int, slot string").repartition(5)
    out = sharded(docs, 5).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    for r in out:
        assert (r.law, r.shard, r.grown_shard) == ("key", _jump(_key(r.doc_id), 5), _jump(_key(r.doc_id), 6))
    for shard, n in Counter(r.shard for r in out).items():
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(n))
    assert sharded(docs.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        sharded(docs, 0)


def test_only_the_necessary_rows_move(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    gone = moved(docs, 24, 30).groupBy("shard").count().collect()
    assert {r.shard for r in gone} == set(range(24, 30))
    assert abs(sum(r["count"] for r in gone) - 20_000 * 6 / 30) < 300
    with pytest.raises(ValueError):
        moved(docs, 5, 4)


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w" * (i % 50), f"s{i}") for i in range(300)] + [(9, "w" * 9, "s9")] * 200, "doc_id long, text string, source string")
    write_shards(docs, f"file://{tmp_path}/shards", 4, file_bytes=1000)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    assert all(_jump(_key(r.doc_id), 4) == r.shard for r in back.collect())
    hot = f"{tmp_path}/shards/shard={_jump(_key(9), 4)}"
    import os

    assert sum(x.endswith(".parquet") for x in os.listdir(hot)) > 1


def test_against_sql(spark):
    import duckdb

    from skyroute.llm.queries import op13_sharding, oracle_sql

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.sql(oracle_sql()["op13_sharding"])
    assert sorted(map(tuple, op13_sharding(spark, folder).select(*want.columns).collect())) == sorted(want.fetchall())


def test_no_python_workers(spark):
    from skyroute.llm.queries import op13_sharding

    plan = op13_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
