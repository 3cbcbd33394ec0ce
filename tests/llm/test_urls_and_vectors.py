import numpy as np

from pyspark.sql import functions as F
from skyroute.llm import hash_forest, url_filter
from skyroute.llm.queries import op3_url_filter, op5_hash_forest, oracle_sql

SF = "/root/testdata/sf0.001"


def test_url_filter_against_sql(spark):
    import duckdb

    base = duckdb.connect()
    base.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    expected = sorted(base.sql(oracle_sql()["op3_url_filter"]).fetchall())
    cols = ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(tuple(r) for r in op3_url_filter(spark, SF).select(*cols).collect()) == expected
    assert {r[4] for r in expected} == {"allow", "block"}


CASES = [
    (1, None, "", "", None, "allow"),
    (2, "no scheme.org/a", "", "", None, "allow"),
    (3, "http://Example.ORG/es/x?y", "example.org", "/es/x", "example.org/es/", "block"),
    (4, "http://a.example.org/en/12#z", "a.example.org", "/en/12", "example.org/en/1", "block"),
    (5, "https://example.org", "example.org", "", None, "allow"),
    (6, "https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (7, "http://x.com/fr/://y", "x.com", "/fr/://y", "com/fr/", "allow"),
    (8, "http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    (9, "http://www.cheap-pills.example.net/a", "www.cheap-pills.example.net", "/a", None, "block"),
    (10, "http://cheap-pills.example.net.de/a", "cheap-pills.example.net.de", "/a", None, "allow"),
    (11, "http://?q", "", "", None, "allow"),
    (12, "http://org", "org", "", None, "allow"),
    (13, "http://ÄB.net/Ä?", "Äb.net", "/Ä", None, "allow"),
]


def test_url_cases(spark):
    rows = [c[:2] for c in CASES] + [(3, CASES[2][1])]
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, key string")
    expected = sorted([(c[0], *c[2:]) for c in CASES] + [(3, *CASES[2][2:])], key=str)
    for limit in (url_filter.MAX_BYTES, 0):  # the cascade, and the join beyond its limit
        got = sorted((tuple(r) for r in url_filter.url_filter(df, max_bytes=limit).collect()), key=str)
        assert got == expected
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_hosts_of_a_million_characters(spark):
    long = "a." * 500_000
    urls = [f"http://{long}listed.net/x", f"http://{long}net/", f"http://{'b' * 1_000_000}/", "http://x.b.c.d.e/", "http://c.d.e/"]
    listed = spark.createDataFrame([("listed.net",), ("b.c.d.e",), (None,)], "key string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for limit in (url_filter.MAX_BYTES, 0):
        got = {r.page_id: r.verdict for r in url_filter.url_filter(pages, listed, (), max_bytes=limit).collect()}
        assert got == {0: "block", 1: "allow", 2: "allow", 3: "block", 4: "allow"}


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3000).select(F.concat(F.lit("key-"), "id").alias("key"))
    listed = keys.where(F.xxhash64("key") % 5 == 0).union(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    cascade = url_filter.build_cascade(keys, listed)
    assert len(cascade.bits) > 2  # some keys were passed wrongly, so deeper levels were needed
    got = cascade.contains(keys, F.array("key"), "hit").where("hit").select("key")
    wanted = listed.where("key like 'key-%'")
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0
    none = url_filter.build_cascade(keys, listed.limit(0))
    assert none.contains(keys, F.array("key"), "hit").where("hit").count() == 0


def test_recall_on_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    found = op5_hash_forest(spark, SF).toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    assert hash_forest.recall(found, ids, x) >= 0.9
    queries = set(ids[ids % 20 == 0].tolist())
    assert set(found.query_id) == queries and (found.groupby("query_id").size() == 20).all()
    at = {i: k for k, i in enumerate(ids.tolist())}
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        np.testing.assert_allclose(own.score, [x[at[q]] @ x[at[v]] for v in own.vec_id], rtol=1e-12)
        assert sorted(zip(-own.score, own.vec_id, strict=True)) == list(zip(-own.score, own.vec_id, strict=True))


def _nearest(spark, rows, k=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label string")
    got = hash_forest.nearest(df, F.col("id") % 2 == 0, k=k, reach=1e9).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got)


def test_vectors_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (2, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [1.0, 0.0]), (4, [0.5, 0.5]), (7, [-1.0, 0.0]), (9, None), (11, [0.0, 0.0]), (13, [nan, 1.0]), (15, [inf, 1.0]),
        (17, [None, 1.0]), (19, [1.0, 2.0, 3.0]), (3, [1.0, 0.0]), (None, [1.0, 1.0]),
    ]
    assert _nearest(spark, rows) == [(2, 1, 3, 1.0), (2, 2, 5, 1.0), (2, 3, 4, 0.5), (4, 1, 2, 0.5), (4, 2, 3, 0.5), (4, 3, 5, 0.5)]
    assert _nearest(spark, []) == [] and _nearest(spark, rows[:1]) == []


def test_many_equal_vectors_and_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(100)] + [(i, (rng.standard_normal(3) * rng.uniform(0.1, 9)).tolist()) for i in range(100, 160)]
    got = _nearest(spark, rows, k=5)
    x = np.array([r[1] for r in rows])
    for q in (0, 50, 98, 100, 158):
        score = x @ x[q]
        best = sorted((-round(s, 9), i) for i, s in enumerate(score.tolist()) if i != q)[:5]
        assert [(i, -s) for s, i in best] == [(v, s) for a, _, v, s in got if a == q]
