import gzip
import io
import random

from skyroute.llm import warc
from skyroute.llm.decontaminate import contamination
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_contamination_of_whole_tables(spark):
    from skyroute.llm.queries import op6_decontaminate

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in op6_decontaminate(spark, SF).collect())
    assert got == sorted(brute.contamination(docs, items))
    assert any(r[5] for r in got)


def _small():
    rng = random.Random(4)
    words = ["Ab", "c", "d1", "é", "fg"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 10, 11, 14, 9, 5])]
    items += [(50, None), (None, "ab c d1"), (51, "zz-yy"), (51, "zz-yy")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 200)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "...ZZ!!yy..."), (102, "...ZZ!!yy..."), (103, "q " * 30_000 + items[5][1])]
    return docs, items


def test_contamination_small_cases(spark):
    docs, items = _small()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    expected = sorted(brute.contamination(docs, [x for x in items if x[0] is not None]))
    assert sorted(tuple(r) for r in contamination(d, b).collect()) == expected
    assert contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in contamination(d, b.limit(0)).collect()} == {0}


def test_contamination_in_shards(spark, monkeypatch):
    """Many shards and small batches of texts give the same rows as one, repeated ones and those without an id each."""
    from skyroute.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BATCH_BYTES", 2000)
    docs, items = _small()
    docs += [(None, docs[5][1]), (None, docs[6][1]), docs[7]]
    items = [x for x in items if x[0] is not None]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    expected = sorted(brute.contamination(docs, items), key=key)
    assert sorted((tuple(r) for r in contamination(d, b, shard_words=10).collect()), key=key) == expected
    assert sorted((tuple(r) for r in contamination(d, b).collect()), key=key) == expected


def test_archives_of_whole_table(spark):
    from skyroute.llm.queries import op7_warc

    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    key = lambda r: (r[0], str(r))
    assert sorted((tuple(r) for r in op7_warc(spark, SF).collect()), key=key) == sorted(brute.archived(pages), key=key)


def test_archives_small_cases(spark):
    pages = [(1, "u1", "a"), (2, None, "a"), (3, "u\r\n3", None), (4, "u4", ""), (5, "ü", "é" * 100_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (6, "u", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*p, "x", 2) for p in [*pages, (None, "u", "h")]], "page_id long, url string, html string, digest string, payload int")
    got = sorted((tuple(r) for r in warc.archived_pages(df).collect()), key=str)
    assert got == sorted(brute.archived([(p, h) for p, _, h in pages]), key=str)
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_every_split_finds_its_records(spark):
    """Round trip with tiny archives and ranges: each record is read once, whatever the ranges."""
    rng = random.Random(6)
    pages = [(i, f"http://h/{i}", "".join(rng.choice("abcdefgh <>") for _ in range(rng.randrange(0, 3000)))) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_warc(df, archive_bytes=20_000)
    assert manifest.count() > 3
    for size in (97, 5_000, 1 << 20):
        got = {(r.target_uri, bytes(r.payload)) for r in warc.read_warc(manifest, split_bytes=size).collect()}
        assert got == {(u, h.encode()) for _, u, h in pages}


def test_members_skip_what_only_looks_like_one():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    member = gzip.compress(record)
    junk = b"\x1f\x8b\x08 not a member " + gzip.compress(b"no record")
    data = junk + member + junk + member + member[:-9]
    found = list(warc.members(io.BytesIO(data), 0, len(data)))
    assert [o for o, _ in found] == [len(junk), 2 * len(junk) + len(member)]
    assert warc.parse(found[0][1])["payload"] == b"abc"
    cut = len(junk) + 1
    assert [o for o, _ in warc.members(io.BytesIO(data), 0, cut)] + [o for o, _ in warc.members(io.BytesIO(data), cut, len(data))] == [o for o, _ in found]
