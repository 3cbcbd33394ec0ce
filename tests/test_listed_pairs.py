"""Pairs of files: empty ones, names that a path or a pattern would read otherwise, and listings that the driver doesn't hold."""

import hashlib

import pytest
from pyspark.sql import SparkSession

from skyroute.jobs import queries
from skyroute.sources import readers


def test_documents_without_text_are_pairs(spark, tmp_path):
    """As the query's SQL has it: a label pairs a document whatever its text."""
    rows = [(1, "", "src1"), (2, None, "src2"), (3, "x", "a_b.c%41 d/e"), (4, "y", "_src"), (5, "", ".src"), (6, "z", None), (7, "", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(1, 6)], "doc_id long, quality int").coalesce(1).write.parquet(f"file://{tmp_path}/labels.parquet")
    found = {tuple(r) for r in queries.queries()["read_pairs"](spark, str(tmp_path)).select("stem", "image", "label_mask", "paired").collect()}
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    assert found == {(f"{s}-{k}", md5(t or ""), md5("1"), True) for k, t, s in rows[:5]} | {("src1-7", None, None, False)}


def test_rows_of_one_id_are_files_of_their_own(spark, tmp_path):
    spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (1, "b", "s"), (2, "c", "s"), (2, "d", "s")], "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    found = sorted((r.stem, r.image, r.label_mask) for r in queries.queries()["read_pairs"](spark, str(tmp_path)).where("paired").collect())
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    assert found == sorted(("s-1", md5(t), md5(q)) for t in "aab" for q in "01")
    assert queries.queries()["read_pairs"](spark, str(tmp_path)).where("not paired and stem = 's-2'").count() == 2


@pytest.mark.parametrize(("pattern", "names"), [
    ("{}", {"a.png", "key=1/d.png"}),
    ("{}/*.png", {"a.png"}),
    ("{}/?ub*", {"sub/b.png", "sub/c [1].jpg"}),
    ("{}/*/{{b,x}}.png", {"sub/b.png"}),
    ("{}/s[a-u]b/c*", {"sub/c [1].jpg"}),
    ("{}/[!s]*/*.png", {"key=1/d.png"}),
])
def test_files_of_folders_and_patterns(spark, tmp_path, pattern, names):
    for name in ("a.png", ".hidden", "_hidden", "sub/b.png", "sub/c [1].jpg", "key=1/d.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    pattern = pattern.format(f"file://{tmp_path}")
    listed = {(r.path, r.size) for r in readers.listed_files(spark, pattern).collect()}
    assert listed == {(f"{tmp_path}/{name}", 0) for name in names}


def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch):
    for folder, end in (("images", "jpg"), ("masks", "png")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"a.{end}").write_bytes(b"1")
    monkeypatch.setattr(SparkSession, "read", property(lambda self, own=SparkSession.read.fget: _Reader(own(self))))
    pairs, _ = readers.read_pairs(spark, f"file://{tmp_path}/images", f"file://{tmp_path}/masks")
    assert [tuple(map(bytes, r[1:])) for r in pairs.collect()] == [(b"1", b"1")]


class _Reader:
    """A reader of tables that refuses the source whose files the driver lists."""

    def __init__(self, own):
        self._own = own

    def format(self, name):
        assert name != "binaryFile"
        return self._own.format(name)

    def __getattr__(self, name):
        return getattr(self._own, name)
