"""Folders of many short files: how many tasks read them, and that all are read."""

import pytest

from skyroute.sources import readers


@pytest.fixture
def files_of(spark, monkeypatch):
    """How many files, one for each task, each staged table has."""
    found, cut = {}, readers.cut

    def counted(df, name, **settings):
        found.setdefault(name, []).append(len((out := cut(df, name, **settings)).inputFiles()))
        return out

    monkeypatch.setattr(readers, "cut", counted)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    yield found
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pairs_of_many_files(spark, tmp_path, files_of):
    for folder, end, n in (("images", "jpg", 120), ("masks", "png", 90)):
        (tmp_path / folder).mkdir()
        for k in range(n):
            (tmp_path / folder / f"p{k}.{end}").write_bytes(f"{folder}{k}".encode())
    pairs, mismatches = readers.read_pairs(spark, f"file://{tmp_path}/images", f"file://{tmp_path}/masks")
    assert {(r.stem, bytes(r.image), bytes(r.label_mask)) for r in pairs.collect()} == {(f"p{k}", f"images{k}".encode(), f"masks{k}".encode()) for k in range(90)}
    assert {r.stem for r in mismatches.collect()} == {f"p{k}" for k in range(90, 120)}
    # each side is listed once, and not by a task for every two files
    assert len(files_of["names"]) == 2 and max(files_of["names"]) <= spark.sparkContext.defaultParallelism + 1


def test_sheets_of_many_files(spark, tmp_path, files_of):
    for k in range(120):
        (tmp_path / f"sheet-{k}.csv").write_text(f"part,volume,solid,unit,area,count,total\nrib,,,2,,{k},\n,,,,,,\nTotal,,,,,,{2 * k}\n")
    lines, printed = readers.read_parts_sheet(spark, f"file://{tmp_path}", readers.WEIGHT_SHEET)
    assert lines.count() == 120 and sorted(r.total for r in printed.collect()) == [2.0 * k for k in range(120)]
    assert files_of["sheet-lines"][0] <= spark.sparkContext.defaultParallelism + 1
