import random

import pytest

from skyroute.llm.substring_dedup import remove_repeats
from skyroute.llm.suffix_automaton import SuffixAutomaton
from tests.llm import brute


def removed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in remove_repeats(df, with_text=False, **options).collect())


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(10, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [rng.choice(words) for _ in range(rng.randrange(0, 30))]
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edited"
            text += p[rng.randrange(0, 4) :]
        rows.append((rng.randrange(10**6) * n + i, rng.choice([" ", "\n", "  "]).join(text)))
    return rows


EDGES = [(1, None), (2, ""), (3, " "), (4, "a " * 12), (5, "a " * 13), (6, "a " * 14), (7, "b " * 30), (8, "B " * 30), (9, "é " * 20), (10, "é " * 20)]


@pytest.mark.parametrize(("most_anchors", "part_anchors"), [(20_000, 2_000), (3, 2)])
def test_against_brute_force(spark, most_anchors, part_anchors):
    """With low limits shards are split by anchor and dealt in parts by document."""
    rows = corpus() + EDGES
    assert removed(spark, rows, most_anchors=most_anchors, part_anchors=part_anchors) == sorted(brute.without_repeats(rows))


def test_anchors_without_their_windows(spark):
    """The first document has the anchors only; later ones share windows, some with words between, in two groups."""
    rng = random.Random(12)
    anchor = ["aa", "bb", "cc", "dd", "ee"]
    rows = [(0, " ".join(f"x{k} {' '.join(anchor)} y{k}" for k in range(5)))]
    for group in range(2):
        own = [f"g{group}w{k}" for k in range(9)]
        passage = [*own, *anchor, *reversed(own)]
        for i in range(1, 9):
            rows.append((10 * i + group, " ".join([f"d{i}"] * rng.randrange(3) + passage[rng.randrange(6) :] + [f"e{i}"] + passage)))
    for limits in ({}, {"most_anchors": 2, "part_anchors": 1}):
        assert removed(spark, rows, **limits) == sorted(brute.without_repeats(rows))


def test_text_that_is_kept(spark):
    run = " ".join(f"r{i}" for i in range(13))
    rows = [(1, f"start\n{run}\nend"), (2, f"own words\n{run}\nmore  words "), (3, run), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in remove_repeats(df).collect()} == {1: f"start\n{run}\nend", 2: "own words\nmore  words", 3: "", 4: None}


def test_empty_repeated_and_clashing_columns(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    run = " ".join(f"r{i}" for i in range(20))
    df = spark.createDataFrame([(1, run, 1, "a"), (1, run, 2, "b"), (2, run, 3, "c"), (None, run, 4, "d")], "doc_id long, text string, id int, spans string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(df).collect()) == [(1, 20, 0), (1, 20, 0), (2, 20, 20)]


def test_carried_columns_of_repeated_rows(spark):
    """Each row keeps its own columns, also where an id repeats; a document that repeats its own line keeps all of it."""
    run = " ".join(f"r{i}" for i in range(20))
    df = spark.createDataFrame([(1, run, 1, "a"), (1, run, 2, "b"), (2, f"own {run}", 3, None), (3, " ".join([run] * 40), 4, "d")], "doc_id long, text string, n_words int, id string")
    got = remove_repeats(df.withColumnsRenamed({"n_words": "n", "id": "kind"}), carried=("n", "kind"))
    assert sorted((r.doc_id, r.n, r.kind or "", r.kept_text) for r in got.collect()) == [(1, 1, "a", run), (1, 2, "b", run), (2, 3, "", "own "), (3, 4, "d", "")]


def test_long_text(spark):
    rng = random.Random(8)
    long = [f"t{rng.randrange(3000)}" for _ in range(40_000)]
    rows = [(2, " ".join(long)), (1, " ".join(long[10_000:10_050])), (3, " ".join(long[5_000:30_000]))]
    assert removed(spark, rows) == sorted(brute.without_repeats(rows))


def test_whole_documents_table(spark):
    from skyroute.llm.queries import op2_substring_dedup

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op2_substring_dedup(spark, folder).collect()) == sorted(brute.without_repeats(rows))


def test_matching_statistics():
    rng = random.Random(9)
    for _ in range(30):
        passages = [[rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in range(3)]
        text = [rng.choice("abcd") for _ in range(15)]
        automaton = SuffixAutomaton()
        for p in passages:
            automaton.add(p)
        held = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i, len(p) + 1)}
        expected = [max(k for k in range(i + 2) if tuple(text[i + 1 - k : i + 1]) in held or k == 0) for i in range(len(text))]
        assert automaton.matching_statistics(text) == expected
