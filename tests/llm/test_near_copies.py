import random

import pytest

from skyroute.llm.jaccard_join import jaccard_join
from tests.llm import brute


def components(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {tuple(r) for r in jaccard_join(df, **options).select("doc_id", "n_shingles", "component_id").collect()}


def corpus(seed=1, groups=6, copies=14, words=60):
    """Groups of copies with more and more edits, a passage that all share, and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(12)]
    rows, i = [], 0
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words + 17 * g)]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if c % 3 == 0:
                text = text[: len(text) - rng.randrange(0, 12)]
            if c % 4 == 0:
                text += passage
            rows.append((i := i + 1, " ".join(text)))
    return rows


EDGES = [
    (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9005, "ONE"), (9006, "a b c d"), (9007, "a b c d"), (9008, "a b c d e"),
    (9009, "a b c d e f"), (9010, "a b c d f"), (9011, "x y z " * 40), (9012, "x y z " * 41), (9013, "Ünïcode wörds äre kept as théy are"),
    (9014, "ünïcode wörds äre kept as théy are"), (9015, "a\x0bb\x0cc\rd e"),
]


@pytest.mark.parametrize("frequent", [32, 3])
def test_against_brute_force(spark, frequent):
    """With a low limit nearly all signatures are pairs of the frequent class."""
    rows = corpus() + EDGES
    random.Random(2).shuffle(rows)
    assert components(spark, rows, frequent=frequent) == brute.jaccard_components(rows)


def test_long_text_and_ties(spark):
    rng = random.Random(3)
    long = [f"t{rng.randrange(5000)}" for _ in range(30_000)]
    other = list(long)
    for k in range(0, 30_000, 200):
        other[k] = "edited"
    rows = [(5, " ".join(long)), (3, " ".join(other)), (4, " ".join(long)), (1, "short text of no use to anyone here")]
    assert components(spark, rows) == brute.jaccard_components(rows)


def test_empty_repeated_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(empty).count() == 0
    text = "the same words in each of these rows"
    df = spark.createDataFrame(
        [(1, text, 7, "x", "t"), (1, text, 8, "y", "t"), (2, text, 9, "z", "t"), (None, text, 9, "z", "t")], "doc_id long, text string, n int, token string, component string"
    )
    assert sorted(tuple(r) for r in jaccard_join(df).collect()) == [(1, 4, 1), (1, 4, 1), (2, 4, 1)]


def test_whole_documents_table(spark):
    from skyroute.llm.queries import op1_jaccard_join

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in op1_jaccard_join(spark, folder).collect()} == brute.jaccard_components(rows)


def test_words_that_collide_modulo_a_power_of_two(spark):
    """A long word of two letters and its complement have equal polynomial hashes modulo 2**64, but are other words."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rows = [(1, one), (2, two), (3, f"{one} in a text of its own"), (4, f"{two} in a text of its own"), (5, one)]
    assert components(spark, rows) == brute.jaccard_components(rows) == {(1, 1, 1), (2, 1, 2), (3, 3, 3), (4, 3, 4), (5, 1, 1)}


def test_very_long_text_among_its_near_copies(spark):
    rng = random.Random(4)
    long = [f"t{rng.randrange(20_000)}" for _ in range(200_000)]
    rows = [(1, " ".join(long))]
    for c in range(2, 6):
        copy = list(long)
        for k in range(c, 200_000, 60 * c):
            copy[k] = f"edit{c}"
        rows.append((c, " ".join(copy)))
    assert components(spark, rows) == brute.jaccard_components(rows)


def test_sizes_at_the_edges_of_bands(spark):
    """Pairs just at and just under the threshold, over many sizes, that share frequent shingles with all others."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(n, " ".join(base[:n])) for n in range(5, 400, 3)]
    assert components(spark, rows, frequent=4) == brute.jaccard_components(rows)
    tail = [(1000 + n, " ".join(base[: n - 1] + [f"x{n}"] * (1 + n // 4))) for n in range(8, 200, 7)]
    assert components(spark, rows[::9] + tail, frequent=2) == brute.jaccard_components(rows[::9] + tail)
