"""TPUT against a search that scores every document, and against SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skyroute.llm import ranked_search as search
from skyroute.llm.ranked_search import impacts, ranked_search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOCS = "doc_id long, text string, term string, block long, impact int"
ITEMS = "item_id string, text string, best int, ids string"


def _words(text):
    return PATTERN.findall((text or "").translate(UPPER))


def _plain(docs, items, top):
    docs = [(i, Counter(_words(t))) for i, t in docs if i is not None]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    asked = defaultdict(list)
    for item, text in set(items):
        if item is not None:
            asked[item] += _words(text)
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in docs:
            m = 100 - 75 + 75 * c.total() * n_docs // n_terms
            scores.append((-sum(weight[w] * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if c[w]), i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top]) if s < 0]
    return sorted(out)


def _corpus(rng):
    words = [f"w{k}" for k in range(60)] + ["É", "é", "2024", "🦜"]
    often = [w for k, w in enumerate(words) for _ in range(1 + 200 // (k + 1))]
    docs = [(k, " ".join(rng.choice(often) for _ in range(rng.choice([1, 5, 40, 200])))) for k in range(250)]
    docs += [(300, docs[3][1]), (300, docs[3][1]), (3, docs[3][1].upper()), (None, docs[3][1]), (301, None), (302, ""), (303, " .,!"), (304, "w1 " * 90_000 + "w63x")]
    items = [(f"q{k}", " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 12, 40])))) for k in range(30)]
    items += [("copy", docs[3][1]), ("copy", docs[3][1]), ("copy", "w7 w7"), ("none", None), ("none", ""), ("nowhere", "xyz"), (None, "w1"), ("tail", "w63x w63x w5")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"top": 3, "head": 3, "shard_pairs": 60}, {"top": 4, "head": 40, "broadcast_bytes": 0}])
def test_against_a_search_of_everything(spark, options, monkeypatch):
    docs, items = _corpus(random.Random(11))
    if options:
        monkeypatch.setattr(search, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(search, "CELLS", 200)
        monkeypatch.setattr(search, "SEGMENT", 2)
    table = spark.createDataFrame([(i, t, "clash", 5, 6) for i, t in docs], DOCS).repartition(3)
    queries = spark.createDataFrame([(i, t, 1, "clash") for i, t in items], ITEMS)
    got = sorted(map(tuple, ranked_search(table, queries, **options).collect()))
    assert got == _plain(docs, items, options.get("top", 10))


def test_empty_tables(spark):
    none, asked = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", "w", 1, "")], ITEMS)
    assert ranked_search(none, asked).count() == 0
    assert ranked_search(spark.createDataFrame([(1, "w", "", 1, 1)], DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_every_document_holds_the_term(spark):
    docs = [(k, "w") for k in range(30)]
    table = spark.createDataFrame([(i, t, "", 5, 6) for i, t in docs], DOCS)
    got = sorted(map(tuple, ranked_search(table, spark.createDataFrame([("a", "w", 1, "")], ITEMS)).collect()))
    assert got == _plain(docs, [("a", "w")], 10) and [x[2] for x in got] == list(range(len(got)))


def test_impacts_beyond_64_bits():
    n, docs, total = np.array([5, 10**8]), 3 * 10**10, 9 * 10**12
    for length, got in zip(n.tolist(), impacts(np.array([3, 3]), n, docs, total).tolist(), strict=True):
        assert got == 3 * 10**9 // (3000 + 8 * (25 + 75 * length * docs // total))


def test_against_sql(spark):
    import duckdb

    from skyroute.llm.queries import op11_ranked_search, oracle_sql

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    want = con.sql(oracle_sql()["op11_ranked_search"])
    assert sorted(map(tuple, op11_ranked_search(spark, folder).select(*want.columns).collect())) == sorted(want.fetchall())
