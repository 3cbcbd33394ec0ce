"""Terms against a regular expression; the audit against plain loops and against SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyroute.llm import divergence, terms
from skyroute.llm.divergence import billionths, source_divergence

PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, salt int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbÉß 1.\n_🦜", max_size=40)), max_size=8), st.integers(1, 30))
def test_term_counts(texts, stretch):
    before, terms.STRETCH_BYTES = terms.STRETCH_BYTES, stretch
    try:
        found = terms.term_counts(pa.array([None, *texts], pa.string()).slice(1), terms.NOT_LETTERS)
    finally:
        terms.STRETCH_BYTES = before
    got = {(int(t), found.terms[int(k)].as_py().decode()): int(n) for t, k, n in zip(found.text, found.term, found.count, strict=True)}
    want = Counter((i, w) for i, text in enumerate(texts) for w in PATTERN.findall((text or "").translate(UPPER)))
    assert got == want and len(found.text) == len(want)
    assert found.totals(len(texts)).tolist() == [sum(n for (i, _), n in want.items() if i == k) for k in range(len(texts))]


@given(st.integers(0, 10**15), st.integers(0, 10**15))
def test_billionths_are_exact(count, more):
    assert billionths(np.array([count]), count + 2 + more)[0] == 1 + 10**9 * (count + 2) // (count + 2 + more)


def _plain(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = PATTERN.findall(text.translate(UPPER))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out, groups = [], {(lang, source) for _, lang, source in rows}
    share = lambda own, kept: {t: 1 + 10**9 * (own[t] + 2) // (sum(own[x] for x in kept) + 2 * len(kept)) for t in kept}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        p = share(count[lang, source], kept)
        q = share(sum((count[g] for g in groups if g[0] == lang), Counter()), kept)
        found = {"pair": [], "term": []}
        for other in {s for x, s in groups if x == lang} - {source}:
            theirs = share(count[lang, other], kept)
            found["pair"].append((-sum(f(p[t], theirs[t]) for t in kept), other.encode()))
        for t in kept:
            if count[lang, source][t] and p[t] > q[t]:
                found["term"].append((-f(p[t], q[t]), t.encode()))
        for part, items in found.items():
            for k, (value, item) in enumerate(sorted(items)):
                if part == "pair" or k < top:
                    out.append((lang, source, part, item.decode(), -value, k + 1))
    return sorted(out)


def _documents(rng):
    words = ["a", "b", "é", "z", "zz", "Ω", "ab", "🦜"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
        rows.append((rng.choice([text, text, text.upper(), None, "", "12 34"]), rng.choice(["en", "en", "fr", None]), rng.choice(["x", "x", "y", "Z", "é", None, ""])))
    rows += [("only here", "de", "one"), (None, "xx", "p"), ("1", "xx", "q"), ("rare", "xx", "r")]  # one source; no kept terms
    rows += [("tie tie", "tt", "u"), ("eit eit", "tt", "u"), ("tie eit", "tt", "v")] * 12
    rows.append(("b " * 200_000 + "a", "fr", "x"))  # longer than a stretch
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk_cells": 40}, {"least_docs": 3, "top": 2, "chunk_cells": 7}])
def test_against_plain_loops(spark, options, monkeypatch):
    rows = _documents(random.Random(5))
    docs = spark.createDataFrame([(1, *r, "clash", 3, 9) for r in rows], SCHEMA).repartition(3)
    if options:
        monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
        monkeypatch.setattr(divergence, "HELD_ROWS", 10)
    got = sorted(map(tuple, source_divergence(docs, **options).collect()))
    assert got == _plain(rows, options.get("least_docs", 10), options.get("top", 10))


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    assert source_divergence(spark.createDataFrame([(1, None, None, None, "", 1, 1)], SCHEMA)).count() == 0


def test_against_sql(spark):
    import duckdb

    from skyroute.llm.queries import op12_divergence, oracle_sql

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.sql(oracle_sql()["op12_divergence"])
    assert sorted(map(tuple, op12_divergence(spark, folder).select(*want.columns).collect())) == sorted(want.fetchall())
