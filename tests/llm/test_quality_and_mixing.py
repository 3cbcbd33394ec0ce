import math
import random
from collections import defaultdict

import numpy as np
import pytest

from skyroute.llm import mixing, quality
from skyroute.llm.tables import table

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    """Fitted on the labels of one half of the documents, judged on the other."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents").where("doc_id % 3 < 2"), table(spark, "/root/testdata/sf0.1", "labels")
    got = quality.judged(docs, labels.where("doc_id % 3 = 0")).where("doc_id % 3 = 1").join(labels, "doc_id").toPandas()
    assert len(got) > 1000
    toxic, low = got.p_toxic >= quality.LIMITS["toxic"], got.p_low >= quality.LIMITS["low"]
    assert toxic[got.toxic == 1].mean() > 0.8 and toxic[got.toxic == 0].mean() < 0.02
    assert low[got.quality == 0].mean() > 0.93 and low[got.quality == 1].mean() < 0.02


def test_whole_table(spark):
    from skyroute.llm.queries import op8_quality

    got = op8_quality(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in table(spark, SMALL, "documents").select("doc_id").collect())
    assert all(0 <= r.p_low <= 1 and 0 <= r.p_toxic <= 1 and r.keep in (True, False) for r in got)


def _posterior(rows, prior):
    """The site rates by plain loops: (host, path, low) of documents with words."""
    n, hosts, paths = len(rows), defaultdict(list), defaultdict(list)
    for h, p, x in rows:
        hosts[h].append(x)
        paths[h, p].append(x)
    mean = (sum(x for *_, x in rows) + prior) / (n + 1)

    def limited(within, spread, effective):
        return min(max(within / max(spread / max(effective, 1e-9), 1e-9) - 1, 1.0), 1e6)

    def squares(groups, m):
        return sum(len(g) * (sum(g) / len(g) - m) ** 2 for g in groups)

    def effective(groups):
        return sum(map(len, groups)) - sum(len(g) ** 2 for g in groups) / sum(map(len, groups))

    whole = list(hosts.values())
    a = limited(mean * (1 - mean), squares(whole, mean) - (len(whole) - 1) * mean * (1 - mean), effective(whole)) if 1 < len(whole) < n else 1.0
    spread = size = within = 0  # of the paths, around the rates of their hosts
    for h, g in hosts.items():
        own, m = [x for (h2, _), x in paths.items() if h2 == h], sum(g) / len(g)
        spread += squares(own, m) - (len(own) - 1) * m * (1 - m)
        size += effective(own)
        within += len(g) * m * (1 - m) / n
    b = limited(within, spread, size) if len(hosts) < len(paths) < n else 1.0
    host = {h: (sum(g) + a * mean) / (len(g) + a) for h, g in hosts.items()}
    return {(h, p): (sum(g), len(g), host[h], b) for (h, p), g in paths.items()}


def test_shrinkage_against_plain_version(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["fine text here", "### $$$ %%% &&&", "other words"]), rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y"])) for i in range(300)]
    rows += [(1000, None, "a", "x"), (1001, "  ", "b", "y"), (1002, "alone", "sparse", "z"), (5, rows[5][1], rows[5][2], rows[5][3])]
    docs = spark.createDataFrame([(*r, "t", 9) for r in rows], "doc_id long, text string, source string, lang string, host string, n int")
    labels = spark.createDataFrame([(i, int("#" not in t), 0) for i, t, *_ in rows[:200]], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == len(rows)
    seen = {r.doc_id: r for r in got}
    labelled = [t for i, t, *_ in rows if i < 200]  # the repeated row counts twice
    prior = (sum("#" in t for t in labelled) + 1) / (len(labelled) + 2)
    sites = _posterior([(h, p, seen[i].evidence_low) for i, t, h, p in rows if t and t.strip()], prior)
    for i, t, h, p in rows:
        if t and t.strip():
            total, n, above, b = sites[h, p]
            assert seen[i].site_low == pytest.approx((total - seen[i].evidence_low + b * above) / (n - 1 + b), rel=1e-6)
            assert seen[i].keep == ("#" not in t)
        else:
            assert not seen[i].keep and seen[i].n_words == 0


def test_paths_of_differing_hosts_shrink_to_their_host(spark):
    """Hosts differ much and their paths not at all: a sparse path has its host's rate, whatever the other hosts are like."""
    rows = [(h, p, float(i % 10 < (9 if h == "bad" else 1))) for h in ("good", "bad") for p in range(20) for i in range(50)] + [("bad", 99, 0.0)]
    paths = spark.createDataFrame(rows, "host string, path long, low double").groupBy("host", "path").agg({"low": "sum", "*": "count"}).toDF("host", "path", "low", "n")
    assert quality._path_strength(paths, "low") > 1000
    hosts = paths.groupBy("host").agg({"low": "sum", "n": "sum"}).toDF("host", "low", "n").select("host", "n", "low")
    assert quality._host_strength(hosts, 0.5, "low") < 10


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "l")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judged(docs, none).count() == 1
    assert quality.judged(docs.limit(0), none).count() == 0
    doubtful = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.judged(docs, doubtful).count() == 1


# ----------------------------------------------------------------------------------------------- mixing


def weights(tokens, a):
    total = sum(tokens.values())
    x = {s: (t / total) ** a for s, t in tokens.items()}
    return {s: v / sum(x.values()) for s, v in x.items()}


def exponent(tokens, budget, target, limit):
    """The exponent by plain bisection."""

    def entropy(a):
        w = weights(tokens, a).values()
        return -sum(v * math.log(v) for v in w) / math.log(len(tokens)) if len(tokens) > 1 else 1.0

    def bisect(good_below):
        low, high = 0.0, 1.0
        if not good_below(low):
            return 0.0
        if good_below(high):
            return 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if good_below(mid) else (low, mid)
        return high

    repeats = lambda a: max(w * budget / tokens[s] for s, w in weights(tokens, a).items())
    return max(bisect(lambda a: entropy(a) >= target), bisect(lambda a: repeats(a) > limit))


def _docs(seed=1, n=3000):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), rng.choices(["big", "mid", "small", None], [80, 15, 4, 1])[0]) for i in range(n)]


@pytest.mark.parametrize(("target", "limit"), [(0.9, 100.0), (0.999, 3.0), (0.1, 50.0)])
def test_mixture_follows_its_weights(spark, target, limit):
    rows = _docs()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, tokens int")
    got = mixing.mixed(df, target_entropy=target, max_repeats=limit).collect()
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())
    expected = weights(tokens, exponent(tokens, total, target, limit))
    taken, passes = defaultdict(int), defaultdict(list)
    for r in got:
        taken[r.source] += r.tokens
        passes[r.id].append(r["pass"])
        assert r.weight == pytest.approx(expected[r.source], rel=1e-5)
    for s, w in expected.items():
        assert taken[s] / total == pytest.approx(w, abs=0.02)
    repeats = {s: w * total / tokens[s] for s, w in expected.items()}
    assert max(repeats.values()) <= limit * (1 + 1e-5)
    for i, _, s in rows:
        own = sorted(passes[i])
        assert own == list(range(len(own))) and math.floor(repeats[s] + 1e-9) <= len(own) <= math.floor(repeats[s] + 1e-9) + 1 + (repeats[s] % 1 > 1 - 1e-4)
    assert len({(r.source, r.block) for r in got if r.source == "big"}) > 1
    again = mixing.mixed(df.repartition(7), target_entropy=target, max_repeats=limit).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mixture_of_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mixed(spark.createDataFrame([(1, None, "a"), (2, " ", "a")], schema)).count() == 0
    assert [r.id for r in mixing.mixed(spark.createDataFrame([(1, "a b", "a"), (2, None, "b")], schema)).collect()] == [1]
    twice = mixing.mixed(spark.createDataFrame([(1, "a b", "a"), (1, "a b", "a")], schema)).collect()
    assert len(twice) == 2


def test_mixture_of_more_than_its_repeats_give(spark):
    df = spark.createDataFrame([(1, "a b c", "a"), (2, "d", "b")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="budget"):
        mixing.mixed(df, budget=9.0, max_repeats=2.0)
    assert sorted((r.id, r["pass"]) for r in mixing.mixed(df, budget=8.0, max_repeats=2.0).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert mixing.mixed(df.limit(0), budget=9.0).count() == 0


def test_token_counts(spark):
    texts = [None, "", " ", "a", " a\tb\n\nc ", "é ü"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "id long, text string, source string")
    got = {r.id: r.tokens for r in mixing.token_counts(df).collect()}
    assert got == {i: len((t or "").split()) for i, t in enumerate(texts)}


def test_features_are_the_same_in_any_chunk():
    import pyarrow as pa

    texts = ["Some words, some more words", "", "### $$$", "ÄÖ é"]
    row, col, style = quality.features(pa.array(texts))
    for k, t in enumerate(texts):
        r, c, s = quality.features(pa.array([t]))
        np.testing.assert_array_equal(c, col[row == k])
        np.testing.assert_allclose(s[0], style[k])
