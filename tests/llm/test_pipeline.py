import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    """Each stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    state = {"documents": {r.doc_id: r for r in docs.collect()}}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            state[name] = {r.doc_id: r for r in docs.collect()}
        else:
            last = out.collect()
    kept, single, cut, clean = (state[n] for n in names[:4])

    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, r in labels.items() if r.quality == 1 and not r.toxic]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert not [i for i, r in labels.items() if r.toxic and i in kept]

    groups = brute.jaccard_components([(i, r.text) for i, r in kept.items()])
    assert set(single) == {i for i, _, c in groups if i == c}

    rows = {r[0]: r for r in brute.without_repeats([(i, r.text) for i, r in single.items()])}
    assert set(cut) == {i for i, r in rows.items() if r[1] > r[2]}
    for i, r in cut.items():
        assert len(r.text.split()) == rows[i][1] - rows[i][2] and r.n_chars == len(r.text)
        if not rows[i][2]:
            assert r.text == single[i].text

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {r[0] for r in brute.contamination([(i, r.text) for i, r in cut.items()], items) if r[5]}
    assert set(clean) == set(cut) - hits

    assert {r.doc_id for r in last} <= set(clean)
    assert all(r.text == clean[r.doc_id].text for r in last)


def test_run_gives_the_stages_rows(spark):
    assert corpus_pipeline.run(spark, SF).select("doc_id", "text", "pass").count() > 0


def _rows():
    """Repeated rows, null and blank texts, a null id, sources and languages, one very long text and a column with a clashing name."""
    own = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    rows = [(1, own(1), "en", "a"), (2, own(2), None, "b"), (2, own(2), None, "b"), (2, own(2), None, "b"), (3, None, "en", "a"), (4, "", "en", None), (5, " \n", "de", "b")]
    rows += [(None, own(6), "en", "a"), (7, " ".join(own(100 + i) for i in range(3000)), "de", None), (8, own(8), "fr", None), (8, own(8), "fr", None)]
    return [(*r, len(r[1] or ""), "k", 1.5) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, weight double"


def test_stages_on_repeated_and_odd_rows(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    count = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    columns = list(corpus_pipeline.COLUMNS)

    kept = stages["quality classifier"](spark, docs, SF)
    assert kept.columns == columns and not set(count(kept)) & {None, 3, 4, 5}
    single = stages["n-gram Jaccard join"](spark, docs, SF)
    assert single.columns == columns and count(single) == [1, 2, 2, 2, 3, 4, 5, 7, 8, 8]
    cut = stages["substring dedup"](spark, docs, SF)
    assert cut.columns == columns and count(cut) == [1, 2, 2, 2, 7, 8, 8]
    assert {(r.doc_id, r.lang, r.source, r.text) for r in cut.collect()} == {r[:1] + r[2:4] + r[1:2] for r in _rows() if r[0] and (r[1] or "").strip()}
    clean = stages["benchmark decontamination"](spark, docs, SF)
    assert clean.columns == columns and count(clean) == [1, 2, 2, 2, 3, 4, 5, 7, 8, 8]
    mix = stages["mixing sources to target weights"](spark, docs, SF).collect()
    assert {r.doc_id for r in mix} <= {1, 2, 7, 8}
    from skyroute.llm.mixing import mixed

    assert len(mix) == mixed(docs.where("doc_id is not null")).count()


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and out.columns[:5] == list(corpus_pipeline.COLUMNS)
