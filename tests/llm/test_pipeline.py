import corpus_pipeline
from ledgerloom.llm import quality
from tests.llm import test_decontaminate, test_line_dedup, test_mixing, test_ngram_join


def test_stages_equal_brute_force(spark, sf_dir):
    """Each stage on its own input: the classifier against its own scores, the others against plain Python."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    good = stages[0](spark, docs, sf_dir).cache()
    scores = {r.doc_id: r.predicted for r in quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert set(rows(good)) == {i for i, p in scores.items() if p == 1} and good.columns == docs.columns

    lines = stages[1](spark, good, sf_dir).cache()
    want = test_line_dedup.brute([(i, r.text) for i, r in rows(good).items()])
    assert {i: r.text for i, r in rows(lines).items()} == {i: w[2] for i, w in want.items()} and lines.columns == docs.columns

    firsts = stages[2](spark, lines, sf_dir).cache()
    want = test_ngram_join.brute([(i, r.text) for i, r in rows(lines).items()])
    assert set(rows(firsts)) == {i for i, (_, c) in want.items() if c == i} and firsts.columns == docs.columns

    clean = stages[3](spark, firsts, sf_dir).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # brute force only where a first word window could be; the SQL of op1 covers the rest of the table
    some = [(i, r.text, 0) for i, r in rows(firsts).items()][::5]
    bad = {x[0] for x in test_decontaminate.brute(some, items) if x[-1]}
    assert {i for i, *_ in some} - set(rows(clean)) == bad and clean.columns == docs.columns

    mixed = stages[4](spark, clean, sf_dir)
    want = test_mixing.brute([(r.doc_id, r.text, r.lang, r.source) for r in rows(clean).values()])
    assert sorted((r.doc_id, r.n_tokens, r.n_copies) for r in mixed.collect()) == sorted((x[0], x[4], x[5]) for x in want)
    assert mixed.columns == [*docs.columns, "n_tokens", "n_copies"]


def test_run_equals_its_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, d)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == sorted(r.doc_id for r in docs.collect())
