import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, n_tokens string, n_copies string, component_id string, mark string, _t string"


def odd_rows():
    long = " ".join(f"word{i % 977} of line{i % 13}" for i in range(6000))
    plain = "\n".join(f"the {w} river runs past the old mill and the quiet town near the hills" for w in ("green", "slow", "wide"))
    rest = (7, "a", "b", "c", "d", "e")
    return [(1, plain, "en", "s", *rest), (1, plain, "en", "s", *rest), (1, plain + " again", "en", "s", *rest), (2, plain, None, None, *rest), (3, None, "en", "s", *rest),
            (None, plain, "en", "s", *rest), (None, None, None, None, *rest), (4, "", "de", "s", *rest), ((1 << 60) + 1, long, "en", "t", *rest)]


def test_every_stage_takes_odd_rows_and_empty_tables(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, no rows: each stage keeps the columns and only drops whole rows."""
    d = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([r[:4] + r[4:] for r in odd_rows()], COLUMNS)
    ids = {r[0] for r in odd_rows()}
    for name, stage in corpus_pipeline.STAGES:
        for rows, most in ((docs, len(odd_rows())), (docs.limit(0), 0)):
            out = stage(spark, rows, d)
            assert set(out.columns) == set(docs.columns) if name == "mixing" else out.columns == docs.columns, name
            got = out.collect()
            assert len(got) <= most and {r.doc_id for r in got} <= ids, name
            if most and name == "line_dedup":
                assert len(got) == most and sum(r.text is None for r in got) == 2
            if most and name == "ngram_jaccard_join":
                kept = sorted((str(r.doc_id), r.text) for r in got if r.text and r.text.startswith("the green"))
                assert [i for i, _ in kept] == ["1", "1", "1", "None"]  # every text of the first doc_id; rows without an id link with nothing


#: Names that operators use for columns of their own.
CLASHING = ["_t", "_domain", "_lang", "_source", "_key", "_copies", "_mark", "_rest", "_full", "_piece", "_last", "_before", "_bound", "_sum", "_start", "_stretch",
            "_id", "_n", "_kept", "_gone", "_less", "row", "kept", "gone", "n", "less", "id", "of", "mark", "pos", "line", "h1", "h2", "half", "key", "at", "node", "label",
            "component", "_gone_id", "_gone_mark", "contaminated", "n_words", "n_hit", "score", "predicted", "held_out", "quality", "item_id", "w", "place", "s", "a", "b", "x"]


def test_columns_of_any_name_keep_their_values(spark):
    """Extra columns called like an operator's own come back from every stage as they were."""
    text = " ".join(f"w{i % 61} of{i % 7}" for i in range(200))
    rows = [(i, f"{text} {i}\nline {i} of its own and long enough", "en", "s", 3, *(f"{c}-{i}" for c in CLASHING)) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "/root/testdata/sf0.001").collect()
        assert all(r[c] == f"{c}-{r.doc_id}" for r in got for c in CLASHING), name
        assert got or name == "quality_classifier", name
