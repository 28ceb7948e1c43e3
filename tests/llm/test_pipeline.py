import corpus_pipeline
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tilewright.llm import language, quality


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = corpus_pipeline.filter_quality(spark, docs, sf_dir)
    want = {i for i, r in rows.items() if quality.Scorer(model)([r["text"]])[0, 1] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in good.collect()} == want and good.columns == docs.columns and 0 < len(want) < len(rows)

    known = corpus_pipeline.filter_language(spark, good, sf_dir)
    model = language.fit(good)
    want = {i for i in want if not language.classify(model, [rows[i]["text"]])[2][0]}
    assert {r["doc_id"] for r in known.collect()} == want and known.columns == docs.columns

    once = corpus_pipeline.deduplicate(spark, known, sf_dir)
    ids = sorted(want)
    want = set(slow_components([slow_fingerprint(rows[i]["text"]) for i in ids], ids))
    got = once.collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want) and once.columns == docs.columns
    assert all(r == rows[r["doc_id"]] for r in got)

    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == want


def test_one_document_of_each_group_stays(spark, sf_dir):
    docs = [(3, "a b c", 1), (2, "a b c", 2), (2, "a b c", 3), (None, "a b c", 4), (7, "x y z", 5), (7, "q r s", 6), (None, None, 7), (None, "", 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string, fp long")
    got = sorted(((r["doc_id"] or -1, r["text"] or "") for r in corpus_pipeline.deduplicate(spark, df, sf_dir).collect()))
    assert got == [(-1, ""), (2, "a b c"), (7, "q r s"), (7, "x y z")]
    assert corpus_pipeline.deduplicate(spark, df, sf_dir).columns == df.columns
    assert corpus_pipeline.deduplicate(spark, df.limit(0), sf_dir).count() == 0


def test_column_names_that_clash(spark, sf_dir):
    names = ["_id", "_hash", "_hash_of_text", "_nth", "_none", "_text", "_rest", "_row", "fp", "root", "first"]
    rows = [(i, "a b c" if i < 4 else f"x{i} y z q", "en", *(f"{n}{i}" for n in names)) for i in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" if n != "doc_id" else "doc_id long" for n in ["doc_id", "text", "lang", *names]))
    got = sorted(corpus_pipeline.deduplicate(spark, df, sf_dir).collect())
    assert [tuple(r) for r in got] == [rows[0], rows[4], rows[5]]


def test_repeated_rows_are_settled_by_the_other_columns(spark, sf_dir):
    df = spark.createDataFrame([(1, "a b c", x) for x in "cab"] * 50, "doc_id long, text string, source string").repartition(4)
    assert [tuple(r) for r in corpus_pipeline.deduplicate(spark, df, sf_dir).collect()] == [(1, "a b c", "a")]


def test_pipeline_over_empty_and_very_long_texts(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "good words of a text " * 40_000, "en", "s", 1), (2, "", "en", "s", 0), (3, None, None, None, None), (None, "more words", "en", "s", 1)]
    for name, some in (("full", rows), ("empty", [])):
        spark.createDataFrame(some, kind).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert 1 in {r["doc_id"] for r in got} and all(r["length"] <= 4096 for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
