"""The pipeline's stages on nothing, on repeated rows, on extra columns and on empty texts."""

import pytest

pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def labels(spark, path):
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_on_nothing(spark, tmp_path):
    import corpus_pipeline

    labels(spark, tmp_path)
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == 0


def test_stages_keep_columns_and_rows(spark, tmp_path):
    import corpus_pipeline

    labels(spark, tmp_path)
    texts = {100: None, 101: "", 102: "a b", 103: "one two three four five six " * 30, 104: "one two three four five six " * 30, 105: "password=abcdef12 " + "x" * 100}
    rows = [(i, t, "en", "s", len(t or ""), "m", 1.5, 7, 8, 9, 10) for i, t in texts.items() for _ in range(2)]
    docs = spark.createDataFrame(rows, SCHEMA + ", __score string, __secrets double, kept int, dbucket int, __ID int, Secrets int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in out.collect()) == [100, 101, 102, 103, 105]
    left = {r.doc_id: r for r in docs.collect()}
    assert left[100].text is None and left[101].text == "" and left[102].text == "a b"
    assert "[SECRET]" in left[105].text and left[105]["__score"] == "m" and left[105]["__secrets"] == 1.5 and left[102].kept == 7 and left[102].dbucket == 8 and left[102]["__ID"] == 9 and left[102].Secrets == 10


def test_stages_exchange_small_batches(spark, tmp_path, monkeypatch):
    """No Arrow batch of a stage holds many MB of text, no row is lost by that, and run sets the session back."""
    import corpus_pipeline
    from tracewell.llm import toxicity
    from tracewell.llm.common import ARROW_BATCH, ARROW_BYTES

    labels(spark, tmp_path)
    seen = spark.sparkContext.accumulator(0)
    most = spark.sparkContext.accumulator(0)

    def sized(docs, *_, out, **__):
        def batches(it):
            for b in it:
                seen.add(b.num_rows)
                most.add(b.nbytes > 2 * ARROW_BYTES)
                yield b

        return docs.mapInArrow(batches, docs.schema).selectExpr("*", f"0.1D AS `{out}`")

    monkeypatch.setattr(toxicity, "score", sized)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "concat(id, repeat(' x', 2000)) AS text", "'en' AS lang", "'s' AS source", "4000L AS n_chars")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 4000
    assert (seen.value, most.value) == (4000, 0)
    spark.conf.unset(ARROW_BATCH)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("toxicity", corpus_pipeline.drop_toxic)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4000 and ARROW_BATCH not in spark.conf.getAll
    spark.conf.set(ARROW_BATCH, "1m")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4000 and spark.conf.get(ARROW_BATCH) == "1m"
    spark.conf.unset(ARROW_BATCH)
