import corpus_pipeline


def test_stages_compose(spark, tmp_path):
    rows = [(i, f"the cat number{i} and the dog with this house and that garden {i} over the river", "en", "ab"[i % 2], 60) for i in range(30)]
    rows += [(100, rows[3][1], "en", "b", 60), (101, None, "en", "a", None), (102, "", None, None, 0), (103, "12 34", "en", "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[0] == set(range(30)) | {100} == kept[1] and 100 not in kept[2]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out) and {r["doc_id"] for r in out} <= kept[2]
    empty = spark.createDataFrame([], df.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
