from datetime import datetime

from quern.streaming.upserts import read_stream, read_upserts, upsert_stream, windowed_counts


def test_stream_upserts_keep_the_last_row(spark, tmp_path):
    schema = "id string, seq long, v string"
    spark.createDataFrame([("1", 1, "a"), ("2", 2, "b"), ("1", 3, "c")], schema).write.parquet(str(tmp_path / "in"))
    run = lambda: upsert_stream(read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    run()
    spark.createDataFrame([("2", 4, "d"), ("3", 5, "e"), ("1", 2, "late")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "manifest").iterdir())
    assert last == 1
    assert sorted((r["id"], r["v"]) for r in read_upserts(spark, str(tmp_path / "out"), last).collect()) == [("1", "c"), ("2", "d"), ("3", "e")]


def test_windowed_counts(spark, tmp_path):
    schema = "ts timestamp, kind string"
    rows = [(datetime(2024, 1, 1, 0, m), "x") for m in (1, 2, 59)] + [(datetime(2024, 1, 1, 5, 0), "y")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = windowed_counts(read_stream(spark, str(tmp_path / "in"), schema), "ts", "kind").writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["kind"], r["n"]) for r in spark.table("counts").collect()) == [("x", 3), ("y", 1)]
