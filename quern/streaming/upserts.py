"""Structured Streaming: micro-batches upserted into a collection, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.collection import latest


BUCKETS = 64


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, *, id_col: str = "id", seq_col: str = "seq", buckets: int = BUCKETS):
    """Starts a query that keeps of each id the row of the largest ``seq_col``, stored rows included: a late,
    older row does not replace a newer one.

    Rows lie in ``data/batch_version=N/bucket=B`` by hash of the id.  A batch rewrites only the buckets it touches, and
    ``manifest/batch_version=N`` says which version each bucket has; a batch that is replayed writes the same
    version again.  ``read_upserts`` gives the table."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, id_col, seq_col).withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int"))
        new.persist()
        versions = _manifest(spark, path, number - 1)
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most ``buckets``
        old = _rows(spark, path, {b: v for b, v in versions.items() if b in touched})
        merged = new if old is None else new.unionByName(old.select(*new.columns))
        latest(merged, id_col, seq_col).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch_version={number}")
        versions |= dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(versions.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch_version={number}")
        new.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    if number < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/batch_version={number}").collect()}  # a row a bucket


def _rows(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame | None:
    if not versions:
        return None
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/batch_version={v}/bucket={b}" for b, v in versions.items()]).drop("batch_version")


def read_upserts(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The table after batch ``number``."""
    return _rows(spark, path, _manifest(spark, path, number)).drop("bucket")


def windowed_counts(stream: DataFrame, ts_col: str, key_col: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window start, key, n) with a watermark."""
    w = stream.withWatermark(ts_col, late).groupBy(F.window(ts_col, window).alias("w"), key_col).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), key_col, "n")


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
