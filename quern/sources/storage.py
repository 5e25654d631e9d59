"""The folder that driver and executors share, for tables that operators write."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if the cluster names one, else, on a single machine, a folder of this process."""
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _OWN
    if _OWN is None:
        _OWN = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, _OWN, ignore_errors=True)
    return "file://" + _OWN


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own: cuts lineage, and a lost executor costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
