"""Ingest pipelines: processors in order; the first that fails rejects a document.

A pipeline turns a table into columns and an ``_error`` column (null where all went well), so good and
bad documents part by a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import html_strip


def _need_string(df: DataFrame, name: str, what: str) -> Column:
    if name not in df.columns or dict(df.dtypes)[name] != "string":
        return F.lit(f"{what}: {name} is missing or no string")
    return F.when(F.col(f"`{name}`").isNull(), F.lit(f"{what}: {name} is missing or no string"))


def run(df: DataFrame, processors: list[dict], now: Column | None = None) -> DataFrame:
    """``df`` after the processors, with ``_error``.  now: the time of {{_now}}."""
    if "_error" not in df.columns:
        df = df.withColumn("_error", F.lit(None).cast("string"))
    for p in processors:
        kind, arg = next(iter(p.items()))
        if kind in ("lowercase", "html_strip"):
            name = arg["field"]
            df = df.withColumn("_error", F.coalesce("_error", _need_string(df, name, kind)))
            if name in df.columns:
                change = F.lower if kind == "lowercase" else html_strip
                df = df.withColumn(name, F.when(F.col("_error").isNull(), change(F.col(name).cast("string"))).otherwise(F.col(name).cast("string")))
        elif kind == "set":
            value = F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if arg["value"] == "{{_now}}" else F.lit(arg["value"])
            df = df.withColumn(arg["field"], value)
        elif kind == "remove":
            df = df.drop(arg["field"])
        elif kind == "rename":
            source, to = arg.get("from", arg.get("field")), arg.get("to", arg.get("target_field"))
            if source not in df.columns:
                df = df.withColumn("_error", F.coalesce("_error", F.lit(f"rename: {source} is missing")))
                continue
            missing = F.when(F.col(source).isNull(), F.lit(f"rename: {source} is missing"))
            df = df.withColumn("_error", F.coalesce("_error", missing))
            df = (df.drop(to) if to in df.columns and to != source else df).withColumnRenamed(source, to)
        else:
            raise ValueError(f"unknown processor: {kind}")
    return df


class Registry:
    """Pipelines by name."""

    def __init__(self, pipelines: dict[str, list[dict]] | None = None):
        self.pipelines = dict(pipelines or {})

    def names(self) -> list[str]:
        return sorted(self.pipelines)

    def get(self, name: str) -> list[dict]:
        if name not in self.pipelines:
            raise KeyError(f"no such pipeline: {name}")
        return self.pipelines[name]
