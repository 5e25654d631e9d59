"""Moving old collections: find them, write them as JSON lines, read such lines as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.schema import Field, Schema

KINDS = {
    T.StringType: "text", T.ByteType: "i64", T.ShortType: "i64", T.IntegerType: "i64", T.LongType: "i64", T.DecimalType: "u64", T.FloatType: "f64",
    T.DoubleType: "f64", T.BooleanType: "bool", T.TimestampType: "date", T.DateType: "date", T.BinaryType: "bytes",
}


def schema_of(name: str, table: DataFrame, id_col: str = "id") -> Schema:
    """A schema for a table without one: strings are texts, lists of floats vectors, other nested values json."""
    def kind(t: T.DataType) -> str:
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType)):
            return "vector"
        return KINDS.get(type(t), "json")

    return Schema(name, [Field(f.name, kind(f.dataType)) for f in table.schema if f.name != id_col])


def discover(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, Schema]:
    """The schemas of the tables in the folders of ``root``; a folder that holds no such table is passed over."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for entry in fs.listStatus(path):  # a folder a collection
        place = entry.getPath()
        if entry.isDirectory() and any(f.getPath().getName().endswith("." + fmt) for f in fs.listStatus(place)):
            out[place.getName()] = schema_of(place.getName(), spark.read.format(fmt).load(place.toString()))
    return dict(sorted(out.items()))


def export_jsonl(table: DataFrame, path: str) -> None:
    """One JSON object a line and document; null fields are left out."""
    table.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)


def import_jsonl(spark: SparkSession, path: str, schema: Schema, id_col: str = "id") -> DataFrame:
    """The documents of JSON lines in a schema; blank lines are passed over, a line that is no JSON object fails the
    job, and a document without an id gets an empty one."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.struct() if f.name not in ("id", id_col, "_indexed_at"))
    names = f"`{id_col}` string" + (f", {fields}" if fields else "")
    rows = spark.read.text(path).where("trim(value) != ''").select(F.from_json("value", names, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    return rows.withColumn(id_col, F.coalesce(F.col(id_col), F.lit("")))
