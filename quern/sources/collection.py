"""Collections as tables: upsert, delete, get, statistics, bulk lines, export and import."""

from __future__ import annotations

import json
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.ast import QueryError
from quern.sources.schema import Schema

MOST_BULK_ACTIONS = 10_000


def latest(new: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """One row an id: that of the largest ``seq_col``.  A partial maximum runs before the shuffle."""
    rest = [c for c in new.columns if c != id_col]
    last = F.max_by(F.struct(*rest), F.col(seq_col)).alias("r")
    return new.groupBy(id_col).agg(last).select(id_col, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """The table after the writes: the last write of an id wins."""
    fresh = latest(new, id_col, seq_col)
    return old.join(fresh.select(id_col), id_col, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def delete(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return table.join(ids.select(id_col), id_col, "left_anti").select(*table.columns)


def delete_where(table: DataFrame, matched: DataFrame, id_col: str = "id", most: int | None = None, dry_run: bool = False) -> DataFrame:
    """Without all matched rows, or the first ``most`` of them by id; a dry run changes nothing."""
    if dry_run:
        return table
    return delete(table, matched.select(id_col).orderBy(id_col).limit(most) if most is not None else matched.select(id_col), id_col)


def get(table: DataFrame, doc_id, id_col: str = "id") -> DataFrame:
    return table.where(F.col(id_col) == doc_id)


def stats(table: DataFrame) -> DataFrame:
    """One row: documents and the bytes of the table's files (of what Spark expects, without files)."""
    files = table.inputFiles()
    spark = table.sparkSession
    size = 0
    for f in files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        size += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return table.agg(F.count(F.lit(1)).alias("documents")).withColumn("bytes", F.lit(size).cast("long"))


def coerce(rows: DataFrame, schema: Schema) -> DataFrame:
    """String columns as the schema's types; a value that does not fit is null, not an error.

    Dates are RFC 3339 texts or integers of microseconds.  Unsigned numbers are not negative."""
    out = [F.col("id").cast("string").alias("id")]
    for f in schema.fields:
        if f.name == "id":
            continue
        c: Column = F.col(f"`{f.name}`").cast("string") if f.name in rows.columns else F.lit(None).cast("string")
        if f.type == "date":
            c = F.coalesce(F.timestamp_micros(c.try_cast("bigint")), c.try_cast("timestamp"))
        elif f.type == "u64":
            c = F.when(c.try_cast("decimal(20,0)") >= 0, c.try_cast("decimal(20,0)"))
        elif f.type == "bytes":
            c = F.try_to_binary(c, F.lit("base64"))
        elif f.type in ("i64", "f64", "bool"):
            c = c.try_cast({"i64": "bigint", "f64": "double", "bool": "boolean"}[f.type])
        out.append(c.alias(f.name))
    if schema.vector_field and schema.vector_field in rows.columns:
        v = F.col(schema.vector_field).cast("array<float>")
        out.append(F.when(v.isNull() | (F.size(v) == schema.dimension), v).otherwise(F.raise_error(F.lit("the vector has another dimension"))).alias(schema.vector_field))
    return rows.select(*out)


def bulk(lines: DataFrame, request_col: str | None = None) -> DataFrame:
    """(seq, op, index, id, source, error) of NDJSON lines (``value``, ``line`` in order): an action line and,
    but for a delete, a document line.  A missing id gets a name from the line's number.

    Lines are paired within a request, which holds at most MOST_BULK_ACTIONS actions; all actions of a
    longer one are errors.  ``request_col`` names the request of each line (a file, say); without
    it all lines are one request."""
    request = F.lit(0) if request_col is None else F.col(request_col)
    own = Window.partitionBy("__request")
    order = own.orderBy("line")
    rows = lines.withColumn("__request", request).where(F.trim("value") != "").withColumn("after", F.lead("value").over(order)).withColumn("kind", F.regexp_extract("value", r'^\s*\{\s*"(index|create|delete|update)"\s*:\s*\{', 1))
    # a document may look like an action: an action's document is the line after it
    rows = rows.withColumn("was", F.lag("kind").over(order))
    rows = rows.where((F.col("kind") != "") & ~F.coalesce(F.col("was").isin("index", "create", "update"), F.lit(False)))
    field = lambda name: F.expr(f"get_json_object(value, concat('$.', kind, '.{name}'))")
    index = field("_index")
    error = (
        F.when(F.count(F.lit(1)).over(own) > MOST_BULK_ACTIONS, "too many actions").when(index.contains("*") | index.contains("?"), "wildcard index")
        .when((F.col("kind") != "delete") & (F.col("after").isNull() | F.expr("try_parse_json(after)").isNull()), "no document").when((F.col("kind") == "delete") & field("_id").isNull(), "no id")
    )
    return rows.select(F.col("line").alias("seq"), F.col("kind").alias("op"), index.alias("index"), F.coalesce(field("_id"), F.concat(F.lit("auto-"), F.col("line").cast("string"))).alias("id"), F.when(F.col("kind") != "delete", F.col("after")).alias("source"), error.alias("error"))


def export_lines(table: DataFrame, schema: dict, id_col: str = "id") -> DataFrame:
    """JSON lines (``value``): a header with the schema, the count and the check value, then the documents."""
    spark = table.sparkSession
    body = table.select(F.lit(1).alias("o"), F.to_json(F.struct(F.col(id_col).alias("id"), F.struct(*[c for c in table.columns if c != id_col]).alias("fields")), {"ignoreNullFields": "false"}).alias("value"))
    row = body.agg(F.count(F.lit(1)).alias("n"), checksum().alias("sum")).first()
    header = spark.createDataFrame([(0, json.dumps({"format": "quern-portable", "version": 1, "documents": row["n"], "checksum": row["sum"], "schema": schema}))], "o int, value string")
    return header.unionAll(body)


def checksum() -> Column:
    """Order-free check value of lines (``value``): their number and the XOR of their 64-bit hashes."""
    return F.concat_ws("-", F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("value")), F.lit(0)))


def import_lines(lines: DataFrame, fields: str, verify: bool = True) -> DataFrame:
    """The documents of exported lines; ``fields``: a DDL of the columns beside the id.  Lines that lack the header
    or differ from its check value are an error."""
    head = F.col("value").startswith('{"format"')
    documents = lines.where(~head)
    if verify:
        first = lines.where(head).select("value").first()
        header = json.loads(first["value"]) if first else {}
        if header.get("format") != "quern-portable" or header.get("version") != 1:
            raise QueryError("no header of an export")
        if header.get("checksum") not in (None, documents.agg(checksum().alias("sum")).first()["sum"]):
            raise QueryError("the lines differ from what was exported")
    return documents.select(F.from_json("value", f"id string, fields struct<{fields}>").alias("d")).select("d.id", "d.fields.*")


def encrypt(lines: DataFrame, key: bytes) -> DataFrame:
    """Each line under AES-GCM, in base64.  The key has 16, 24 or 32 bytes."""
    return lines.withColumn("value", F.base64(F.aes_encrypt(F.col("value").cast("binary"), F.lit(key), F.lit("GCM"))))


def decrypt(lines: DataFrame, key: bytes) -> DataFrame:
    return lines.withColumn("value", F.aes_decrypt(F.unbase64("value"), F.lit(key), F.lit("GCM")).cast("string"))


def snapshot(table: DataFrame, path: str) -> None:
    """A copy of the table's rows in parquet, compressed with zstd."""
    table.write.option("compression", "zstd").parquet(path)


def restore(spark: SparkSession, path: str, to: str) -> DataFrame:
    """A snapshot's rows as a table at ``to``."""
    spark.read.parquet(path).write.mode("errorifexists").parquet(to)
    return spark.read.parquet(to)


def files_of(table: DataFrame) -> DataFrame:
    """(file, documents, bytes) of a table's files."""
    return table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("documents"), F.first("_metadata.file_size").alias("bytes"))


def optimize(table: DataFrame, path: str, most: int = 1) -> DataFrame:
    """The table merged into one file for each 512 MB if it has more than ``most`` files, else as it is."""
    if len(table.inputFiles()) <= most:
        return table
    size = stats(table).first()["bytes"]
    table.repartition(max(1, -(-size // (512 << 20)))).write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def detach(spark: SparkSession, path: str, to: str, backup: str | None = None) -> None:
    """Moves a collection's folder away, after a snapshot at ``backup`` if one is named; ``attach`` moves it back.
    An empty collection is refused."""
    table = spark.read.parquet(path)
    if table.isEmpty():
        raise QueryError("an empty collection is not detached")
    if backup:
        snapshot(table, backup)
    _move(spark, path, to)


def attach(spark: SparkSession, path: str, to: str) -> DataFrame:
    _move(spark, path, to)
    return spark.read.parquet(to)


def _move(spark: SparkSession, path: str, to: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p(to).getParent())
    if not fs.rename(p(path), p(to)):
        raise OSError(f"cannot move {path} to {to}")


def expand(names: list[str], pattern: str) -> list[str]:
    """Collection names that a pattern with * and ? means, or the name itself."""
    return sorted(n for n in names if fnmatchcase(n, pattern)) if "*" in pattern or "?" in pattern else [n for n in names if n == pattern]
