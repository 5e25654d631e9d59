"""Documents of another search server, read in slices over its scroll interface, as a Spark data source.

Each slice is one partition with a scroll of its own; a task that is run again opens a new one.  A page
that fails ends the job: no document is left out in silence.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.plans.ast import QueryError
from quern.sources.schema import Schema

KEEP = "5m"


def call(url: str, method: str = "GET", body: dict | None = None, auth: str | None = None, timeout: float = 60.0) -> dict:
    """The JSON answer of the server; ``auth`` is ``user:password``.  A refused or missing index is a QueryError."""
    request = Request(url, method=method, data=None if body is None else json.dumps(body).encode(), headers={"Content-Type": "application/json"})
    if auth:
        request.add_header("Authorization", "Basic " + base64.b64encode(auth.encode()).decode())
    try:
        with urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return json.loads(answer.read() or b"{}")
    except HTTPError as e:
        if e.code in (401, 403):
            raise QueryError(f"access refused ({e.code}): {url}") from e
        if e.code == 404:
            raise QueryError(f"not found: {url}") from e
        raise


def fetch_schema(url: str, index: str, auth: str | None = None) -> Schema:
    """The schema of the first index that the name means."""
    found = call(f"{url}/{quote(index)}/_mapping", auth=auth)
    if not found:
        raise QueryError(f"no index {index}")
    name, mapping = next(iter(found.items()))
    return Schema.from_mapping(name, mapping.get("mappings", {}))


def count_documents(url: str, index: str, auth: str | None = None) -> int:
    return int(call(f"{url}/{quote(index)}/_count", auth=auth)["count"])


class Slice(InputPartition):
    def __init__(self, number: int):
        self.number = number


class ScrollReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.index, self.auth = options["url"].rstrip("/"), options["index"], options.get("auth")
        self.slices, self.batch = max(1, int(options.get("slices", 8))), int(options.get("batch", 1000))

    def partitions(self) -> list[Slice]:
        return [Slice(k) for k in range(self.slices)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        body: dict = {"query": {"match_all": {}}}
        if self.slices > 1:
            body["slice"] = {"id": partition.number, "max": self.slices}
        page = call(f"{self.url}/{quote(self.index)}/_search?scroll={KEEP}&size={self.batch}", "POST", body, self.auth)
        scroll = page.get("_scroll_id")
        try:
            while page["hits"]["hits"]:
                for hit in page["hits"]["hits"]:
                    yield hit["_id"], json.dumps(hit["_source"], ensure_ascii=False)
                if not scroll:
                    return
                page = call(f"{self.url}/_search/scroll", "POST", {"scroll": KEEP, "scroll_id": scroll}, self.auth)
                scroll = page.get("_scroll_id", scroll)
        finally:
            if scroll:
                try:
                    call(f"{self.url}/_search/scroll", "DELETE", {"scroll_id": scroll}, self.auth)
                except OSError:
                    pass  # the server drops it after KEEP


class ScrollSource(DataSource):
    """Options: url, index, slices, batch, auth.  Rows: id, source (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "quern_scroll"

    def schema(self) -> str:
        return "id string, source string"

    def reader(self, schema) -> ScrollReader:
        return ScrollReader(self.options)


def import_index(spark: SparkSession, url: str, index: str, *, slices: int = 8, batch: int = 1000, auth: str | None = None) -> DataFrame:
    """All documents of an index as a table in its schema; what does not fit a field's type is null."""
    schema = fetch_schema(url, index, auth)
    spark.dataSource.register(ScrollSource)
    reader = spark.read.format("quern_scroll").options(url=url, index=index, slices=slices, batch=batch)
    rows = (reader.option("auth", auth) if auth else reader).load()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.struct() if f.name not in ("id", "_indexed_at"))
    return rows.select("id", F.from_json("source", fields).alias("s")).select("id", "s.*") if fields else rows.select("id")
