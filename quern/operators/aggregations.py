"""Metric and bucket aggregations over a matched table.

A spec is a dict with ``type``, its settings and, for buckets, nested ``aggs``.  Metrics nested
in a bucket are columns beside ``doc_count`` of the same groupBy; nested buckets are tables of
their own whose rows carry the keys of the buckets around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.ast import QueryError
from quern.plans.search import Collection, Compiler

METRICS = frozenset(("count", "value_count", "sum", "avg", "min", "max", "stats", "percentiles", "cardinality"))
DEFAULT_PERCENTS = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)
CALENDAR = ("hour", "day", "week", "month", "year")
_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "Zulu", "+00:00")
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _number(df: DataFrame, name: str) -> Column:
    """The field as a number; strings, booleans and dates have none."""
    kinds = dict(df.dtypes)
    if name not in kinds:
        raise QueryError(f"unknown field: {name}")
    return F.col(f"`{name}`").cast("double") if kinds[name] in _NUMERIC or kinds[name].startswith("decimal") else F.lit(None).cast("double")


def percent_name(p: float) -> str:
    return f"{p:g}"


def metric(df: DataFrame, name: str, spec: dict) -> list[Column]:
    """Columns of one metric.  Sums, means and extremes of nothing are 0; of stats only the sum is, the
    others are null."""
    kind = spec["type"]
    if kind == "count":
        return [F.count(F.lit(1)).alias(name)]
    if kind == "value_count":
        return [F.count(F.col(spec["field"])).alias(name)]
    if kind == "cardinality":
        return [F.count_distinct(F.col(spec["field"])).alias(name)]
    x = _number(df, spec["field"])
    if kind == "stats":
        parts = {"count": F.count(x), "min": F.min(x), "max": F.max(x), "sum": F.coalesce(F.sum(x), F.lit(0.0)), "avg": F.avg(x)}
        return [c.alias(f"{name}_{k}") for k, c in parts.items()]
    if kind == "percentiles" and spec.get("accuracy"):  # a sketch of bounded size
        return [F.percentile_approx(x, p / 100, spec["accuracy"]).alias(f"{name}_{percent_name(p)}") for p in spec.get("percents", DEFAULT_PERCENTS)]
    if kind == "percentiles":
        return [F.percentile(x, p / 100).alias(f"{name}_{percent_name(p)}") for p in spec.get("percents", DEFAULT_PERCENTS)]
    return [F.coalesce(getattr(F, kind)(x), F.lit(0.0)).alias(name)]


def key_text(key) -> str:
    """A bucket's key as text: whole numbers without a point, booleans and dates as JSON has them."""
    if isinstance(key, bool):
        return str(key).lower()
    if isinstance(key, float):
        return str(int(key)) if key.is_integer() and abs(key) < 1e15 else repr(key)
    return key.isoformat() if hasattr(key, "isoformat") else str(key)


def _range_keys(spec: dict) -> list[str]:
    """The keys in order; every range has its own, even if two are written alike."""
    text = lambda v: "*" if v is None else key_text(v)
    out: list[str] = []
    for r in spec["ranges"]:
        key = r.get("key") or f"{text(r.get('from'))}-{text(r.get('to'))}"
        out.append(key if key not in out else f"{key}#{len(out)}")
    return out


def utc_trunc(df: DataFrame, unit: str, x: Column) -> Column:
    """The start of the UTC hour, day, week, ... whatever the session's zone is."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone in _UTC:
        return F.date_trunc(unit, x)
    return F.from_utc_timestamp(F.date_trunc(unit, F.to_utc_timestamp(x, zone)), zone)


class Aggregator:
    def __init__(self, c: Collection):
        self.c = c

    def run(self, matched: DataFrame, specs: dict[str, dict]) -> dict[str, DataFrame]:
        """A table for each aggregation; nested buckets under "outer>inner"."""
        out: dict[str, DataFrame] = {}
        metrics = {n: s for n, s in specs.items() if s["type"] in METRICS}
        if metrics:
            row = matched.agg(*[c for n, s in metrics.items() for c in metric(matched, n, s)])
            for n, s in metrics.items():
                out[n] = row.select(*[x for x in row.columns if x == n or x.startswith(f"{n}_")])
        for n, s in specs.items():
            if s["type"] not in METRICS:
                self._bucket(matched, n, n, s, {}, out)
        return out

    def _bucket(self, rows: DataFrame, path: str, name: str, spec: dict, parents: dict[str, str], out: dict[str, DataFrame]) -> None:
        """parents: the columns of the buckets around this one, with their names."""
        nested = spec.get("aggs", {})
        metrics = [c for n, s in nested.items() if s["type"] in METRICS for c in metric(rows, n, s)]
        key = f"__bucket{len(parents)}"  # no column of the data has this name
        keyed = self._keyed(rows, spec, key)
        table = keyed.where(F.col(key).isNotNull()).groupBy(*parents, key).agg(F.count(F.lit(1)).alias("doc_count"), *metrics)
        table = self._shape(table, keyed, spec, key, list(parents), metrics)
        shown = {**parents, key: name if parents else "key"}
        out[path] = table.select(*[F.col(x).alias(shown.get(x, x)) for x in table.columns])
        inner = {n: s for n, s in nested.items() if s["type"] not in METRICS}
        if inner:
            if spec["type"] == "terms":  # only the buckets that were kept have children
                keyed = keyed.join(table.select(*parents, key), [*parents, key], "left_semi")
            for n, s in inner.items():
                self._bucket(keyed.where(F.col(key).isNotNull()), f"{path}>{n}", n, s, {**parents, key: name}, out)

    def _keyed(self, rows: DataFrame, spec: dict, key: str) -> DataFrame:
        """Rows with their bucket key; rows of several buckets come several times."""
        kind = spec["type"]
        if kind == "global" and key != "__bucket0":
            raise QueryError("a global aggregation stands at the top")
        if kind == "global":
            return self.c.df.withColumn(key, F.lit("global"))
        if kind in ("filter", "filters"):
            queries = {"filter": spec["query"]} if kind == "filter" else spec["queries"]
            compiler = Compiler(self.c)
            used = set().union(*[compiler.used(q) for q in queries.values()])
            df = compiler.with_tokens(rows, used)
            hits = [F.when(compiler.compile(q, _NoNumbers())[0], F.lit(k)) for k, q in queries.items()]
            return df.withColumn(key, F.explode(F.array_compact(F.array(*hits)))).drop("__t")
        if kind in ("range", "date_range"):
            x = _number(rows, spec["field"]) if kind == "range" else F.col(f"`{spec['field']}`").cast("timestamp")
            bound = (lambda v: F.lit(float(v))) if kind == "range" else (lambda v: F.lit(v).cast("timestamp"))
            hits = []
            for r, name in zip(spec["ranges"], _range_keys(spec)):
                inside = x.isNotNull()
                inside = inside & (x >= bound(r["from"])) if r.get("from") is not None else inside
                inside = inside & (x < bound(r["to"])) if r.get("to") is not None else inside
                hits.append(F.when(inside, F.lit(name)))
            return rows.withColumn(key, F.explode(F.array_compact(F.array(*hits))))
        if kind == "histogram":
            return rows.withColumn(key, F.floor(_number(rows, spec["field"]) / F.lit(float(spec["interval"]))) * F.lit(float(spec["interval"])))
        if kind == "date_histogram":
            unit = spec.get("interval", "day") if spec.get("interval") in CALENDAR else "day"
            x = F.col(spec["field"])
            x = F.timestamp_micros(x) if dict(rows.dtypes)[spec["field"]] in ("bigint", "int") else x
            return rows.withColumn(key, utc_trunc(rows, unit, x))
        if kind == "terms":
            x = self.c.column(spec["field"])
            return rows.withColumn(key, x if spec.get("missing") is None else F.coalesce(x, F.lit(spec["missing"])))
        raise QueryError(f"unknown aggregation: {kind}")

    def _shape(self, table: DataFrame, keyed: DataFrame, spec: dict, key: str, parents: list[str], metrics: list[Column]) -> DataFrame:
        kind = spec["type"]
        if kind == "terms":
            size = int(spec.get("size", 10))
            if least := int(spec.get("min_doc_count", 0)):
                table = table.where(F.col("doc_count") >= least)
            (by, way), = (spec.get("order") or {"_count": "desc"}).items()
            by = {"_count": "doc_count", "_key": key}.get(by, by)
            order = [F.desc(by) if way == "desc" else F.asc(by), F.col(key)]
            if not parents:
                return table.orderBy(*order).limit(size)
            return table.withColumn("__r", F.row_number().over(Window.partitionBy(*parents).orderBy(*order))).where(F.col("__r") <= size).drop("__r")
        if kind == "histogram":
            if bounds := spec.get("extended_bounds"):
                step = float(spec["interval"])
                low, high = int(bounds["min"] // step), int(bounds["max"] // step)
                table = self._filled(table, keyed, F.sequence(F.lit(low), F.lit(high)), lambda k: k * F.lit(step), key, parents, "full")
            if least := int(spec.get("min_doc_count", 0)):
                table = table.where(F.col("doc_count") >= least)
        if kind in ("range", "date_range", "filter", "filters", "global"):  # named buckets are there even if empty
            names = _range_keys(spec) if kind.endswith("range") else list(spec["queries"]) if kind == "filters" else [kind]
            places = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
            table = self._filled(table, keyed, F.array(*map(F.lit, names)), lambda k: k, key, parents, "left")
            table = table.orderBy(*parents, places[F.col(key)])
        return table

    def _filled(self, table: DataFrame, keyed: DataFrame, keys: Column, value, key: str, parents: list[str], how: str) -> DataFrame:
        """``table`` with the buckets that have no rows, within each bucket around them."""
        around = keyed.select(*parents).distinct() if parents else self.c.df.sparkSession.range(1).select()
        frame = around.select(*parents, F.explode(keys).alias("__k")).select(*parents, value(F.col("__k")).alias(key))
        return frame.join(table, [*parents, key], how).withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))


class _NoNumbers(dict):
    """Corpus numbers where scores are not needed."""

    def __getitem__(self, key):
        return _Any()


class _Any:
    def __getitem__(self, key):
        return 1.0

    def __float__(self):
        return 1.0


def aggregate(c: Collection, matched: DataFrame, specs: dict[str, dict]) -> dict[str, DataFrame]:
    """Tables of the aggregations over all matched rows."""
    return Aggregator(c).run(matched, specs)


def facets(c: Collection, page: DataFrame, wanted: dict[str, dict], allowed: list[str] | None = None) -> dict[str, DataFrame]:
    """Aggregations over a page of results by field: terms (the default), date_histogram, range or stats.
    With ``allowed`` other fields are an error."""
    specs = {}
    for name, how in wanted.items():
        if allowed is not None and name not in allowed:
            raise QueryError(f"no facet: {name}")
        specs[name] = {"type": "terms", "field": name, "size": 10} | how
    return Aggregator(Collection(page, c.id_col, {c.id_col: "raw"})).run(page, specs)


# Constructors of specs.


def count() -> dict:
    return {"type": "count"}


def _metric(kind: str):
    return lambda field, **how: {"type": kind, "field": field, **how}


sum_, avg, min_, max_, stats, percentiles, cardinality, value_count = map(_metric, ("sum", "avg", "min", "max", "stats", "percentiles", "cardinality", "value_count"))


def _bucket(kind: str):
    return lambda field, aggs=None, **how: {"type": kind, "field": field, **how, **({"aggs": aggs} if aggs else {})}


terms, histogram, date_histogram, range_, date_range = map(_bucket, ("terms", "histogram", "date_histogram", "range", "date_range"))


def filter_(query, aggs=None) -> dict:
    return {"type": "filter", "query": query, **({"aggs": aggs} if aggs else {})}


def filters(queries: dict, aggs=None) -> dict:
    return {"type": "filters", "queries": queries, **({"aggs": aggs} if aggs else {})}


def global_(aggs=None) -> dict:
    return {"type": "global", **({"aggs": aggs} if aggs else {})}
