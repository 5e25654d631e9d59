"""Collection schemas: declared fields, their Spark types, analyzers and settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SPARK_TYPES = {
    "text": T.StringType(), "string": T.StringType(), "i64": T.LongType(), "u64": T.DecimalType(20, 0), "f64": T.DoubleType(),
    "bool": T.BooleanType(), "date": T.TimestampType(), "bytes": T.BinaryType(), "vector": T.ArrayType(T.FloatType()), "json": T.StringType(),
}
#: Field types of another engine's mapping.
MAPPED = {
    "text": "text", "keyword": "string", "constant_keyword": "string", "wildcard": "string", "ip": "string", "long": "i64", "integer": "i64", "short": "i64", "byte": "i64",
    "unsigned_long": "u64", "double": "f64", "float": "f64", "half_float": "f64", "scaled_float": "f64", "boolean": "bool", "date": "date", "date_nanos": "date",
    "binary": "bytes", "dense_vector": "vector", "object": "json", "nested": "json", "flattened": "json",
}
FACET_TYPES = ("terms", "date_histogram", "range", "stats")


@dataclass
class Field:
    name: str
    type: str
    stored: bool = True
    indexed: bool = True
    analyzer: str = "default"


@dataclass
class Schema:
    name: str
    fields: list[Field]
    vector_field: str | None = None
    dimension: int = 0
    metric: str = "cosine"
    hybrid: dict = field(default_factory=lambda: {"strategy": "rrf", "rrf_k": 60, "text_weight": 0.5, "vector_weight": 0.5, "normalization": "max_norm"})
    boosting: dict = field(default_factory=dict)
    facets: dict = field(default_factory=dict)
    indexed_at: bool = True
    boost_field: bool = False
    k1: float = 1.2
    b: float = 0.75

    @classmethod
    def parse(cls, d: dict) -> Schema:
        """From a dict, as a YAML file gives it."""
        backends = d.get("backends", {})
        text, vector = backends.get("text") or {}, backends.get("vector") or {}
        fields = [Field(f["name"], f["type"], f.get("stored", True), f.get("indexed", True), f.get("tokenizer", f.get("analyzer", "default"))) for f in text.get("fields", [])]
        system = d.get("system_fields", {})
        out = cls(d.get("collection", d.get("name", "")), fields, vector.get("embedding_field"), int(vector.get("dimension", 0)), vector.get("distance", "cosine"), indexed_at=system.get("indexed_at", True), boost_field=system.get("document_boost", False))
        out.hybrid |= {k: v for k, v in (d.get("hybrid") or {}).items()}
        out.boosting = d.get("boosting") or {}
        out.facets = d.get("facets") or {}
        out.k1, out.b = float(text.get("bm25_k1") or 1.2), float(text.get("bm25_b") or 0.75)
        return out

    @classmethod
    def from_mapping(cls, name: str, mapping: dict) -> Schema:
        """From another engine's ``properties``; unknown types become json."""
        return cls(name, [Field(k, MAPPED.get(v.get("type", "object"), "json")) for k, v in mapping.get("properties", {}).items()])

    def lint(self) -> list[str]:
        """What is wrong with the schema, in words."""
        out = [f"unknown type {f.type} of {f.name}" for f in self.fields if f.type not in SPARK_TYPES]
        if self.vector_field is not None and self.dimension <= 0:
            out.append("the vector dimension must be positive")
        if self.dimension > 0 and not self.vector_field:
            out.append("the vector field has no name")
        for k in ("text_weight", "vector_weight"):
            if not 0 <= float(self.hybrid.get(k, 0.5)) <= 1:
                out.append(f"{k} is not in 0..1")
        for c in self.facets.get("configs", []):
            if c.get("type", "terms") not in FACET_TYPES:
                out.append(f"unknown facet type {c['type']} of {c['field']}")
        allowed = self.facets.get("allowed", [])
        out += [f"the default facet {x} is not allowed" for x in self.facets.get("default", []) if allowed and x not in allowed]
        if self.fields and not any(f.type == "text" for f in self.fields):
            out.append("no text field")
        return out

    def struct(self) -> T.StructType:
        out = T.StructType([T.StructField("id", T.StringType(), False)])
        for f in self.fields:
            if f.name != "id":
                out.add(f.name, SPARK_TYPES[f.type])
        if self.vector_field:
            out.add(self.vector_field, T.ArrayType(T.FloatType()))
        if self.indexed_at:
            out.add("_indexed_at", T.TimestampType())
        if self.boost_field:
            out.add("_boost", T.DoubleType())
        return out

    def text_fields(self) -> dict[str, str]:
        """Searched by default: indexed texts and keywords, and the id."""
        return {f.name: f.analyzer if f.type == "text" else "raw" for f in self.fields if f.type in ("text", "string") and f.indexed}

    def facet_specs(self, names: list[str] | None = None) -> dict[str, dict]:
        """What ``aggregations.facets`` takes: the named facets, or the schema's default ones, each as its field is configured."""
        known = {c["field"]: {k: v for k, v in c.items() if k != "field" and v is not None} for c in self.facets.get("configs", [])}
        return {n: known.get(n, {}) for n in (self.facets.get("default", []) if names is None else names)}
