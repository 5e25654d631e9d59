"""Aliases, index templates and lifecycle rules: small driver-side state and pure functions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = ("hot", "warm", "cold", "frozen", "delete")


@dataclass
class Catalog:
    """Collections by name and aliases by name (each a list of collections, and one that takes writes)."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    aliases: dict[str, list[str]] = field(default_factory=dict)
    write: dict[str, str] = field(default_factory=dict)
    readonly: set[str] = field(default_factory=set)
    phases: dict[str, str] = field(default_factory=dict)

    def resolve(self, name: str) -> list[str]:
        return self.aliases.get(name, [name])

    def read(self, name: str) -> DataFrame:
        """All targets of a name as one table."""
        targets = [self.tables[t] for t in self.resolve(name)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), targets)

    def update(self, add: list[tuple[str, str]] = (), remove: list[tuple[str, str]] = ()) -> None:
        """Removes, then adds (alias, collection) pairs: all or none."""
        new = {k: list(v) for k, v in self.aliases.items()}
        for alias, target in remove:
            if target not in new.get(alias, []):
                raise KeyError(f"{alias} has no target {target}")
            new[alias].remove(target)
        for alias, target in add:
            if target not in self.tables:
                raise KeyError(f"no such collection: {target}")
            if target not in new.setdefault(alias, []):
                new[alias].append(target)
        self.aliases = {k: v for k, v in new.items() if v}

    def transition(self, name: str, policy: dict[str, float], age: float, optimize=None) -> str | None:
        """Moves a collection to the next phase of its policy.  What has left hot is read-only; warm and later
        ones are merged by ``optimize``(table), if given; delete only marks."""
        phase = next_phase(policy, self.phases.get(name, "hot"), age)
        return phase and self.force_phase(name, phase, optimize)

    def force_phase(self, name: str, phase: str, optimize=None) -> str:
        if phase not in PHASES or name not in self.tables:
            raise KeyError(f"no such phase or collection: {phase}, {name}")
        self.phases[name] = phase
        if phase != "hot":
            self.readonly.add(name)
        if optimize is not None and phase in ("warm", "cold", "frozen"):
            self.tables[name] = optimize(self.tables[name])
        return phase

    def run_deletions(self) -> list[str]:
        """Drops the collections marked for deletion from the catalog and from all aliases."""
        gone = [n for n, p in self.phases.items() if p == "delete" and n in self.tables]
        for name in gone:
            del self.tables[name], self.phases[name]
            self.readonly.discard(name)
            self.aliases = {k: left for k, v in self.aliases.items() if (left := [t for t in v if t != name])}
            self.write = {k: v for k, v in self.write.items() if v != name}
        return gone

    def rollover(self, alias: str, day: str) -> str:
        """A new, empty write target with the schema of the last; the last becomes read-only."""
        old = self.write.get(alias) or self.resolve(alias)[-1]
        name = rollover_name(old, day)
        self.tables[name] = self.tables[old].limit(0)
        self.aliases.setdefault(alias, [old]).append(name)
        self.write[alias] = name
        self.readonly.add(old)
        return name


def rollover_name(old: str, day: str) -> str:
    """base-YYYY.MM.DD-NNNNNN after ``old``; ``day`` is YYYY.MM.DD."""
    m = re.fullmatch(r"(.*?)-\d{4}\.\d\d\.\d\d-(\d{6})", old)
    base, n = (m[1], int(m[2]) + 1) if m else (old, 1)
    return f"{base}-{day}-{n:06d}"


def rollover_reasons(conditions: dict, *, size: float, documents: int, age: float) -> list[str]:
    """Which of max_size, max_docs and max_age are met; any one is enough."""
    have = {"max_size": size, "max_docs": documents, "max_age": age}
    return [k for k, v in have.items() if conditions.get(k) is not None and v >= conditions[k]]


def next_phase(policy: dict[str, float], current: str, age: float) -> str | None:
    """The first later phase of a policy (phase -> least age) whose age is reached."""
    for phase in PHASES[PHASES.index(current) + 1 :]:
        if phase in policy and age >= policy[phase]:
            return phase
    return None


def phase_column(policy: dict[str, float], current: Column, age: Column) -> Column:
    """``next_phase`` for a table of collections; null where none is reached."""
    out = F.lit(None).cast("string")
    for now in PHASES:
        later = F.lit(None).cast("string")
        for phase in reversed(PHASES[PHASES.index(now) + 1 :]):
            later = F.when(age >= policy[phase], phase).otherwise(later) if phase in policy else later
        out = F.when(current == now, later).otherwise(out)
    return out


def reasons_column(conditions: dict, *, size: Column, documents: Column, age: Column) -> Column:
    """``rollover_reasons`` for a table of collections."""
    have = {"max_size": size, "max_docs": documents, "max_age": age}
    met = [F.when(c >= conditions[k], k) for k, c in have.items() if conditions.get(k) is not None]
    return F.array_compact(F.array(*met)) if met else F.array().cast("array<string>")


def glob(pattern: str, name: str) -> bool:
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), name) is not None


def template_for(templates: list[dict], name: str) -> dict | None:
    """The matching template of the highest priority; of equal ones the first by name."""
    hits = [t for t in templates if any(glob(p, name) for p in t["patterns"])]
    return min(hits, key=lambda t: (-t.get("priority", 0), t.get("name", "")), default=None)


def apply_template(schema: dict, template: dict) -> dict:
    """A schema with the template's fields that it lacks."""
    have = {f["name"] for f in schema.get("fields", [])}
    return schema | {"fields": [*schema.get("fields", []), *[f for f in template.get("fields", []) if f["name"] not in have]]}


NAME = re.compile(r"[a-z0-9][a-z0-9._-]{0,254}")


def check_name(name: str) -> str:
    """A collection's name: lower-case letters, digits, ``.``, ``_`` and ``-``, beginning with a letter or digit."""
    if not NAME.fullmatch(name) or ".." in name:
        raise ValueError(f"not a collection name: {name!r}")
    return name


def audit(events: DataFrame) -> DataFrame:
    """Security events (ts, user, action, collection, allowed) as documents of an audit collection."""
    key = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("ts", "user", "action", "collection", "allowed")]), 256)
    return events.select(key.alias("id"), F.col("ts").alias("timestamp"), "user", "action", "collection", F.when(F.col("allowed"), "allowed").otherwise("denied").alias("outcome")).dropDuplicates(["id"])
