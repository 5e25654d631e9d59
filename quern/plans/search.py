"""Query trees compiled to columns that say which rows match and how they score.

A collection with a written index is searched there: one read of the query's words (pushed down to the row
groups that hold them) gives postings, one grouping by document gives counts, and matching and
scoring are expressions over that row.  The documents themselves are read only for what is not in the
index: conditions on other columns, negations without a positive part, and stored columns.

A table without an index is scanned: one aggregate job counts what the query's terms need, and the
same expressions read the scanned row's tokens.  A page is a TakeOrderedAndProject in both ways.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import LONGEST_CODE_TOKEN, LONGEST_TOKEN, analyzer
from quern.plans.ast import And, Boost, Exists, MatchAll, MatchNone, Node, Not, Or, Phrase, QueryError, Range, Term, Terms, Wildcard
from quern.sources.index import Deferred, Index

#: The stored rows of so many results are fetched by id; of more, by a join.
FETCH_BY_ID = 1000


@dataclass
class Collection:
    """A table of documents: id column, analysed text fields (with their analyzers), and settings."""

    df: DataFrame
    id_col: str = "id"
    text_fields: dict[str, str] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    k1: float = 1.2
    b: float = 0.75
    index: Index | Deferred | None = None

    def __post_init__(self):
        if not self.text_fields:
            self.text_fields = {f.name: "default" for f in self.df.schema if f.dataType.simpleString() == "string" and f.name != self.id_col}
        self.types = {f.name: f.dataType.simpleString() for f in self.df.schema}

    def column(self, name: str) -> Column:
        name = self.id_col if name in ("id", "_id") and name not in self.types else name
        if name not in self.types:
            raise QueryError(f"unknown field: {name}")
        return F.col(f"`{name}`")


class Compiler:
    def __init__(self, c: Collection, fields: list[str] | None = None):
        self.c = c
        self.fields = [f for f in c.text_fields if not fields or f in fields]
        self.needs: dict[tuple[str, tuple[str, ...]], None] = {}

    def tokens(self, f: str) -> Column:
        return F.col(f"__t.`{f}`")

    def with_tokens(self, df: DataFrame, used: set[str]) -> DataFrame:
        """``df`` with the tokens of the used fields in ``__t``.

        They pass through a one-row generator: the optimizer would otherwise copy the
        tokenizer into every expression that reads them."""
        if not used:
            return df
        none = F.array().cast("array<string>")
        fields = [F.coalesce(analyzer(self.c.text_fields[f])(F.col(f"`{f}`")), none).alias(f) for f in sorted(used)]
        return df.withColumn("__t", F.explode(F.array(F.struct(*fields))))

    def words(self, f: str, text: str) -> list[str]:
        """The query's words as the field's analyzer has them."""
        kind = self.c.text_fields[f]
        if kind == "raw":
            return [text]
        longest = LONGEST_TOKEN
        if kind.startswith("code"):
            longest = LONGEST_CODE_TOKEN
            text = regex.sub(r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ", text)
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if 0 < len(w) <= longest]

    # what a row knows of a field: here from its tokens

    def column(self, name: str) -> Column:
        return self.c.column(name)

    def length(self, f: str) -> Column:
        return F.size(self.tokens(f)).cast("double")

    def count_word(self, f: str, word: str) -> tuple[Column, Column]:
        """(whether the row's field holds the word, how often)."""
        held = self.tokens(f)
        return F.array_contains(held, word), F.size(F.filter(held, lambda x: x == word)).cast("double")

    def count_phrase(self, f: str, words: list[str]) -> tuple[Column, Column]:
        held, k = self.tokens(f), len(words)
        wanted = F.array(*[F.lit(w) for w in words])
        places = F.filter(F.sequence(F.lit(1), F.size(held) - k + 1), lambda i: F.slice(held, i, k) == wanted)
        has_all = F.size(held) >= k
        for w in words:  # cheap test before the positions
            has_all = has_all & F.array_contains(held, w)
        tf = F.when(has_all, F.size(places)).otherwise(0)
        return tf > 0, tf.cast("double")

    def has_like(self, f: str, prefix: str, pattern: str) -> Column:
        return F.exists(self.tokens(f), lambda x: x.rlike(pattern))

    def used(self, node: Node) -> set[str]:
        if isinstance(node, (And, Or)):
            return set().union(*map(self.used, node.parts))
        if isinstance(node, (Not, Boost)):
            return self.used(node.part)
        if isinstance(node, (Term, Phrase, Wildcard)):
            return set(self._fields(node.field)) & set(self.c.text_fields)
        return set()

    def _fields(self, name: str | None) -> list[str]:
        if name is None:
            return self.fields
        self.c.column(name)
        return [name]

    def demands(self, node: Node) -> list[tuple[str, list[str]]]:
        """(field, words) of every scored term and phrase."""
        if isinstance(node, (And, Or)):
            return [x for p in node.parts for x in self.demands(p)]
        if isinstance(node, (Boost, Not)):
            return self.demands(node.part)
        if isinstance(node, (Term, Phrase)):
            return [(f, self.words(f, node.text)) for f in self._fields(node.field) if f in self.c.text_fields]
        return []

    def statistics(self, df: DataFrame, node: Node) -> dict:
        """Rows, and by field the sum of lengths and the rows that hold each word: one row of sums."""
        found = {(f, w) for f, ws in self.demands(node) for w in ws}
        keys = sorted(found)
        fields = sorted({f for f, _ in keys})
        if not keys:
            return {"n": 0, "length": {}, "df": {}}
        sums = [F.count(F.lit(1))] + [F.sum(F.size(self.tokens(f))) for f in fields] + [F.sum(F.array_contains(self.tokens(f), w).cast("long")) for f, w in keys]
        row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        n = row[0]
        return {"n": n, "length": {f: (row[1 + i] or 0) / n if n else 0.0 for i, f in enumerate(fields)}, "df": {k: row[1 + len(fields) + i] or 0 for i, k in enumerate(keys)}}

    def bm25(self, f: str, tf: Column, words: list[str], s: dict) -> Column:
        c, n = self.c, float(s["n"])
        idf = F.lit(0.0)
        for w in words:
            held = F.lit(float(s["df"][f, w]))
            idf = idf + F.log(1.0 + (n - held + 0.5) / (held + 0.5))
        mean = F.lit(s["length"][f] or 1.0)
        length = self.length(f)
        out = idf * (tf * (c.k1 + 1.0)) / (tf + c.k1 * ((1.0 - c.b) + c.b * length / mean))
        weight = c.weights.get(f, 1.0)
        return out if weight == 1.0 else out * weight

    def compile(self, node: Node, s: dict) -> tuple[Column, Column]:
        """(whether the row matches, its score if it does)."""
        one, zero = F.lit(1.0), F.lit(0.0)
        if isinstance(node, MatchAll):
            return F.lit(True), one
        if isinstance(node, MatchNone):
            return F.lit(False), zero
        if isinstance(node, Boost):
            match, score = self.compile(node.part, s)
            return match, score * node.factor
        if isinstance(node, Not):
            return ~self.compile(node.part, s)[0], one
        if isinstance(node, And):
            match, score = F.lit(True), zero
            only_not = all(isinstance(p, Not) for p in node.parts)
            for p in node.parts:
                m, x = self.compile(p, s)
                match = match & m
                score = score if isinstance(p, Not) else score + x
            return match, one if only_not else score
        if isinstance(node, Or):
            match, score = F.lit(False), zero
            for p in node.parts:
                m, x = self.compile(p, s)
                match, score = match | m, score + F.when(m, x).otherwise(0.0)
            return match, score
        if isinstance(node, Term):
            return self._any(node.field, lambda f: self._term(f, node.text, s))
        if isinstance(node, Phrase):
            return self._any(node.field, lambda f: self._phrase(f, node.text, s))
        if isinstance(node, Wildcard):
            return self._any(node.field, lambda f: self._wildcard(f, node.pattern))
        if isinstance(node, Exists):
            return self.column(node.field).isNotNull(), one
        if isinstance(node, Terms):
            column = self.column(node.field)
            values = [v for v in node.values if v is not None]
            kind = column if self.c.types.get(node.field) != "string" else column.cast("string")
            found = kind.isin([str(v) if self.c.types.get(node.field) == "string" else v for v in values]) if values else F.lit(False)
            return F.coalesce(found, F.lit(False)), one
        if isinstance(node, Range):
            column = self.column(node.field)
            kind = self.c.types.get(node.field, self.c.types[self.c.id_col])
            match = column.isNotNull()
            if node.lower is not None:
                low = F.lit(node.lower).cast(kind)
                match = match & (column >= low if node.include_lower else column > low)
            if node.upper is not None:
                high = F.lit(node.upper).cast(kind)
                match = match & (column <= high if node.include_upper else column < high)
            return match, one
        raise QueryError(f"unknown node: {node}")

    def _any(self, name: str | None, one_field) -> tuple[Column, Column]:
        match, score = F.lit(False), F.lit(0.0)
        for f in self._fields(name):
            m, x = one_field(f)
            match, score = match | m, score + F.when(m, x).otherwise(0.0)
        return match, score

    def _term(self, f: str, text: str, s: dict) -> tuple[Column, Column]:
        if f not in self.c.text_fields:
            kind = self.c.types.get(f, self.c.types[self.c.id_col])
            return F.coalesce(self.column(f) == F.lit(text).try_cast(kind), F.lit(False)), F.lit(1.0)
        words = self.words(f, text)
        if len(words) > 1:
            return self._phrase(f, text, s)
        if not words:
            return F.lit(False), F.lit(0.0)
        match, tf = self.count_word(f, words[0])
        return match, self.bm25(f, tf, words, s)

    def _phrase(self, f: str, text: str, s: dict) -> tuple[Column, Column]:
        if f not in self.c.text_fields:
            return self._term(f, text, s)
        words = self.words(f, text)
        if not words:
            return F.lit(False), F.lit(0.0)
        if len(words) == 1:
            return self._term(f, words[0], s)
        match, tf = self.count_phrase(f, words)
        return match, self.bm25(f, tf, words, s)

    def _wildcard(self, f: str, pattern: str) -> tuple[Column, Column]:
        pattern = pattern.lower()
        prefix = regex.match(r"[^*?]*", pattern)[0]
        expr = "^" + "".join(".*" if c == "*" else "." if c == "?" else regex.escape(c, special_only=True) for c in pattern) + "$"
        if f in self.c.text_fields:
            return self.has_like(f, prefix, expr), F.lit(1.0)
        return F.coalesce(F.lower(self.column(f).cast("string")).rlike(expr), F.lit(False)), F.lit(1.0)


class IndexCompiler(Compiler):
    """The same expressions over a row that one grouping of the postings gives each document.

    Each count a query needs is an aggregate of that grouping, registered when first asked for."""

    def __init__(self, c: Collection, fields: list[str] | None = None):
        super().__init__(c, fields)
        self.aggregates: dict[tuple, tuple[str, Column]] = {}
        self.wanted: dict[tuple, Column] = {}
        self.columns: set[str] = set()

    def _need(self, key: tuple, what: Column, default=None) -> Column:
        name = self.aggregates.setdefault(key, (f"__{len(self.aggregates)}", what))[0]
        return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))

    def _of(self, f: str, word: str) -> Column:
        here = (F.col("field") == f) & (F.col("term") == word)
        self.wanted[f, word] = here
        return here

    def column(self, name: str) -> Column:
        out = self.c.column(name)
        name = self.c.id_col if name in ("id", "_id") and name not in self.c.types else name
        if name != self.c.id_col:
            self.columns.add(name)
        return out

    def length(self, f: str) -> Column:
        return self._need(("dl", f), F.max(F.when(F.col("field") == f, F.col("dl")))).cast("double")

    def count_word(self, f: str, word: str) -> tuple[Column, Column]:
        tf = self._need(("tf", f, word), F.max(F.when(self._of(f, word), F.col("tf"))), 0)
        return tf > 0, tf.cast("double")

    def count_phrase(self, f: str, words: list[str]) -> tuple[Column, Column]:
        places = [self._need(("places", f, w), F.max(F.when(self._of(f, w), F.col("places")))) for w in words]
        starts = places[0]
        back = lambda k: lambda p: p - k
        for k, x in enumerate(places[1:], 1):
            starts = F.array_intersect(starts, F.transform(x, back(k)))
        tf = F.coalesce(F.size(starts), F.lit(0))
        for x in places:
            tf = F.when(x.isNotNull(), tf).otherwise(0)
        return tf > 0, tf.cast("double")

    def has_like(self, f: str, prefix: str, pattern: str) -> Column:
        here = (F.col("field") == f) & F.col("term").rlike(pattern)
        here = here & F.col("term").startswith(prefix) if prefix else here
        self.wanted[f, None, pattern] = here
        return self._need(("like", f, pattern), F.max(F.when(here, True)), False)

    def numbers(self, node: Node) -> dict:
        """What ``statistics`` counts, from the index: a row of the term table for each word."""
        keys = sorted({(f, w) for f, ws in self.demands(node) for w in ws})
        if not keys:  # no score counts documents
            return {"n": 0, "length": {}, "df": {}}
        index = self.c.index.of_fields(self.used(node))
        some = F.col("term").isin(sorted({w for _, w in keys})) & F.col("field").isin(sorted({f for f, _ in keys}))
        found = {(r["field"], r["term"]): r["df"] for r in index.terms(some).groupBy("field", "term").agg(F.sum("df").alias("df")).collect()}
        return {"n": index.n, "length": {f: (index.total.get(f) or 0) / index.n if index.n else 0.0 for f, _ in keys}, "df": {k: found.get(k, 0) for k in keys}}

    def without_words(self, node: Node) -> bool:
        """Whether the node can match a document that holds none of the query's words."""
        if isinstance(node, And):
            return all(map(self.without_words, node.parts))
        if isinstance(node, Or):
            return any(map(self.without_words, node.parts))
        if isinstance(node, Boost):
            return self.without_words(node.part)
        if isinstance(node, (Term, Phrase, Wildcard)):
            return any(f not in self.c.text_fields for f in self._fields(node.field))
        return not isinstance(node, MatchNone)

    def rows(self, node: Node, columns: list[str]) -> DataFrame:
        """(id, score, columns) of all matches."""
        match, score = self.compile(node, self.numbers(node))
        c, index = self.c, self.c.index.of_fields(self.used(node))
        every = self.without_words(node)
        hits = None
        if self.wanted:
            where = None
            for f in sorted({k[0] for k in self.wanted}):
                words = sorted(k[1] for k in self.wanted if k[0] == f and k[1] is not None)
                parts = [F.col("term").isin(words)] if words else []
                parts += [x for k, x in self.wanted.items() if k[0] == f and k[1] is None]
                one = parts[0]
                for x in parts[1:]:
                    one = one | x
                one = (F.col("field") == f) & one
                where = one if where is None else where | one
            hits = index.postings(where, places=any(k[0] == "places" for k in self.aggregates)).groupBy(F.col("id").alias(c.id_col)).agg(*[what.alias(name) for name, what in self.aggregates.values()])
        docs_columns = sorted(({*self.columns, *columns} - {c.id_col}) & set(c.df.columns))
        if hits is None or every or docs_columns:
            docs = c.df.select(*[F.col(f"`{x}`") for x in {c.id_col: None, **dict.fromkeys(docs_columns)}])
            hits = docs if hits is None else docs.join(hits, c.id_col, "left" if every else "inner")
        return hits.where(match).select(*[F.col(f"`{x}`") for x in dict.fromkeys([c.id_col, *columns])], score.alias("score"))


def hits(c: Collection, node: Node, fields: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """(id, columns, score) of all matches; columns of the table that are not asked for are not read."""
    columns = [x for x in (columns or []) if x not in (c.id_col, "score")]
    compiler = (IndexCompiler if c.index else Compiler)(c, fields)
    if fields and not compiler.fields:
        return c.df.where(F.lit(False)).select(c.id_col, *columns, F.lit(0.0).alias("score"))
    if c.index:
        return compiler.rows(node, columns)
    df = compiler.with_tokens(c.df, compiler.used(node))
    match, score = compiler.compile(node, compiler.statistics(df, node))
    return df.where(match).select(c.id_col, *[F.col(f"`{x}`") for x in columns], score.alias("score"))


def matches(c: Collection, node: Node, fields: list[str] | None = None) -> DataFrame:
    """All matching rows with their columns and ``score``."""
    return hits(c, node, fields, [x for x in c.df.columns if x != "score"]).select(*[F.col(f"`{x}`") for x in c.df.columns if x != "score"], "score")


def fetch(c: Collection, page: DataFrame, limit: int, columns: list[str]) -> DataFrame:
    """A page (id, score) of at most ``limit`` rows with stored columns.  The rows of a short page are read by
    id, which reaches the scan; they come in the page's order."""
    wanted = [F.col(f"`{x}`") for x in dict.fromkeys([c.id_col, *columns])]
    order = [F.desc("score"), F.col(c.id_col)]
    if limit > FETCH_BY_ID:
        return c.df.select(*wanted).join(page, c.id_col).select(c.id_col, "score", *columns).orderBy(*order)
    rows = page.collect()  # at most ``limit``, which is small
    found = c.df.sparkSession.createDataFrame(rows, page.schema)
    stored = c.df.where(F.col(c.id_col).isin([r[c.id_col] for r in rows])) if rows else c.df.where(F.lit(False))
    return stored.select(*wanted).join(F.broadcast(found), c.id_col).select(c.id_col, "score", *columns).orderBy(*order).limit(limit)


def search(
    c: Collection, node: Node, *, limit: int = 10, offset: int = 0, fields: list[str] | None = None, min_score: float | None = None,
    columns: list[str] | None = None, sort: list[tuple[str, bool]] | None = None,
) -> DataFrame:
    """A page of results, best first, ties to the smaller id; ``sort``: columns (name, descending) instead of the
    score, "score" among them."""
    columns = [x for x in (columns or []) if x not in (c.id_col, "score")]
    keys = [x for x, _ in sort or [] if x != "score"]
    early = keys if c.index else list(dict.fromkeys([*columns, *keys]))
    found = hits(c, node, fields, early)
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    order = [F.desc_nulls_last(x) if down else F.asc_nulls_last(x) for x, down in sort or [("score", True)]]
    page = found.orderBy(*order, c.id_col)
    page = (page.offset(offset) if offset else page).limit(limit)
    late = [x for x in columns if x not in early]
    if not late:
        return page.select(c.id_col, "score", *columns)
    if not sort:
        return fetch(c, page.select(c.id_col, "score"), limit, columns)
    stored = fetch(c, page.select(c.id_col, "score"), limit, list(dict.fromkeys([*columns, *keys])))
    return stored.orderBy(*order, c.id_col).select(c.id_col, "score", *columns)


def total(c: Collection, node: Node, fields: list[str] | None = None, min_score: float | None = None) -> DataFrame:
    """One row (total, max_score) over all matches."""
    found = hits(c, node, fields)
    found = found if min_score is None else found.where(F.col("score") >= min_score)
    return found.agg(F.count(F.lit(1)).alias("total"), F.max("score").alias("max_score"))


def simple_search(c: Collection, text: str, *, limit: int = 10, title: str | None = None, body: str | None = None, snippet: int = 100) -> DataFrame:
    """(id, title, snippet, score): a page for a plain query string.  Without names the title is the first
    text column and the body the last."""
    from quern.plans import lucene

    names = list(c.text_fields)
    title, body = title or names[0], body or names[-1]
    page = search(c, lucene.parse(text), limit=limit, columns=list(dict.fromkeys([title, body])))
    return page.select(c.id_col, F.col(title).alias("title"), F.substring(body, 1, snippet).alias("snippet"), "score")
