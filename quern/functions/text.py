"""Analyzers and text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer tokens are dropped by the default analyzer and by the code analyzer.
LONGEST_TOKEN, LONGEST_CODE_TOKEN = 39, 100


def default_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits of up to 39 characters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: F.length(x).between(1, LONGEST_TOKEN))


def raw_tokens(c: Column) -> Column:
    """The whole value as one token; null has none."""
    return F.when(c.isNotNull(), F.array(c))


def split_identifiers(c: Column) -> Column:
    """Marks the borders inside identifiers: separators, letter to digit, lower to upper, and the
    last capital of an acronym before a lower-case letter."""
    c = F.regexp_replace(c, r"[_\-]+", " ")
    c = F.regexp_replace(c, r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " ")
    c = F.regexp_replace(c, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return c


def code_tokens(c: Column) -> Column:
    """Words split as identifiers, lower-cased, of up to 100 characters."""
    words = F.regexp_replace(c, r"[^\p{L}\p{N}_\-]+", " ")
    return F.filter(F.split(F.lower(split_identifiers(words)), " +"), lambda x: F.length(x).between(1, LONGEST_CODE_TOKEN))


def comment_tokens(c: Column) -> Column:
    """Words of comments: letters, digits and underscores, at least two characters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) >= 2)


ANALYZERS = {"default": default_tokens, "raw": raw_tokens, "code": code_tokens, "code-treesitter": code_tokens}


def analyzer(name: str):
    """By name; ``code-treesitter-python`` and its like cut a text by that language's comments, strings and
    keywords, and fall back to ``code`` for a language that is not known."""
    if name.startswith("code-treesitter-"):
        from quern.functions.code import LANGUAGES, syntax_tokens

        language = name.removeprefix("code-treesitter-")
        return (lambda c: syntax_tokens(c, language)) if language in LANGUAGES else code_tokens
    if name not in ANALYZERS:
        raise ValueError(f"unknown analyzer: {name}")
    return ANALYZERS[name]


#: Language by file extension.
EXTENSIONS = {
    "rs": "rust", "py": "python", "pyw": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "rb": "ruby", "rake": "ruby", "gemspec": "ruby",
    "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang", "sh": "bash", "bash": "bash", "zsh": "bash",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "jsonl": "json", "html": "html", "htm": "html", "sql": "sql", "ddl": "sql", "dml": "sql",
    "java": "java", "css": "css",
}
#: Language by a mark in the content; the first that is found decides.
MARKS = [
    ("python", r"\A#![^\n]*python"), ("ruby", r"\A#![^\n]*ruby"), ("elixir", r"\A#![^\n]*elixir"), ("erlang", r"\A#![^\n]*escript"), ("bash", r"\A#![^\n]*\b(?:ba|z)?sh\b"),
    ("elixir", r"(?m)^\s*defmodule\s+[A-Z]"), ("erlang", r"(?m)^-module\("), ("cpp", r"(?m)^\s*(?:using\s+namespace|template\s*<|#include\s*<[a-z_]+>)"), ("c", r"(?m)^\s*#include\s*[<\"]"),
    ("rust", r"(?m)^\s*(?:pub\s+)?fn\s+\w+"), ("python", r"(?m)^\s*def\s+\w+\(.*\):"), ("go", r"(?m)^package\s+\w+\s*$"),
    ("typescript", r"(?m)^\s*(?:export\s+)?(?:interface\s+\w+\s*\{|type\s+\w+\s*=)"), ("javascript", r"(?m)^\s*(?:(?:async\s+)?function\s+\w+\s*\(|(?:const|let|var)\s+\w+\s*=)"),
    ("ruby", r"(?m)^\s*(?:require\s+['\"]|def\s+\w+[?!]?\s*(?:\(.*\))?\s*$)"), ("sql", r"(?i)\A\s*(?:select|insert\s+into|create\s+table)\s"), ("html", r"(?i)<html"),
    ("json", r"\A\s*[\[{]\s*[\"\]}\[{]"), ("toml", r"(?m)\A(?:\s|#[^\n]*\n)*\[[\w.-]+\]\s*$"), ("yaml", r"(?m)\A---\s*$"),
]


def code_language(path: Column, content: Column | None = None) -> Column:
    """By extension, else by marks in the content, else null."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_ext = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]
    return by_ext if content is None else F.coalesce(by_ext, *[F.when(content.rlike(mark), name) for name, mark in MARKS])


def html_strip(c: Column) -> Column:
    """Drops what stands between < and >; an unclosed < drops the rest, a stray > goes."""
    return F.regexp_replace(F.regexp_replace(c, r"<[^>]*(>|$)", ""), ">", "")


def wikitext_strip(c: Column) -> Column:
    """Plain text of wiki markup; see ``functions.wikitext.plain``, which scans nested braces and links."""
    from quern.functions.wikitext import plain_udf

    return plain_udf()(c)


def highlight(text: Column, terms: list[str], size: int = 150, tag: str = "em") -> Column:
    """The fragment of up to ``size`` characters around the first match, HTML-escaped, matches
    tagged; null without a match.  Terms are letters and digits."""
    words = "|".join(sorted({t for t in terms if t}))
    if not words:
        return F.lit(None).cast("string")
    pattern = rf"(?i)(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])"
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(F.lit(1), at - F.lit(size // 4))
    part = F.substring(text, start, F.lit(size))
    safe = F.replace(F.replace(F.replace(part, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(at > 0, F.regexp_replace(safe, pattern, f"<{tag}>$1</{tag}>"))
