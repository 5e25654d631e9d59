"""Source code of sixteen languages as tokens: identifiers without keywords, words of comments and of strings.

A language is described by how its comments and strings look and by its keywords; one pattern cuts a text
into these parts on the JVM.  There is no syntax tree: a part is known by how it begins.
"""

from __future__ import annotations

import keyword
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import code_tokens

SLASHES, HASH, DASHES, PERCENT = "//[^\\n]*+", "#[^\\n]*+", "--[^\\n]*+", "%[^\\n]*+"
BLOCK, MARKUP = r"/\*(?s:.*?)(?:\*/|\z)", r"<!--(?s:.*?)(?:-->|\z)"
DOUBLE, SINGLE, BACKTICK = r'"[^"\n]*+"?', r"'[^'\n]*+'?", r"`[^`]*+`?"
TRIPLE = r'"""(?s:.*?)(?:"""|\z)|' + r"'''(?s:.*?)(?:'''|\z)"
#: A quote that holds one character, beside which a quote can mark something else (a lifetime).
CHARACTER = r"'[^'\n]'"
WORD = r"[\p{L}_][\p{L}\p{N}_]*+"

COMMON = "if else for while return break continue true false null in do case default switch"
CURLY = COMMON + " const static class new this try catch throw void import export enum"


@dataclass(frozen=True)
class Language:
    comments: tuple[str, ...]
    strings: tuple[str, ...]
    keywords: str = ""


_C = Language((SLASHES, BLOCK), (DOUBLE, SINGLE), COMMON + " const static void enum struct union typedef sizeof extern goto int char long short float double unsigned signed")
_JS = Language((SLASHES, BLOCK), (DOUBLE, SINGLE, BACKTICK), CURLY + " function let var typeof instanceof undefined async await of from extends super yield delete")
LANGUAGES = {
    "rust": Language((SLASHES, BLOCK), (DOUBLE, CHARACTER), COMMON + " fn let mut pub use mod impl trait struct enum match loop self super crate where move ref as dyn const static type unsafe async await"),
    "python": Language((HASH,), (TRIPLE, DOUBLE, SINGLE), " ".join(keyword.kwlist)),
    "javascript": _JS,
    "typescript": Language(_JS.comments, _JS.strings, _JS.keywords + " interface type implements readonly declare namespace private public protected string number boolean any"),
    "go": Language((SLASHES, BLOCK), (DOUBLE, BACKTICK, CHARACTER), COMMON + " func var const type struct interface map chan go defer select range package import goto fallthrough nil"),
    "c": _C,
    "cpp": Language(_C.comments, _C.strings, _C.keywords + " class new delete this try catch throw template typename namespace using public private protected virtual operator bool auto nullptr"),
    "ruby": Language((HASH,), (DOUBLE, SINGLE, BACKTICK), COMMON + " def end class module then elsif unless until begin rescue ensure yield self nil and or not when super undef alias"),
    "elixir": Language((HASH,), (TRIPLE, DOUBLE, SINGLE), "do end fn true false nil and or not in when after else catch rescue"),
    "erlang": Language((PERCENT,), (DOUBLE, SINGLE), "after begin case catch end fun if of receive try when and or not div rem"),
    "bash": Language((HASH,), (DOUBLE, SINGLE, BACKTICK), "if then else elif fi for while until do done case esac in function return"),
    "yaml": Language((HASH,), (DOUBLE, SINGLE), "true false null"),
    "toml": Language((HASH,), (TRIPLE, DOUBLE, SINGLE), "true false"),
    "json": Language((), (DOUBLE,), "true false null"),
    "html": Language((MARKUP,), (DOUBLE,)),
    "sql": Language((DASHES, BLOCK), (SINGLE, DOUBLE), "select from where group by having order limit insert into values update set delete create table drop join on as and or not null is in case when then else end"),
}


def syntax_tokens(c: Column, language: str, comments: bool = True, strings: bool = True) -> Column:
    """Tokens of a text in a language, in order: identifiers that are no keywords, split at their inner
    borders, and the words of comments and strings if wanted (two characters or more, split alike, so that
    one query word finds both).  Numbers and operators give none.  An open comment or string lasts to the
    end of the text or line.  What follows a backslash is skipped.  Null gives null."""
    lang = LANGUAGES[language]
    plain = F.regexp_replace(c, r"\\(?s:.)", "  ")  # escapes hold no words, and quotes are plain after it
    pattern = "|".join([*lang.comments, *lang.strings, WORD, r"\p{N}[\p{L}\p{N}_.]*+"])
    parts = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
    words = lambda p: F.filter(code_tokens(p), lambda t: F.length(t) >= 2)
    nothing = F.array().cast("array<string>")
    known = sorted(set(lang.keywords.split()))

    def tokens(p: Column) -> Column:
        key = F.lower(p) if language == "sql" else p
        own = F.when(key.isin(known), nothing).otherwise(code_tokens(p)) if known else code_tokens(p)
        out = F.when(p.rlike(r"^\p{N}"), nothing).when(p.rlike(r"^[\p{L}_]"), own)
        quoted = words(p) if strings else nothing
        remark = words(p) if comments else nothing
        return out.when(p.rlike("^[\"'`]"), quoted).otherwise(remark)

    return F.flatten(F.transform(parts, tokens))
