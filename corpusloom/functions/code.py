"""Column expressions on source text: comments, methods, decision points.

Methods are found by header patterns, not by a parser: a segment runs from one
header to the next, and its McCabe count is 1 + the decision points in it. The
patterns have no lookaround, and every unbounded repeat that cannot give back is
possessive, so that long inputs neither backtrack nor use up the stack. A line ends
at \\n only (flag d).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import contains_any, let

_ALL = 1 << 30
_MARKS = ["\x01", "\x02", "\x03"]
HASH_COMMENT_LANGUAGES = ["Python", "Ruby"]

_STRING_MARK = (
    r"""(")[^"\\\n]*(?:\\.[^"\\\n]*)*+"|(')[^'\\\n]*(?:\\.[^'\\\n]*)*+'"""
)
_BLOCK_COMMENT = r"/\*[^*]*\*++(?:[^/*][^*]*\*++)*+/"
_SLASH_COMMENTS = rf"//[^\n]*|{_BLOCK_COMMENT}"
_HASH_COMMENTS = rf"#[^\n]*|{_BLOCK_COMMENT}"
_DOC_STRING = '(?s:""".*?""")' + "|(?s:'''.*?''')"

# Comments vanish; of a string literal only the opening quote stays, so that its
# line is still code but no word in it counts as a decision point.
BLANKING = {
    "slash": rf"{_STRING_MARK}|{_SLASH_COMMENTS}",
    "hash": rf"{_DOC_STRING}|{_STRING_MARK}|{_HASH_COMMENTS}",
}

_MODIFIERS = (
    r"public|private|protected|internal|static|final|synchronized|abstract|override|"
    r"virtual|async|inline|open|suspend|export|default|native|const|unsafe|pub|extern"
)
_PARAMS = r"[^()]*+(?:\([^()]*+\)[^()]*+)*+"
_GENERIC = r"<[^(){};\n]*>"
_TYPE = rf"(?:{_GENERIC}[ \t]+)?[\w:.]+(?:{_GENERIC})?[\[\]*&?]*"

_KEYWORD_FORM = (
    rf"(?:def|fun|func|fn|function)[ \t]+(?:\([^)]*\)[ \t]*|{_GENERIC}[ \t]+)?"
    rf"([\w.]+)(?:{_GENERIC})?[ \t]*\(({_PARAMS})\)"
)
_TYPED_FORM = (
    rf"({_TYPE})[ \t]+[*&]*(\w+)[ \t]*\(({_PARAMS})\)\s*"
    r"(?:throws[ \t]+[\w., \t]+|const|noexcept|override)?\s*\{"
)
# In scripts a class method has no type in front, and may have one behind.
_SCRIPT_FORM = (
    rf"(?:({_TYPE})[ \t]+)?([\w$#]+)(?:{_GENERIC})?[ \t]*\(({_PARAMS})\)\s*"
    r"(?::[^{};()\n]*)?\{"
)


def _header(form: str) -> str:
    start = rf"(?md)(?:^|[{{}};])[ \t]*((?:(?:{_MODIFIERS})[ \t]+)*)"
    return rf"{start}(?:{_KEYWORD_FORM}|{form})"


# Groups: 1 modifiers; 2, 3 name and parameters after a function keyword;
# 4, 5, 6 type, name and parameters of a header that opens a block.
METHOD_HEADER = _header(_TYPED_FORM)
SCRIPT_METHOD_HEADER = _header(_SCRIPT_FORM)
SCRIPT_LANGUAGES = ["JavaScript", "TypeScript"]
# A header becomes: \x01 modifiers \x02 name \x02 type \x02 parameters \x03
HEADER_MARK = "\x01$1\x02$2$5\x02$4\x02$3$6\x03"
# Statements that look like headers: `else if (..) {`, `new X() {` and the like.
FALSE_HEADER = (
    r"\x01([^\x01\x02]*\x02(?:(?:" + "|".join([*fv.CONTROL_WORDS, "with", "function"]) + r")\x02"
    r"|[^\x01\x02]*\x02(?:new|return|else|throw)\x02))"
)
DECISIONS = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"
PYTHON_DECISIONS = r"\b(?:if|elif|for|while|case|except|and|or)\b"


def blank_comments(text: Column, language: Column) -> Column:
    """Source text without comments and without the inside of string literals."""
    return F.when(
        language.isin(HASH_COMMENT_LANGUAGES), F.regexp_replace(text, BLANKING["hash"], "$1$2")
    ).otherwise(F.regexp_replace(text, BLANKING["slash"], "$1$2"))


def code_lines(blanked: Column) -> Column:
    """Lines with something on them."""
    return F.regexp_count(blanked, F.lit(r"(?md)^[^\n\S]*\S")).cast("bigint")


def segments(text: Column, language: Column | None = None) -> Column:
    """array<struct<modifiers, name, type, params, body>>, one element per method.

    Without a language, only headers with a type or a function keyword count.
    """

    def mark(t: Column) -> Column:
        clean = F.when(
            contains_any(t, _MARKS), F.translate(t, "".join(_MARKS), "")
        ).otherwise(t)
        typed = F.regexp_replace(clean, METHOD_HEADER, HEADER_MARK)
        if language is None:
            return typed
        script = F.regexp_replace(clean, SCRIPT_METHOD_HEADER, HEADER_MARK)
        return F.when(language.isin(SCRIPT_LANGUAGES), script).otherwise(typed)

    true = F.regexp_replace(let(text, mark), FALSE_HEADER, "$1")
    return F.transform(F.slice(F.split(true, _MARKS[0]), 2, _ALL), _segment)


def _segment(part: Column) -> Column:
    head = F.split(F.substring_index(part, "\x03", 1), "\x02")
    body = F.substring(part, F.instr(part, F.lit("\x03")) + 1, F.length(part))
    return F.struct(
        F.trim(head[0]).alias("modifiers"),
        head[1].alias("name"),
        F.trim(head[2]).alias("type"),
        head[3].alias("params"),
        body.alias("body"),
    )


def decision_points(body: Column, language: Column) -> Column:
    return F.when(
        language == "Python", F.regexp_count(body, F.lit(PYTHON_DECISIONS))
    ).otherwise(F.regexp_count(body, F.lit(DECISIONS)))


def band(average: Column, maximum: Column) -> Column:
    """Complexity band; `average` must be unrounded."""
    chosen = None
    for least_max, least_avg, name in fv.COMPLEXITY_BANDS:
        reached = (maximum >= least_max) | (average >= least_avg)
        chosen = F.when(reached, name) if chosen is None else chosen.when(reached, name)
    return chosen.otherwise(fv.LOWEST_BAND)
