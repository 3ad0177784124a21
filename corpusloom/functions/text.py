"""Column expressions on text: decoding, lines, token estimate, rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv

# Every character a line may end with; "\r\n" counts as one end.
_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# Possessive, so that no line length can exhaust the matcher's stack.
_LINE = rf"[^{_ENDS}]*+(?:\r\n|[{_ENDS}])|[^{_ENDS}]++"


def decode_text(raw: Column) -> Column:
    """Bytes to text: invalid UTF-8 becomes U+FFFD, all newlines become \\n."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"\r\n?", "\n")


def line_count(text: Column) -> Column:
    """Newlines + 1, from two lengths: a byte search, no regular expression."""
    rest = F.replace(text, F.lit("\n"), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest) + 1).cast("bigint")


def lines_with_ends(text: Column) -> Column:
    """Lines as an array, each with its terminator; concatenation restores the text.

    Nearly all texts have \\n only and are split at it; the pattern does the others.
    """

    def at_newlines(parts: Column) -> Column:
        last = F.size(parts) - 1
        ended = F.transform(parts, lambda line, i: F.when(
            i < last, F.concat(line, F.lit("\n"))
        ).otherwise(line))
        return F.filter(ended, lambda line: line != "")

    return F.when(
        contains_any(text, list(_ENDS[1:])), F.regexp_extract_all(text, F.lit(_LINE), F.lit(0))
    ).otherwise(let(F.split(text, "\n"), at_newlines))


def fixed_width_pieces(text: Column, width: int) -> Column:
    """Cut into pieces of `width` characters in one linear pass."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{width}}}+"), F.lit(0))


def tokens_of_length(n_chars: Column) -> Column:
    return F.when(n_chars == 0, F.lit(0)).otherwise(
        F.floor(n_chars / fv.CHARS_PER_TOKEN) + 1
    ).cast("bigint")


def token_count(text: Column) -> Column:
    return tokens_of_length(F.length(text))


def fits_budget(text: Column, budget: int) -> Column:
    return token_count(text) <= budget


def half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even (Python's `round`).

    Spark's own rounding works on the shortest decimal form, so 2.675 differs.
    """
    shown = F.format_number(value, digits)
    return F.translate(shown, ",", "").cast("double")


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def fill(template: str, **values: Column) -> Column:
    """A text format with {name} fields as one `concat`."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name].cast("string"))
    return F.concat(*parts)


def let(value: Column, body) -> Column:
    """Bind `value` once for an expression that mentions it several times."""
    return F.transform(F.array(value), body)[0]


def explode_structs(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per struct of an array column: keys and the struct's fields.

    The outer form keeps the optimizer from testing the array below the generator,
    which would compute an expensive array twice.
    """
    return (
        df.select(*keys, F.explode_outer(column).alias("_element"))
        .where(F.col("_element").isNotNull())
        .select(*keys, "_element.*")
    )
