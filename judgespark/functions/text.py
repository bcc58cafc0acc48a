"""Text rules: trimming, null policy, normal form, keywords, redaction, JSON escaping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from judgespark.schema import (
    EMPTY_TOKENS,
    KEYWORD_MIN_LENGTH,
    KEYWORD_PATTERN,
    STOPWORDS,
    WHITESPACE,
)

# Everything that ends a line of text.
LINE_BREAK = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# The same whitespace set as a regex class, for collapsing runs inside text.
_SPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"


def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both ends (plain ``trim`` removes only blanks)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_emptyish(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*EMPTY_TOKENS), F.lit(True))


def null_if_emptyish(c: Column) -> Column:
    return F.when(~is_emptyish(c), c)


def normal_form(c: Column) -> Column:
    """Lower case, trimmed, inner whitespace runs collapsed to one blank."""
    return F.regexp_replace(F.lower(strip(c)), _SPACE_CLASS + "+", " ")


def keywords(c: Column) -> Column:
    """Distinct content words of ``c`` as an array."""
    words = F.regexp_extract_all(F.lower(c), F.lit(KEYWORD_PATTERN), 0)
    return F.array_distinct(
        F.filter(
            words, lambda w: (F.length(w) >= KEYWORD_MIN_LENGTH) & ~w.isin(*STOPWORDS)
        )
    )


def redact_or_truncate(c: Column, redact: bool, max_length: int = 2048) -> Column:
    size = F.length(c)
    if redact:
        return F.concat(F.lit("<redacted len="), size.cast("string"), F.lit(">"))
    cut = F.concat(
        F.substring(c, 1, max_length),
        F.lit("... <truncated "),
        (size - max_length).cast("string"),
        F.lit(" chars>"),
    )
    return F.when(size <= max_length, c).otherwise(cut)


def ascii_json(c: Column) -> Column:
    """Escape non-ASCII characters of JSON text as ``\\uXXXX`` (UTF-16 units)."""

    def escape(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        return F.when(ch.rlike("[^\\x00-\\x7F]"), F.regexp_replace(units, "(.{4})", "\\\\u$1")).otherwise(ch)

    return F.when(
        c.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(F.split(c, ""), escape), "")
    ).otherwise(c)


# Text that can be JSON at all: a container or string, or nothing but a number or keyword.
_JSON_START = r"""^\s*(?:[\[{"]|-?[0-9][0-9.eE+-]*\s*$|(?:true|false|null)\s*$)"""


def parse_json(c: Column) -> Column:
    """JSON text as a variant, NULL when it is none.

    Free text is turned away by its first character: a failing parse raises an exception inside,
    which costs far more than the check.
    """
    return F.try_parse_json(F.when(c.rlike(_JSON_START), c))


def reasons(checks: Mapping[str, Column]) -> Column:
    """Names of the conditions that hold, as an array.

    Built from joined text because the array functions that drop NULLs evaluate their whole input
    without generated code.
    """
    found = F.concat_ws("\x01", *[F.when(c, F.lit(name)) for name, c in checks.items()])
    return F.array_remove(F.split(found, "\x01"), "")


def bulleted(items: Column, prefix: str = "  - ") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(prefix), x)), "\n")


def indent(c: Column, prefix: str = "  ") -> Column:
    """Indent every line; text without any line becomes ``(empty)``."""
    lines = F.split(F.regexp_replace(c, LINE_BREAK, "\n"), "\n")
    # A trailing line break ends the last line instead of opening an empty one.
    kept = F.when(
        F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)
    ).otherwise(lines)
    body = F.array_join(F.transform(kept, lambda x: F.concat(F.lit(prefix), x)), "\n")
    return F.when(F.size(kept) == 0, F.lit(prefix + "(empty)")).otherwise(body)
