"""Several values packed in one string, as Column expressions (no Python worker).

A string is taken apart in four steps:

1. spans that quotes or a backslash protect are replaced by placeholders
   ``<mark>index<mark>``; a mark that is already in the text counts as a
   protected span itself, so no text can collide with a placeholder;
2. the rest is split at delimiters;
3. placeholders are looked up in the array of spans and put back without their
   quotes and escapes;
4. blanks are trimmed and empty values dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = ""

# What separates values, what wraps a list, what counts as blank.
DELIMITERS = ";,|/&+\\t\\r\\n"
BLANK = "\\s\\u00a0\\u2007\\u202f\\u3000\\ufeff"
OPEN, CLOSE = "\\[{(", "\\]})"

_BEFORE = f"(?<=^|[{BLANK}{DELIMITERS}{OPEN}])"
_AFTER = f"(?=$|[{BLANK}{DELIMITERS}{CLOSE}])"
PROTECTED = (
    rf"\\.|{MARK}"
    rf'|{_BEFORE}"(?:[^"\\]|""|\\.)*"{_AFTER}'
    rf"|{_BEFORE}'(?:[^'\\]|''|\\.)*'{_AFTER}"
)
SPLIT = (
    rf"[{DELIMITERS}]"
    rf"|(?<=[{BLANK}])(?:and|AND|And)(?=[{BLANK}])"
    rf"|(?<={MARK})[{BLANK}]+(?={MARK})"
)
WRAPPED = rf"(?s)^[{BLANK}]*(?:\[(.*)\]|\{{(.*)\}}|\((.*)\))[{BLANK}]*$"
SPECIAL = rf"[{DELIMITERS}\\\"'\[\]{{}}(){MARK}]|[{BLANK}](?:and|AND|And)[{BLANK}]"


def trim_blank(text: Column) -> Column:
    """``text`` without blanks at either end; other spaces than U+0020 count too."""
    return F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def _unwrap(text: Column) -> Column:
    """The inside of one pair of brackets around the whole string."""
    inner = F.regexp_replace(text, WRAPPED, "$1$2$3")
    return F.when(text.rlike(WRAPPED), inner).otherwise(text)


def _restore(span: Column) -> Column:
    """A protected span as the text it stands for."""
    body = F.substring(span, 2, F.length(span) - 2)
    double = F.regexp_replace(F.replace(body, F.lit('""'), F.lit('"')), r"\\(.)", "$1")
    single = F.regexp_replace(F.replace(body, F.lit("''"), F.lit("'")), r"\\(.)", "$1")
    return (
        F.when(span == MARK, span)
        .when(span.startswith('"'), double)
        .when(span.startswith("'"), single)
        .otherwise(F.substring(span, 2, F.length(span)))
    )


def _take_apart(text: Column) -> Column:
    spans = F.transform(F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0)), _restore)
    bare = F.split(text, PROTECTED, -1)
    # text 0, placeholder 0, text 1, placeholder 1, ..., the last text
    numbered = F.transform(
        bare,
        lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit(MARK), (i - 1).cast("string"), F.lit(MARK), part)),
    )
    pieces = F.split(F.array_join(numbered, ""), SPLIT, -1)

    def filled(piece: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(piece, MARK, -1),
                lambda part, i: F.when(i % 2 == 1, F.element_at(spans, F.try_to_number(part, F.lit("999999999")).cast("int") + 1)).otherwise(part),
            ),
            "",
        )

    return F.transform(pieces, filled)


def unpack(text: Column) -> Column:
    """The values of a string in their order, as ``array<string>``.

    Null gives null; blank text, or delimiters alone, give an empty array; a
    clean single value gives an array of one. Quoted or escaped delimiters
    belong to the value, ``""`` inside double quotes is one quote, and a quote
    that doesn't close is ordinary text.
    """
    plain = F.array(text)
    parts = F.when(text.rlike(SPECIAL), _take_apart(_unwrap(text))).otherwise(plain)
    return F.when(text.isNotNull(), F.filter(F.transform(parts, trim_blank), lambda x: x != ""))


def unpack_each(texts: Column) -> Column:
    """``unpack`` of each string of an array; null strings give an empty array."""
    return F.transform(texts, lambda t: F.coalesce(unpack(t), F.array().cast("array<string>")))
