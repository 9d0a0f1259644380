"""Cell expressions: numbers, dates, booleans, missing tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col, let, strip


def blank_to_null(c) -> Column:
    """Missing-value tokens (exact spelling) become null."""
    return F.when(~col(c).isin(fixed.MISSING_TOKENS), col(c))


def number_body(c) -> Column:
    """Digits and separators left after removing sign brackets, percent and
    currency marks; null when the text is not a number."""
    text = strip(col(c))
    for pattern in (fixed.BRACKETED_NUMBER, fixed.PERCENT_NUMBER, fixed.CURRENCY_NUMBER):
        text = F.regexp_replace(text, pattern, "$1")
    text = F.regexp_replace(text, r"[ \u00a0]", "")
    return F.when(text.rlike(fixed.PLAIN_NUMBER), text)


def number_value(body: Column, original) -> Column:
    """Value of a number body; decides which of comma and point is decimal."""
    comma, dot = F.contains(body, F.lit(",")), F.contains(body, F.lit("."))
    european = F.translate(body, ",.", ".")
    plain = F.translate(body, ",", "")
    text = (
        F.when(comma & dot, F.when(body.rlike(r",[^.]*$"), european).otherwise(plain))
        .when(body.rlike(r"^[^,]*,[^,]{1,2}$"), european)
        .otherwise(plain)
    )
    value = text.try_cast("double")
    negative = col(original).rlike(fixed.BRACKETED_NUMBER)
    return F.when(negative, -value).otherwise(value)


def parse_number(c) -> Column:
    """Number written with grouping, currency, percent or brackets; else null."""
    return let(number_body(c), lambda body: number_value(body, c))


def number_failed(c) -> Column:
    """True for a non-missing text that is not a number."""
    return (
        col(c).isNotNull()
        & ~strip(col(c)).isin(fixed.MISSING_TOKENS)
        & parse_number(c).isNull()
    )


def looks_numeric(c) -> Column:
    rest = F.regexp_replace(col(c), fixed.NUMBER_MARKS, "")
    return ~number_failed(c) & rest.rlike(fixed.PLAIN_NUMBER)


def parse_date(c) -> Column:
    """Timestamp of a date text in one of the declared formats, else null. A text is
    tested for its shape first, and only the formats of that shape are tried; most
    texts fail the first test."""
    def of_shape(text):
        out = None
        for shape, formats in fixed.DATE_SHAPES.items():
            tries = [text.try_cast("timestamp") if f is None else F.try_to_timestamp(text, F.lit(f)) for f in formats]
            out = (F if out is None else out).when(text.rlike(shape), F.coalesce(*tries))
        return F.when(text.rlike(fixed.DATE_START), out)

    return let(strip(col(c)), of_shape)


def looks_date(c) -> Column:
    return col(c).rlike(fixed.DATE_LIKE)


def parse_boolean(c) -> Column:
    word = F.lower(strip(col(c)))
    return F.when(word.isin(fixed.TRUE_WORDS), True).when(word.isin(fixed.FALSE_WORDS), False)


def infer_dtype(values: Column) -> Column:
    """Type of an array of texts: number, date, url or string."""
    sample = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    n = F.size(sample)
    numeric = F.size(F.filter(sample, lambda v: v.rlike(fixed.NUMBER_LIKE)))
    dated = F.size(
        F.filter(sample, lambda v: v.rlike(fixed.DATED))
    )
    urls = F.size(F.filter(sample, lambda v: F.startswith(v, F.lit("http"))))
    return (
        F.when(n == 0, "string")
        .when(numeric >= n * 0.8, "number")
        .when(dated >= n * 0.6, "date")
        .when(urls == n, "url")
        .otherwise("string")
    )
