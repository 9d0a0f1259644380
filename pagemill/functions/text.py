"""Text expressions (Column in, Column out)."""

from __future__ import annotations

from functools import wraps
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# Python's idea of whitespace, spelled out for Java regular expressions.
WS = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
REDACTED = "***redacted***"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut(c: Column, n: int | None) -> Column:
    """The first n characters, or all."""
    return c if n is None else F.substring(c, 1, n)


def strip(c) -> Column:
    """Text without whitespace of any kind at its ends."""
    return F.trim(col(c), F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029\u3000"))


def built_once(fn):
    """Keeps the expression a function builds: large ones take seconds to send to
    the JVM piece by piece. Columns are immutable and belong to one context."""
    made: WeakKeyDictionary = WeakKeyDictionary()

    @wraps(fn)
    def build(*args, **kwargs):
        own = made.setdefault(SparkContext._active_spark_context, {})
        key = (args, tuple(sorted(kwargs.items())))
        if key not in own:
            own[key] = fn(*args, **kwargs)
        return own[key]

    return build


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def each(df, array: Column, position: str, item: str):
    """One row per array item, with its position; rows without items vanish.

    An inner explode of a computed array makes the optimizer test the array's
    size in a filter of its own, computing it a second time; the outer form plus
    a check of the position computes it once.
    """
    kept = df.columns
    return df.select(*kept, F.posexplode_outer(array).alias(position, item)).where(
        F.col(position).isNotNull()
    )


def squash(c) -> Column:
    """Runs of whitespace become one space, ends trimmed."""
    return strip(F.regexp_replace(col(c), WS + "+", " "))


def strip_tags(c) -> Column:
    return F.regexp_replace(col(c), r"<[^>]+>", " ")


def safe_excerpt(c, max_chars: int = 4000) -> Column:
    return F.substring(squash(c), 1, max_chars)


def page_title(html, max_chars: int | None = None) -> Column:
    """Text of the first <title>; null without one."""
    pattern = r"(?is)<title[^>]*>(.*?)</title>"
    return F.when(
        col(html).rlike(pattern),
        cut(squash(F.regexp_extract(col(html), pattern, 1)), max_chars),
    )


def any_marker(c, markers: list[str]) -> Column:
    """True when the lower-cased text contains one of the markers."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(low, F.lit(marker))
    return found


def injection_phrases(c) -> Column:
    """First match of every injection pattern."""
    hits = [
        F.when(
            col(c).rlike(p),
            F.regexp_extract(col(c), f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})", 1),
        )
        for p in fixed.INJECTION_PATTERNS
    ]
    return F.array_compact(F.array(*hits))


def normalize_evidence(c) -> Column:
    return F.lower(squash(F.coalesce(col(c).cast("string"), F.lit(""))))


def numeric_forms(c) -> Column:
    """Array of the ways the first number of the text can be written.

    Separator variants, and the value itself, times 100 and over 100 in short
    notation with a point and with a comma.
    """
    def of_number(raw, plain, number):
        shorts = F.transform(F.array(number, number * 100, number / 100), short_number)
        written = F.array(raw, plain, F.translate(raw, ",.", "."), F.translate(raw, ".", ","))
        every = let(
            shorts,
            lambda s: F.concat(written, s, F.transform(s, lambda x: F.translate(x, ".", ","))),
        )
        return F.array_distinct(F.filter(every, lambda f: f.isNotNull() & (f != "")))

    def of_plain(raw, plain):
        dots = F.length(plain) - F.length(F.replace(plain, F.lit("."), F.lit("")))
        # more than one dot: all but the last are grouping
        single = F.when(dots <= 1, plain).otherwise(F.regexp_replace(plain, r"\.(?=.*\.)", ""))
        return let(single.try_cast("double"), lambda number: of_number(raw, plain, number))

    found = F.regexp_extract(normalize_evidence(c), r"([-+]?\d[\d\s.,]*)", 1)
    return let(
        F.regexp_replace(found, " ", ""),
        lambda raw: F.when(raw == "", F.array().cast("array<string>")).otherwise(
            let(F.replace(raw, F.lit(","), F.lit("")), lambda plain: of_plain(raw, plain))
        ),
    )


def short_number(n: Column) -> Column:
    """Six significant digits without trailing zeros, like C's %g."""
    def written(scientific):
        exponent = F.regexp_extract(scientific, r"e([-+]\d+)$", 1).try_cast("int")
        mantissa = F.regexp_replace(
            F.regexp_extract(scientific, r"^([-+]?[\d.]+)e", 1), r"\.?0+$", ""
        )
        tail = F.concat(
            F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0")
        )
        plain = F.regexp_replace(
            scientific.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", ""
        )
        return F.when((exponent < -4) | (exponent >= 6), F.concat(mantissa, tail)).otherwise(plain)

    return (
        F.when(n.isNull(), F.lit(None).cast("string"))
        .when(n == 0, "0")
        .otherwise(let(F.format_string("%.5e", n), written))
    )


def redact(c) -> Column:
    """Secrets in free text: key-like assignments, bearer headers, known token shapes."""
    text = col(c)
    text = F.regexp_replace(text, r"(?i)(https?://)[^/\s:@]+:[^/\s@]+@", "$1" + REDACTED + "@")
    text = F.regexp_replace(
        text, r"(?i)\b(authorization\s*[:=]\s*)(?:bearer|basic)?\s*[^\s\"',;]+", "$1" + REDACTED
    )
    text = F.regexp_replace(text, r"\bsk-[A-Za-z0-9_\-]{8,}", REDACTED)
    text = F.regexp_replace(text, r"\bgh[pousr]_[A-Za-z0-9]{16,}", REDACTED)
    return F.regexp_replace(
        text,
        r"(?i)\b((?:api[_-]?key|access[_-]?token|token|secret|password|signature)\s*[:=]\s*[\"']?)"
        r"[^\s\"'&,;*]+",
        "$1" + REDACTED,
    )


SECRET_NAME = r"(?i)(authorization|cookie|token|secret|password|api[_-]?key|x-api-key|signature)"


def redact_map(c) -> Column:
    """Header or parameter map: values under secret-looking names are replaced."""
    return F.transform_values(
        col(c), lambda k, v: F.when(k.rlike(SECRET_NAME), F.lit(REDACTED)).otherwise(redact(v))
    )


def redact_url(c) -> Column:
    url = F.regexp_replace(col(c), r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/?#@]*@", "$1" + REDACTED + "@")
    return F.regexp_replace(
        url,
        r"(?i)([?&][^=&#]*(?:token|secret|password|api[_-]?key|signature|access_key)[^=&#]*=)[^&#]*",
        "$1" + REDACTED,
    )


def fingerprint(c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(c, 256), 1, 16)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.55, "medium").otherwise("low")


def first_per(items: Column, key) -> Column:
    """First item of every key, in order of appearance: one sort, no pairwise
    comparison. Items must be orderable (no maps)."""

    def firsts(ordered):
        return F.filter(
            ordered, lambda s, j: (j == 0) | (F.get(ordered, j - 1)["k"] != s["k"])
        )

    marked = F.transform(
        items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))
    )
    kept = F.transform(
        let(F.array_sort(marked), firsts), lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x"))
    )
    return F.transform(F.array_sort(kept), lambda s: s["x"])


def map_last_wins(entries: Column) -> Column:
    """map from array<struct<key,value>>; a repeated key keeps its last value."""

    def build(e):
        keys = F.array_distinct(F.transform(e, lambda x: x["key"]))
        return F.when(F.size(keys) == F.size(e), F.map_from_entries(e)).otherwise(
            F.map_from_arrays(
                keys,
                F.transform(
                    keys, lambda k: F.element_at(F.filter(e, lambda x: x["key"] == k), -1)["value"]
                ),
            )
        )

    return let(entries, build)
