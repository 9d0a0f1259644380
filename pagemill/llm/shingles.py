"""Words and word windows as arrays, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _pairs(left: str, right: str, shift: int, count: Column) -> Column:
    n = F.greatest(count, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), lambda a, b: F.xxhash64(a, b))


def with_windows(df: DataFrame, words_column: str, out: str, length: int = 5) -> DataFrame:
    """df with `out`: one 64-bit hash for every `length` (1 to 5) consecutive words.
    Hashes of pairs are paired again, so a window costs three small steps, not five."""
    n = F.size(words_column)
    df = df.withColumn("_h1", F.transform(words_column, lambda w: F.xxhash64(w)))
    if length == 1:
        return df.withColumnRenamed("_h1", out)
    df = df.withColumn("_h2", _pairs("_h1", "_h1", 1, n - 1))
    if length == 2:
        return df.withColumnRenamed("_h2", out).drop("_h1")
    if length == 3:
        return df.withColumn(out, _pairs("_h2", "_h1", 2, n - 2)).drop("_h1", "_h2")
    df = df.withColumn("_h4", _pairs("_h2", "_h2", 2, n - 3))
    if length == 4:
        return df.withColumnRenamed("_h4", out).drop("_h1", "_h2")
    return df.withColumn(out, _pairs("_h4", "_h1", 4, n - 4)).drop("_h1", "_h2", "_h4")
