"""Duplicates. Every operator aggregates, so equal rows are folded on the map
side and a value held by a third of all rows never travels as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from .columns import data_columns


def _comparable(field: T.StructField) -> Column:
    """A column as a value that can be hashed: maps by their sorted entries, variants
    by their text."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.MapType):
        return F.array_sort(F.map_entries(c))
    if isinstance(field.dataType, T.VariantType):
        return F.to_json(c)
    return c


def key_digest(df: DataFrame, keys: list[str]) -> list[Column]:
    """128 bits that stand for the key columns; a null equals a null."""
    fields = {f.name: f for f in df.schema}
    parts = [x for k in keys for x in (F.col(f"`{k}`").isNull(), _comparable(fields[k]))]
    return [F.xxhash64(*parts).alias("__a"), F.xxhash64(F.lit(1), *parts).alias("__b")]


def drop_duplicates(df: DataFrame, row_id: str, subset: list[str] | None = None) -> DataFrame:
    """First row (by row_id) of every key; provenance does not count, nulls are
    equal. row_id itself is not part of the default key. Rows are grouped by a digest
    of the key, so columns of any type may be part of the row."""
    keys = subset or [c for c in data_columns(df) if c != row_id]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = F.min_by(row, F.struct(F.col(row_id).isNull(), row_id)).alias("__first")
    return df.groupBy(*key_digest(df, keys)).agg(first).select("__first.*")


def count_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """One row: rows, distinct rows and rows beyond the first of their key."""
    groups = df.groupBy(*key_digest(df, subset or data_columns(df))).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def dedupe_urls(df: DataFrame, url: str = "url", row_id: str = "page_id") -> DataFrame:
    """(canonical_url, first row_id, copies)."""
    return (
        df.select(row_id, urls.canonical_url(url).alias("canonical_url"))
        .groupBy("canonical_url")
        .agg(F.min(row_id).alias(row_id), F.count("*").alias("copies"))
    )


def content_hash(c) -> object:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def dedupe_content(df: DataFrame, body: str, row_id: str) -> DataFrame:
    """(content_hash, first row_id, copies) by SHA-256 of the body; only the
    32-byte digest is shuffled, never the body."""
    return (
        df.select(row_id, content_hash(body).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.min(row_id).alias(row_id), F.count("*").alias("copies"))
    )


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """One row: values beyond the first in a column that should be unique."""
    groups = df.groupBy(*key_digest(df, [column])).agg(F.count("*").alias("n"))
    return groups.agg(
        F.lit(column).alias("column"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_values"),
    )
