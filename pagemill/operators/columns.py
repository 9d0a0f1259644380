"""Column operators: names, provenance, mapping, export text, frame union."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed

_LETTERS = re.compile(fixed.NAME_CHARACTERS)
MAX_NAME = 64


def data_columns(df: DataFrame) -> list[str]:
    """Columns that are not provenance (no leading underscore)."""
    return [c for c in df.columns if not c.startswith("_")]


def safe_name(name: str, index: int = 0) -> str:
    """The runs of allowed characters, joined by single underscores. A leading mark of
    provenance stays; a name may not begin with a digit or be empty."""
    body = "_".join(_LETTERS.findall(name)) or f"column_{index}"
    marks = "_" * name.strip().startswith("_") + "c_" * body[0].isdigit()
    return (marks + body)[:MAX_NAME]


def standardize_columns(df: DataFrame, lower: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """Safe unique column names, and the old -> new map. The second and later columns
    of a name are numbered from 2, past names that are taken."""
    bases = [safe_name(c, i) for i, c in enumerate(df.columns)]
    bases = [b.lower() for b in bases] if lower else bases
    names: dict[str, None] = {}
    for base in bases:
        numbered = itertools.chain([base], (f"{base}_{n}" for n in itertools.count(2)))
        names[next(n for n in numbered if n not in names)] = None
    return df.toDF(*names), dict(zip(df.columns, names))


def add_provenance(df: DataFrame, source_url, method: str, retrieved_at, page=None) -> DataFrame:
    """Adds the provenance columns that are not there yet."""

    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    values = {
        "_source_url": lit(source_url), "_source_page": None if page is None else lit(page),
        "_retrieved_at": lit(retrieved_at), "_extraction_method": lit(method),
    }
    new = {k: v for k, v in values.items() if v is not None and k not in df.columns}
    return df.withColumns(new) if new else df


def hide_provenance(df: DataFrame) -> DataFrame:
    return df.select(*data_columns(df))


def choose_columns(df: DataFrame, visible: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in visible])


def apply_mapping(df: DataFrame, mapping: dict[str, str], keep_extra: bool = True) -> DataFrame:
    """Rename matched columns ({requested: column}); requested first, then the
    others, provenance last."""
    taken = set(mapping.values())
    requested = [F.col(f"`{c}`").alias(r) for r, c in mapping.items()]
    extra = [c for c in data_columns(df) if c not in taken and c not in mapping] if keep_extra else []
    provenance = [c for c in df.columns if c.startswith("_")]
    return df.select(*requested, *extra, *provenance)


def flatten_for_export(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def union_pages(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in first-seen order, provenance last."""
    order: list[str] = []
    for f in frames:
        order += [c for c in f.columns if c not in order]
    result = frames[0]
    for f in frames[1:]:
        result = result.unionByName(f, allowMissingColumns=True)
    return result.select(
        *[c for c in order if not c.startswith("_")], *[c for c in order if c.startswith("_")]
    )


def missing_and_extra(requested, available) -> tuple[Column, Column]:
    """Requested names that are not available, and the reverse."""
    return F.array_except(requested, available), F.array_except(available, requested)


def unpivot(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids..., column, value) with every value as text."""
    texts = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    return df.select(*(ids or []), *texts).unpivot(ids or [], columns, "column", "value")


def search_rows(df: DataFrame, term: str, columns: list[str] | None = None,
                literal: bool = False) -> DataFrame:
    """Rows in which any column, as text, contains the term (case ignored)."""
    names = columns or df.columns
    hit = F.lit(False)
    for c in names:
        text = F.col(f"`{c}`").cast("string")
        match = F.contains(F.lower(text), F.lit(term.lower())) if literal else text.rlike(f"(?i){term}")
        hit = hit | F.coalesce(match, F.lit(False))
    return df.where(hit)


def infer_dtypes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, dtype) of text columns, from shares over all rows in one pass."""
    cells = unpivot(df, columns).where("value is not null and value <> ''")
    v = F.col("value")
    shares = cells.groupBy("column").agg(
        F.avg(v.rlike(fixed.NUMBER_LIKE).cast("int")).alias("numeric"),
        F.avg(v.rlike(fixed.DATED).cast("int")).alias("dated"),
        F.avg(F.startswith(v, F.lit("http")).cast("int")).alias("urls"),
    )
    names = [x for x in columns]
    dtype = (
        F.when(F.col("numeric") >= 0.8, "number")
        .when(F.col("dated") >= 0.6, "date")
        .when(F.col("urls") == 1, "url")
        .otherwise("string")
    )
    known = shares.select("column", dtype.alias("dtype"))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "column string")
    return every.join(known, "column", "left").select(
        "column", F.coalesce("dtype", F.lit("string")).alias("dtype")
    )


def provenance_rows(manifest: DataFrame, max_chars: int | None = None) -> DataFrame:
    """A one-row manifest as (field, value) rows, nested values as JSON, whole unless
    max_chars is given."""
    def cut(c):
        return c if max_chars is None else F.substring(c, 1, max_chars)

    nested = (T.StructType, T.ArrayType, T.MapType)
    cells = [
        F.struct(
            F.lit(f.name).alias("field"),
            (cut(F.to_json(f.name)) if isinstance(f.dataType, nested)
             else F.col(f.name).cast("string")).alias("value"),
        )
        for f in manifest.schema
    ]
    return manifest.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
