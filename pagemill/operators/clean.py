"""Opt-in cleaning. Each step is a projection; a step that must look at a whole
column first does so in one aggregate of fixed size (a few numbers per column).
The input frame is never changed; texts that did not convert stay in `<c>__raw`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text, values
from .columns import data_columns, unpivot


def text_columns(df: DataFrame) -> list[str]:
    """Text columns, without the kept originals of converted cells."""
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.StringType) and not f.name.endswith("__raw")
    ]


def numeric_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.NumericType) and not f.name.startswith("_")
    ]


def trim_whitespace(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: text.squash(c) for c in columns or text_columns(df)})


def normalize_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: values.blank_to_null(c) for c in columns or text_columns(df)})


def change_counts(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """(column, changed_cells): how many cells a projection would change."""
    counts = df.agg(
        *[F.count_if(~F.col(c).eqNullSafe(new)).alias(c) for c, new in changes.items()]
    )
    return counts.unpivot([], list(changes), "column", "changed_cells")


def _per_column(df: DataFrame, measures: dict[str, dict[str, Column]]) -> DataFrame:
    """(column, measure...) from one aggregate over the frame, without an exchange of
    its cells."""
    if not measures:
        raise ValueError("no columns to measure")
    names = list(next(iter(measures.values())))
    one = df.agg(*[F.struct(*[m.alias(n) for n, m in own.items()]).alias(c) for c, own in measures.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}`")[n].alias(n) for n in names]) for c in measures])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def with_numbers(df: DataFrame, columns: list[str], of=F.col) -> DataFrame:
    """Adds `__number_<c>`, the number that the text of a column is; null if it is none."""
    df = df.withColumns({f"__body_{c}": values.number_body(of(c)) for c in columns})
    df = df.withColumns({f"__number_{c}": values.number_value(F.col(f"__body_{c}"), of(c)) for c in columns})
    return df.drop(*[f"__body_{c}" for c in columns])


def number_measures(c: str, own: Column) -> dict[str, Column]:
    missing = own.isNull() | text.strip(own).isin(fixed.MISSING_TOKENS)
    number = F.col(f"__number_{c}")
    return {
        "cells": F.count("*"),
        "failures": F.count_if(~missing & number.isNull()),
        "converted": F.count(number),
        "percent_cells": F.count_if(F.contains(own, F.lit("%"))),
    }


def number_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, cells, failures, converted, percent_cells) for text columns."""
    return _per_column(with_numbers(df, columns), {c: number_measures(c, F.col(c)) for c in columns})


def convertible(stats: DataFrame, percentages: bool) -> dict[str, bool]:
    """Columns that become numbers -> whether they are divided by 100. One small
    row per column reaches the driver."""
    chosen = {}
    for r in stats.collect():
        if r["cells"] and r["failures"] / r["cells"] <= 0.5:
            chosen[r["column"]] = percentages and r["percent_cells"] / r["cells"] > 0.5
    return chosen


def numeric_conversion(df: DataFrame, columns: list[str] | None = None, percentages: bool = False,
                       keep_raw: bool = True) -> DataFrame:
    """Text to numbers; a column with more than half failures stays text."""
    columns = columns or numeric_candidates(df)
    if not columns:
        return df
    chosen = convertible(number_stats(df, columns), percentages)
    return to_numbers(df, {c: chosen[c] for c in columns if c in chosen}, keep_raw)


def to_numbers(df: DataFrame, chosen: dict[str, bool], keep_raw: bool = True) -> DataFrame:
    """Lazy part of the conversion: {column: divide by 100}."""
    if not chosen:
        return df
    df = with_numbers(df, list(chosen))
    new = {}
    for c, percent in chosen.items():
        number = F.col(f"__number_{c}")
        new[c] = number / 100.0 if percent else number
        if keep_raw:
            failed = number.isNull() & ~text.strip(c).isin(fixed.MISSING_TOKENS)
            new[f"{c}__raw"] = F.when(failed, F.col(c))
    return df.withColumns(new).drop(*[f"__number_{c}" for c in chosen])


DATE_NAME = "date|time|published|updated|تاريخ"


def share(test: Column, own: Column) -> Column:
    """Share of the non-null texts that pass a test, over all rows."""
    return F.avg(F.when(own.isNotNull(), F.coalesce(test, F.lit(False)).cast("int")))


def _own_texts(df: DataFrame) -> list[str]:
    return [c for c in text_columns(df) if not c.startswith("_")]


def numeric_shares(df: DataFrame) -> DataFrame:
    """(column, share, is_candidate) of text columns, over all their texts."""
    found = {c: {"share": share(values.looks_numeric(c), F.col(c))} for c in _own_texts(df)}
    return _per_column(df, found).where("share IS NOT NULL").withColumn("is_candidate", F.col("share") >= 0.7)


def numeric_candidates(df: DataFrame) -> list[str]:
    return sorted(r["column"] for r in numeric_shares(df).where("is_candidate").collect()) if _own_texts(df) else []


def date_shares(df: DataFrame) -> DataFrame:
    """(column, share, is_candidate) of text columns, over all their texts."""
    found = {c: {"share": share(values.looks_date(c), F.col(c))} for c in _own_texts(df)}
    named = F.lower("column").rlike(DATE_NAME)
    return _per_column(df, found).where("share IS NOT NULL").withColumn(
        "is_candidate", (F.col("share") >= 0.6) | named
    )


def date_candidates(df: DataFrame) -> list[str]:
    return sorted(r["column"] for r in date_shares(df).where("is_candidate").collect()) if _own_texts(df) else []


def date_measures(own: Column, parsed: Column) -> dict[str, Column]:
    return {
        "cells": F.count("*"), "parsed": F.count(parsed),
        "failures": F.count_if(own.isNotNull() & parsed.isNull()),
    }


def date_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, cells, parsed, failures)."""
    df = df.withColumns({f"__date_{c}": values.parse_date(c) for c in columns})
    return _per_column(df, {c: date_measures(F.col(c), F.col(f"__date_{c}")) for c in columns})


def parse_dates(df: DataFrame, columns: list[str], keep_raw: bool = True) -> DataFrame:
    """Text to timestamps; a column in which fewer than half parse is unchanged."""
    good = [
        r["column"] for r in date_stats(df, columns).collect()
        if r["cells"] and r["parsed"] / r["cells"] >= 0.5
    ]
    return to_dates(df, [c for c in columns if c in good], keep_raw)


def to_dates(df: DataFrame, columns: list[str], keep_raw: bool = True) -> DataFrame:
    if not columns:
        return df
    df = df.withColumns({f"__date_{c}": values.parse_date(c) for c in columns})
    raw = {f"{c}__raw": F.when(F.col(f"__date_{c}").isNull(), F.col(c)) for c in columns} if keep_raw else {}
    df = df.withColumns({**raw, **{c: F.col(f"__date_{c}") for c in columns}})
    return df.drop(*[f"__date_{c}" for c in columns])


def yes_or_no(c: Column) -> Column:
    return F.lower(text.strip(c)).isin(fixed.TRUE_WORDS + fixed.FALSE_WORDS)


def boolean_columns(df: DataFrame) -> list[str]:
    """Text columns whose every value is a yes/no word."""
    names = _own_texts(df)
    if not names:
        return []
    checks = df.agg(*[F.bool_and(yes_or_no(F.col(c))).alias(c) for c in names]).first()
    return [c for c in names if checks[c]]


def normalize_booleans(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = boolean_columns(df) if columns is None else columns
    return df.withColumns({c: values.parse_boolean(c) for c in columns}) if columns else df


def category_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, n_distinct, is_category): distinct values under half of the rows."""
    counts = (
        unpivot(df, columns or text_columns(df))
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    return (
        counts.groupBy("column")
        .agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))
        .withColumn("is_category", F.col("n_distinct") / F.col("n") < 0.5)
    )


def normalize_categories(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = [r["column"] for r in category_columns(df, columns).where("is_category").collect()]
    return trim_whitespace(df, names) if names else df


def spread_of(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the columns with 8 values or more and any
    spread, from one aggregate: a row of three numbers for each column."""
    found = _per_column(df, {
        c: {"n": F.count(c), "mean": F.avg(c), "sd": F.stddev_pop(c)} for c in columns
    }).collect() if columns else []
    return {r["column"]: (r["mean"], r["sd"]) for r in found if r["n"] >= 8 and r["sd"] and r["sd"] > 0}


def flag_outliers(df: DataFrame, columns: list[str] | None = None, z: float = 3.0) -> DataFrame:
    """Adds `<c>_outlier_flag`: more than z population deviations from the mean. A
    column with fewer than 8 values or without spread gets no flag. No row is dropped;
    missing values are not outliers."""
    spread = spread_of(df, columns or numeric_columns(df))
    flags = {
        f"{c}_outlier_flag": F.coalesce(F.abs(F.col(c) - F.lit(mean)) / F.lit(sd) > z, F.lit(False))
        for c, (mean, sd) in spread.items()
    }
    return df.withColumns(flags) if flags else df


def row_fingerprint(df: DataFrame, columns: list[str] | None = None) -> Column:
    """16 hex digits over the row's JSON with sorted names."""
    names = sorted(columns or data_columns(df))
    return text.fingerprint(F.to_json(F.struct(*names)))
