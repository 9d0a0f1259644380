"""Cleaning recipe: the steps in their fixed order, as one lazy chain plus the
small aggregates that decide per column, and a change report."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, values
from ..operators import clean, columns, dedupe


@dataclass
class Recipe:
    trim_whitespace: bool = True
    normalize_missing: bool = True
    numeric_conversion: bool = False
    parse_percentages: bool = False
    parse_currency: bool = False
    parse_dates: bool = False
    normalize_booleans: bool = False
    normalize_categories: bool = False
    standardize_column_names: bool = False
    drop_duplicates: bool = False
    duplicate_subset: list[str] | None = None
    flag_outliers: bool = False
    outlier_z: float = 3.0
    numeric_columns: list[str] | None = None
    date_columns: list[str] | None = None

    @property
    def converts_numbers(self) -> bool:
        return self.numeric_conversion or self.parse_percentages or self.parse_currency

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def hash(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:16]

    @staticmethod
    def from_json(body: str) -> Recipe:
        return Recipe(**json.loads(body))


@dataclass
class Cleaned:
    frame: DataFrame
    operations: list[dict] = field(default_factory=list)
    failures: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def _measured(df: DataFrame, recipe: Recipe, names: list[str]) -> dict[str, dict]:
    """Everything the steps must know about text columns, from one aggregate over the
    frame: {column: {measure: value}}."""
    staged = df.withColumns({f"__trimmed_{c}": text.squash(c) if recipe.trim_whitespace else F.col(c) for c in names})
    staged = staged.withColumns({
        f"__clean_{c}": values.blank_to_null(f"__trimmed_{c}") if recipe.normalize_missing else F.col(f"__trimmed_{c}")
        for c in names
    })
    own = [c for c in names if not c.startswith("_")]
    numbers = [c for c in recipe.numeric_columns or own if c in names] if recipe.converts_numbers else []
    dates = [c for c in recipe.date_columns or own if c in names] if recipe.parse_dates else []
    staged = clean.with_numbers(staged, numbers, lambda c: F.col(f"__clean_{c}"))
    staged = staged.withColumns({f"__date_{c}": values.parse_date(f"__clean_{c}") for c in dates})
    measures: list[Column] = []

    def measure(c, found):
        measures.append(F.struct(*[m.alias(n) for n, m in found.items()]).alias(c))

    for c in names:
        trimmed, cell = F.col(f"__trimmed_{c}"), F.col(f"__clean_{c}")
        found = {
            "trimmed": F.count_if(~F.col(c).eqNullSafe(trimmed)),
            "blanked": F.count_if(~trimmed.eqNullSafe(cell)),
            "present": F.count(cell),
        }
        if c in numbers:
            found.update(clean.number_measures(c, cell))
            found["numeric_share"] = clean.share(values.looks_numeric(cell), cell)
        if c in dates:
            found.update({f"date_{k}": m for k, m in clean.date_measures(cell, F.col(f"__date_{c}")).items()})
            found["date_share"] = clean.share(values.looks_date(cell), cell)
        if recipe.normalize_booleans and c in own:
            found["boolean"] = F.bool_and(clean.yes_or_no(cell))
        measure(c, found)
    row = staged.agg(*measures).first()
    return {c: row[c].asDict() for c in names}


def apply_recipe(df: DataFrame, recipe: Recipe, row_id: str) -> Cleaned:
    """Cleaned frame with its report. One aggregate decides and counts the steps on
    text columns; the rows themselves are only projected. An empty frame is returned
    with nothing converted."""
    out = Cleaned(df)

    def report(name, cols, changed=0, failures=0, detail=""):
        out.operations.append(
            {"operation": name, "columns": ", ".join(cols), "changed_cells": int(changed or 0),
             "conversion_failures": int(failures or 0), "detail": detail}
        )

    def failed(cols, measure):
        for c in cols:
            if known[c][measure]:
                out.failures[c] = out.failures.get(c, 0) + known[c][measure]

    names = [c for c in clean.text_columns(df) if c != row_id]
    known = _measured(df, recipe, names) if names else {}
    if recipe.trim_whitespace and names:
        out.frame = clean.trim_whitespace(out.frame, names)
        report(fixed.STEP_NAMES["trim"], names, sum(k["trimmed"] for k in known.values()))
    if recipe.normalize_missing and names:
        out.frame = clean.normalize_missing(out.frame, names)
        report(fixed.STEP_NAMES["missing"], names, sum(k["blanked"] for k in known.values()), detail="such as '-', 'N/A' and '..'")
    numbers = {}
    wanted = [c for c in names if "numeric_share" in known[c]]
    if not recipe.numeric_columns:
        wanted = sorted(c for c in wanted if (known[c]["numeric_share"] or 0) >= 0.7)
    else:
        wanted = [c for c in recipe.numeric_columns if c in wanted]
    for c in wanted:
        k = known[c]
        if not k["cells"] or k["failures"] / k["cells"] > 0.5:
            out.warnings.append(f"'{c}' stays text: most of its cells are no numbers")
        else:
            numbers[c] = recipe.parse_percentages and k["percent_cells"] / k["cells"] > 0.5
    if numbers:
        out.frame = clean.to_numbers(out.frame, numbers)
        failed(numbers, "failures")
        report(fixed.STEP_NAMES["numbers"], list(numbers), sum(known[c]["converted"] for c in numbers),
               sum(known[c]["failures"] for c in numbers))
    wanted = [c for c in names if "date_share" in known[c] and c not in numbers]
    if not recipe.date_columns:
        named = re.compile(clean.DATE_NAME)
        wanted = sorted(c for c in wanted if (known[c]["date_share"] or 0) >= 0.6 or
                        (known[c]["present"] and named.search(c.lower())))
    else:
        wanted = [c for c in recipe.date_columns if c in wanted]
    dates = [c for c in wanted if known[c]["date_cells"] and known[c]["date_parsed"] / known[c]["date_cells"] >= 0.5]
    out.warnings += [f"'{c}' stays text: most of its cells are no dates" for c in wanted if c not in dates]
    if dates:
        out.frame = clean.to_dates(out.frame, dates)
        failed(dates, "date_failures")
        report(fixed.STEP_NAMES["dates"], dates, known[dates[0]]["date_cells"], sum(known[c]["date_failures"] for c in dates))
    flags = [c for c in names if known[c].get("boolean") and c not in numbers and c not in dates]
    if flags:
        out.frame = clean.normalize_booleans(out.frame, flags)
        report(fixed.STEP_NAMES["booleans"], flags, sum(known[c]["present"] for c in flags))
    if recipe.normalize_categories:
        texts = clean.text_columns(out.frame)
        found = sorted(r["column"] for r in clean.category_columns(out.frame, texts).where("is_category").collect()) if texts else []
        if found:
            n = clean.change_counts(out.frame, {c: text.squash(c) for c in found}).agg(F.sum("changed_cells")).first()[0]
            out.frame = clean.trim_whitespace(out.frame, found)
            report(fixed.STEP_NAMES["categories"], found, n, detail="white space only, the labels stay")
    if recipe.standardize_column_names:
        out.frame, renamed = columns.standardize_columns(out.frame)
        row_id = renamed.get(row_id, row_id)
        report(fixed.STEP_NAMES["names"], list(renamed.values()), sum(a != b for a, b in renamed.items()))
    if recipe.drop_duplicates:
        subset = recipe.duplicate_subset
        keys = subset or [c for c in columns.data_columns(out.frame) if c != row_id]
        removed = dedupe.count_duplicates(out.frame, keys).first()["duplicate_rows"]
        out.frame = dedupe.drop_duplicates(out.frame, row_id, subset)
        report(fixed.STEP_NAMES["duplicates"], subset or [], removed, detail="by key" if subset else "whole rows")
    if recipe.flag_outliers:
        found = [c for c in clean.numeric_columns(out.frame) if c != row_id]
        before = set(out.frame.columns)
        out.frame = clean.flag_outliers(out.frame, found, recipe.outlier_z)
        flags = [c for c in out.frame.columns if c not in before]
        if flags:
            n = out.frame.agg(*[F.count_if(c).alias(c) for c in flags]).first()
            report(fixed.STEP_NAMES["outliers"], flags, sum(n), detail=f"beyond {recipe.outlier_z} deviations; no row is dropped")
    return out


def report_frame(df: DataFrame, result: Cleaned) -> DataFrame:
    """Operations of a cleaning run as rows."""
    return df.sparkSession.createDataFrame(
        [tuple(o.values()) for o in result.operations],
        "operation string, columns string, changed_cells bigint, conversion_failures bigint,"
        " detail string",
    )
