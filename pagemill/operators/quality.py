"""Profile, data dictionary, validation and drift.

Counts, extremes and examples of all columns come from one aggregate. Distinct values
are counted by digests. Only top values need a *value census*: the frame unpivoted to
(column, value) and counted, which folds repeated values before the exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, values
from ..functions.text import cut
from .clean import numeric_columns
from .columns import unpivot
from .dedupe import count_duplicates


_EIGHT_BYTES = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.DateType, T.TimestampType, T.TimestampNTZType,
)


def value_census(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n, first_row)."""
    names = columns or df.columns
    cells = df.select(
        F.col(row_id).alias("__row"), *[F.col(f"`{c}`").cast("string").alias(c) for c in names]
    ).unpivot(["__row"], names, "column", "value")
    return cells.groupBy("column", "value").agg(
        F.count("*").alias("n"), F.min("__row").alias("first_row")
    )


def _dtype(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def _lookup(table: dict[str, str], key: str = "column") -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(key)]


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_unique) of columns with a value, exact up to equal digests of 128 bits.

    A cell becomes three numbers: its column's place and a digest. Values of up to eight
    bytes are told apart by one hash, which is one to one for them, so nothing is
    written out as text; others get a second. Repeated cells fold before the exchange.
    """
    names = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema}
    none = F.lit(None).cast("bigint")

    def cell(i, c):
        own = F.col(f"`{c}`")
        if isinstance(kinds[c], _EIGHT_BYTES):
            first, second = F.xxhash64(own), F.lit(0).cast("bigint")
        else:
            text = own.cast("string")
            first, second = F.xxhash64(text), F.xxhash64(F.lit(1), text)
        return F.lit(i), F.when(own.isNotNull(), first).otherwise(none), second

    cells = df.select(F.stack(F.lit(len(names)), *[x for i, c in enumerate(names) for x in cell(i, c)]).alias("i", "a", "b"))
    distinct = cells.where(F.col("a").isNotNull()).distinct()
    place = F.array(*[F.lit(c) for c in names])[F.col("i")]
    return distinct.groupBy("i").agg(F.count("*").alias("n_unique")).select(place.alias("column"), "n_unique")


def profile_columns(df: DataFrame, row_id: str, columns: list[str] | None = None,
                    example_chars: int | None = None) -> DataFrame:
    """One row per column: dtype, missing, missing_pct, n_unique, example, and
    min/max/mean of numbers or first/last of dates. Examples are whole unless
    example_chars is given.

    All but the distinct counts come from one aggregate without an exchange of cells;
    a distinct value travels as a digest of 16 bytes.
    """
    names = columns or df.columns
    numeric = [c for c in numeric_columns(df) if c in names]
    dates = [
        f.name for f in df.schema
        if f.name in names and isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    ]
    none = {"double": F.lit(None).cast("double"), "string": F.lit(None).cast("string")}

    def measured(c):
        own = F.col(f"`{c}`")
        number = own.cast("double")
        return F.struct(
            F.count("*").alias("n_rows"),
            F.count_if(own.isNull()).alias("missing"),
            F.min_by(own, F.when(own.isNotNull(), F.col(row_id))).cast("string").alias("example"),
            (F.min(number) if c in numeric else F.max(none["double"])).alias("min_value"),
            (F.max(number) if c in numeric else F.max(none["double"])).alias("max_value"),
            (F.avg(number) if c in numeric else F.max(none["double"])).alias("mean_value"),
            (F.min(own).cast("string") if c in dates else F.max(none["string"])).alias("first_date"),
            (F.max(own).cast("string") if c in dates else F.max(none["string"])).alias("last_date"),
        )

    one = df.agg(*[measured(c).alias(c) for c in names])
    stats = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}`")[k].alias(k) for k in (
            "n_rows", "missing", "example", "min_value", "max_value", "mean_value", "first_date", "last_date")])
        for c in names
    ])).alias("s")).select("s.*")
    unique = distinct_counts(df, names).withColumnRenamed("column", "__c")
    return stats.join(unique, F.col("column") == F.col("__c"), "left").select(
        "column",
        _lookup(_dtype(df)).alias("dtype"),
        "n_rows", "missing",
        F.bround(F.col("missing") * 100.0 / F.col("n_rows"), 2).alias("missing_pct"),
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        cut(F.coalesce("example", F.lit("")), example_chars).alias("example"),
        "min_value", "max_value", F.bround("mean_value", 4).alias("mean_value"),
        "first_date", "last_date",
    )


def missingness(df: DataFrame) -> DataFrame:
    """(column, missing_pct) with one aggregate over the frame, highest first."""
    shares = df.agg(
        *[
            F.bround(F.count_if(F.col(f"`{c}`").isNull()) * 100.0 / F.count("*"), 2).alias(c)
            for c in df.columns
        ]
    )
    return shares.unpivot([], df.columns, "column", "missing_pct").orderBy(
        F.desc("missing_pct"), "column"
    )


def profile_frame(df: DataFrame, row_id: str, failures: dict[str, int] | None = None,
                  drift: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """One-row quality report over all rows (nothing is sampled)."""
    names = columns or [c for c in df.columns]
    per_column = profile_columns(df, row_id, names)
    keys = [c for c in names if not c.startswith("_") and c != row_id]
    duplicates = count_duplicates(df.select(*keys), keys).select("duplicate_rows").scalar()
    present = F.col("n_rows") - F.col("missing")
    high = (F.col("n_unique") / F.greatest(present, F.lit(1)) > 0.9) & (F.col("n_unique") > 20)
    constant = (F.col("n_unique") == 1) & ~F.startswith("column", F.lit("_"))

    def listed(cond):
        return F.array_sort(F.collect_list(F.when(cond, F.col("column"))))

    report = per_column.agg(
        F.max("n_rows").alias("n_rows"),
        F.count("*").alias("n_columns"),
        F.sum("missing").alias("missing_cells"),
        F.bround(F.sum("missing") * 100.0 / F.sum("n_rows"), 2).alias("missing_pct"),
        listed(constant).alias("constant_columns"),
        listed(high).alias("high_cardinality_columns"),
    ).withColumn("duplicate_rows", duplicates)
    fails = sum((failures or {}).values())
    warnings = F.array_compact(
        F.array(
            F.when(
                F.size("constant_columns") > 0,
                F.concat(F.lit("One value only in: "),
                         F.array_join("constant_columns", ", ")),
            ),
            F.when(
                F.col("duplicate_rows") > 0,
                F.concat(F.format_number("duplicate_rows", 0),
                         F.lit(" rows repeat another row; none was removed.")),
            ),
            F.when(
                F.lit(fails > 0),
                F.lit(f"{fails:,} cells were not converted and kept as text."),
            ),
        )
    )
    return report.withColumns(
        {
            "conversion_failures": F.lit(fails).cast("bigint"),
            "failures": F.create_map(*[F.lit(x) for kv in sorted((failures or {}).items()) for x in kv]).cast("map<string,bigint>"),
            "schema_drift": F.array(*[F.lit(x) for x in drift or []]).cast("array<string>"),
            "warnings": warnings,
        }
    )


@dataclass(frozen=True)
class Field:
    """A requested or documented column."""

    name: str
    dtype: str | None = None
    required: bool = False
    label: str | None = None
    name_source: str = "heuristic"
    notes: str = ""
    min_value: float | None = None
    max_value: float | None = None
    unique: bool = False


def data_dictionary(df: DataFrame, row_id: str, fields: list[Field] = (), source_url: str = "",
                    method: str = "", columns: list[str] | None = None,
                    labels: dict[str, str] | None = None, notes: dict[str, str] | None = None,
                    example_chars: int = 80) -> DataFrame:
    """One row per variable: what it is, where its name comes from, how complete.
    `labels` and `notes` replace those of the specification."""
    stats = profile_columns(df, row_id, columns, example_chars)
    labels, notes = labels or {}, notes or {}
    fields = {f.name: f for f in fields}
    fields.update({c: Field(c) for c in {*labels, *notes} if c not in fields})
    spec = df.sparkSession.createDataFrame(
        [(f.name, labels.get(f.name, f.label), f.name_source if f.dtype or f.label or f.notes or f.name_source != "heuristic"
          else "source_native", notes.get(f.name, f.notes)) for f in fields.values()],
        "column string, spec_label string, spec_source string, spec_notes string",
    )
    # the specification is the caller's short list, a literal relation
    joined = stats.join(F.broadcast(spec), "column", "left")
    own = F.startswith("column", F.lit("_"))
    return joined.select(
        F.col("column").alias("variable"),
        F.coalesce("spec_label", "column").alias("label"),
        "dtype",
        "example",
        "missing_pct",
        F.col("n_unique").alias("unique_count"),
        F.lit(source_url).alias("source"),
        F.lit(method).alias("extraction_method"),
        F.when(own, "source_native").otherwise(F.coalesce("spec_source", F.lit("source_native")))
        .alias("name_source"),
        F.when(own, fixed.PROVENANCE_NOTE)
        .otherwise(F.coalesce("spec_notes", F.lit(""))).alias("notes"),
    )


def dtype_violation(c: str, dtype: str | None) -> Column:
    """True for a non-null value that does not fit the declared type."""
    text = F.col(c).cast("string")
    number = text.try_cast("double")
    bad = {
        "number": number.isNull(),
        "integer": number.isNull() | (number % 1 != 0),
        "date": values.parse_date(text).isNull() & text.try_cast("timestamp").isNull(),
        "url": ~text.rlike("^https?://"),
        "boolean": ~text.isin("true", "false", "True", "False", "0", "1"),
    }.get(dtype, F.lit(False))
    return F.col(c).isNotNull() & bad


def validate(df: DataFrame, fields: list[Field]) -> DataFrame:
    """(column, rule, violations, message) of rules that are broken; advisory.

    All rules except uniqueness are counted in one aggregate; uniqueness counts
    groups of equal values.
    """
    counts: dict[tuple[str, str], Column] = {}
    absent = [f for f in fields if f.name not in df.columns and f.required]
    unique = [f.name for f in fields if f.unique and f.name in df.columns]
    for f in [f for f in fields if f.name in df.columns]:
        number = F.col(f.name).cast("string").try_cast("double")
        if f.required:
            counts[f.name, "required"] = F.count_if(F.col(f.name).isNull())
        if f.dtype and f.dtype != "string":
            counts[f.name, "dtype"] = F.count_if(dtype_violation(f.name, f.dtype))
        if f.min_value is not None:
            counts[f.name, "min"] = F.count_if(number < f.min_value)
        if f.max_value is not None:
            counts[f.name, "max"] = F.count_if(number > f.max_value)
    keys = list(counts)
    parts = []
    if keys:
        one = df.agg(
            F.count("*").alias("__n"), *[counts[k].alias(f"r{i}") for i, k in enumerate(keys)]
        )
        cells = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"),
                         F.col(f"r{i}").alias("violations"))
                for i, (c, rule) in enumerate(keys)
            ],
            F.struct(F.lit("*").alias("column"), F.lit("empty").alias("rule"),
                     F.when(F.col("__n") == 0, 1).otherwise(0).cast("bigint").alias("violations")),
        )
        parts.append(one.select(F.explode(cells).alias("c")).select("c.*"))
    if unique:
        groups = unpivot(df, unique).groupBy("column", "value").agg(F.count("*").alias("n"))
        parts.append(
            groups.groupBy("column").agg(F.sum(F.col("n") - 1).alias("violations"))
            .select("column", F.lit("unique").alias("rule"), "violations")
        )
    if absent:
        parts.append(
            df.sparkSession.createDataFrame(
                [(f.name, "missing_field", 1) for f in absent],
                "column string, rule string, violations bigint",
            )
        )
    result = parts[0]
    for p in parts[1:]:
        result = result.unionAll(p)
    n = F.format_number("violations", 0)
    c = F.concat(F.lit("'"), F.col("column"), F.lit("'"))
    message = (
        F.when(F.col("rule") == "required",
               F.concat(c, F.lit(" is required and lacks a value in "), n, F.lit(" rows")))
        .when(F.col("rule") == "unique",
              F.concat(c, F.lit(" repeats a value "), n, F.lit(" times and should not")))
        .when(F.col("rule") == "missing_field",
              F.concat(c, F.lit(" is required and no column of the data")))
        .when(F.col("rule") == "empty", F.lit("there are no rows to check"))
        .when(F.col("rule") == "min", F.concat(c, F.lit(" is below its lower bound in "), n, F.lit(" rows")))
        .when(F.col("rule") == "max", F.concat(c, F.lit(" is above its upper bound in "), n, F.lit(" rows")))
        .otherwise(F.concat(c, F.lit(" holds another type in "), n, F.lit(" rows")))
    )
    return result.where("violations > 0").withColumn("message", message)


def schema_drift(records: DataFrame, run: str, page: str, ordinal: str,
                 record: str = "record") -> DataFrame:
    """Columns each later page adds to or lacks against the first record of its run.

    Key sets are folded per page before the exchange; pages meet the baseline of
    their run in a join.
    """
    keys = records.select(run, page, F.explode(F.map_keys(record)).alias("key")).distinct()
    per_page = keys.groupBy(run, page).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    first = F.min(F.struct(page, ordinal, F.array_sort(F.map_keys(record)).alias("base"))).alias("b")
    baseline = records.groupBy(run).agg(first).select(
        run, F.col(f"b.{page}").alias("__page"), F.col("b.base").alias("base")
    )
    joined = per_page.join(baseline, run).where(F.col(page) != F.col("__page"))
    return joined.select(
        run, page,
        F.array_sort(F.array_except("keys", "base")).alias("new_columns"),
        F.array_sort(F.array_except("base", "keys")).alias("missing_columns"),
    ).where((F.size("new_columns") > 0) | (F.size("missing_columns") > 0))


def drift_messages(drift: DataFrame, run: str) -> DataFrame:
    """(run, messages): distinct texts."""
    texts = drift.select(
        run,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.size("new_columns") > 0,
                           F.concat(F.lit(fixed.NEW_FIELDS),
                                    F.array_join("new_columns", ", "))),
                    F.when(F.size("missing_columns") > 0,
                           F.concat(F.lit(fixed.ABSENT_FIELDS),
                                    F.array_join("missing_columns", ", "))),
                )
            )
        ).alias("message"),
    ).distinct()
    return texts.groupBy(run).agg(F.array_sort(F.collect_list("message")).alias("messages"))


def run_counters(captures: DataFrame, run: str = "run_id") -> DataFrame:
    """Pages requested and successful, rows and warnings per run."""
    return captures.groupBy(run).agg(
        F.count("*").alias("pages_requested"),
        F.count_if(F.col("status") < 400).alias("pages_successful"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("warning").isNotNull()).alias("warnings"),
    )
