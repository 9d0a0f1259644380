"""Claims checked against the pages they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, normalize_evidence, numeric_forms, strip

_NUMBER = r"([-+]?\d[\d\s.,]*)"


def _dealt(df: DataFrame, *names: str) -> DataFrame:
    """The columns in partitions of about equal size: the work on a text is far more than
    the reading, and a small file would be one task's."""
    return df.select(*names).hint("rebalance")


def page_numbers(text) -> Column:
    """Every written form of every number of a page, distinct."""
    found = F.regexp_extract_all(normalize_evidence(text), F.lit(_NUMBER), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(found, numeric_forms)))


def _met(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows next to the facts of their page. Facts are many times the size of the columns
    they are made of, which the planner's estimate does not know, so a merge join is asked
    for: no side is ever sent whole through the driver."""
    return rows.join(facts.hint("merge"), "page_id", "left")


def check_values(claims: DataFrame, pages: DataFrame, value: str = "value") -> DataFrame:
    """Adds how (empty, exact, normalized, numeric, none) and supported.

    claims(page_id, value, ...), pages(page_id, text). Page text and number forms
    are prepared once per page, then claims join on page_id.
    """
    facts = _dealt(pages, "page_id", "text").select(
        "page_id", normalize_evidence("text").alias("__hay"), page_numbers("text").alias("__numbers")
    )
    joined = _met(claims, facts)
    text = strip(F.coalesce(F.col(value).cast("string"), F.lit("")))
    plain = normalize_evidence(text)
    bare = strip(F.regexp_replace(plain, "[^0-9a-z؀-ۿ ]+", ""))
    joined = joined.withColumns({"__plain": plain, "__bare": bare, "__forms": numeric_forms(text)})
    how = (
        F.when(F.col("__plain") == "", "empty")
        .when(F.contains("__hay", "__plain"), "exact")
        .when((F.col("__bare") != "") & F.contains("__hay", "__bare"), "normalized")
        .when(
            F.arrays_overlap("__forms", "__numbers")
            | F.exists("__forms", lambda f: F.contains(F.col("__hay"), f)),
            "numeric",
        )
        .otherwise("none")
    )
    return (
        joined.withColumn("how", how)
        .withColumn("supported", F.col("how") != "none")
        .drop("__hay", "__numbers", "__plain", "__bare", "__forms")
    )


def numeric_support(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Claims that share a written number with their page: an equi join on
    (page_id, form) of exploded forms, merged: the forms are more than the planner knows."""
    left = _dealt(claims, *claims.columns).select("*", F.explode(numeric_forms("value")).alias("form"))
    right = _dealt(pages, "page_id", "text").select("page_id", F.explode(page_numbers("text")).alias("form")).distinct()
    return left.join(right.hint("merge"), ["page_id", "form"], "left_semi").drop("form").distinct()


def check_records(records: DataFrame, pages: DataFrame, columns: list[str],
                  row_id: str = "row_id") -> DataFrame:
    """Records with unsupported cells set to null; records left with nothing drop.

    The page meets a record once; all its cells are checked in that row.
    """
    facts = _dealt(pages, "page_id", "text").select(
        "page_id", normalize_evidence("text").alias("__hay"), page_numbers("text").alias("__numbers")
    )
    joined = _met(records, facts)

    def kept(c):
        text = strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
        forms = numeric_forms(text)
        ok = let(
            normalize_evidence(text),
            lambda p: let(
                strip(F.regexp_replace(p, "[^0-9a-z؀-ۿ ]+", "")),
                lambda bare: (p == "")
                | F.contains(F.col("__hay"), p)
                | ((bare != "") & F.contains(F.col("__hay"), bare))
                | let(
                    forms,
                    lambda f: F.arrays_overlap(f, F.col("__numbers"))
                    | F.exists(f, lambda x: F.contains(F.col("__hay"), x)),
                ),
            ),
        )
        return F.when(F.coalesce(ok, F.lit(False)), F.col(c))

    checked = joined.withColumns({f"__ok_{c}": kept(c) for c in columns})
    blanked = F.lit(0)
    for c in columns:
        blanked = blanked + (F.col(c).isNotNull() & F.col(f"__ok_{c}").isNull()).cast("int")
    checked = checked.withColumn("blanked_cells", blanked)
    checked = checked.withColumns({c: F.col(f"__ok_{c}") for c in columns})
    left = F.lit(False)
    for c in columns:
        left = left | (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return checked.where(left).drop("__hay", "__numbers", *[f"__ok_{c}" for c in columns])


def evidence_ratio(claims: DataFrame, pages: DataFrame, proposal: str = "proposal_id",
                   threshold: float = 0.5, max_chars: int | None = None) -> DataFrame:
    """(proposal, n_values, ratio, accepted): share of non-blank values that occur in
    the page, whole or, if asked, by their first max_chars characters. A proposal
    without a value has ratio 0."""
    facts = _dealt(pages, "page_id", "text").select("page_id", normalize_evidence("text").alias("__hay"))
    values = claims.withColumn("__v", F.lower(strip(F.coalesce(F.col("value").cast("string"), F.lit("")))))
    joined = _met(values, facts)
    asked = F.col("__v") if max_chars is None else F.substring("__v", 1, max_chars)
    hit = F.coalesce(F.contains("__hay", asked), F.lit(False)).cast("int")
    given = F.col("__v") != ""
    return joined.groupBy(proposal).agg(
        F.count_if(given).alias("n_values"), F.coalesce(F.avg(F.when(given, hit)), F.lit(0.0)).alias("ratio")
    ).withColumn("accepted", F.col("ratio") >= threshold)


def usage_totals(log: DataFrame) -> DataFrame:
    """Model calls and tokens per run and purpose of a usage log."""
    return log.groupBy("run_id", "purpose").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
