"""Requested fields matched to the columns of many datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import col, strip


def normalize_name(c) -> Column:
    cleaned = F.regexp_replace(F.lower(strip(col(c))), "[^0-9a-z؀-ۿ]+", "_")
    return F.regexp_replace(cleaned, "^_+|_+$", "")


def _synonyms() -> dict[str, list[str]]:
    table: dict[str, list[str]] = {}
    for phrase, (name, _) in fixed.FIELD_TERMS.items():
        table.setdefault(name, []).append(phrase)
    return table


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def match_fields(catalog: DataFrame, requested: list[str]) -> DataFrame:
    """(dataset_id, requested, matched_column, method, confidence, needs_review).

    catalog(dataset_id, column, ordinal) may list millions of datasets. The
    requested names are a short literal list carried in every row, so a catalog
    row is scored once against each of them without any join; the best column
    per (dataset, request) is a minimum, folded before the exchange. The catalog is dealt
    evenly first: the fold sorts in memory all that its task was given.
    """
    synonyms = _synonyms()
    catalog = catalog.hint("rebalance").withColumn("__key", normalize_name("column"))
    key = F.col("__key")

    def rank(name):
        target = normalize_name(F.lit(name))
        others = [normalize_name(F.lit(p)) for p in synonyms.get(name, [])]
        is_synonym = F.lit(False)
        for o in others:
            is_synonym = is_synonym | (key == o)
        score = similarity(key, target)
        return (
            F.when(key == target, F.struct(F.lit(1).alias("m"), F.lit(0.0).alias("d")))
            .when(is_synonym, F.struct(F.lit(2).alias("m"), F.lit(0.0).alias("d")))
            .when(
                F.startswith(key, target)
                | F.array_contains(F.split(key, "_"), target)
                | ((key != "") & F.contains(target, key)),
                F.struct(F.lit(3).alias("m"), F.lit(0.0).alias("d")),
            )
            .when(score >= 0.82, F.struct(F.lit(4).alias("m"), (-score).alias("d")))
        )

    options = F.array(
        *[F.struct(F.lit(r).alias("requested"), rank(r).alias("rank")) for r in requested]
    )
    scored = catalog.select("dataset_id", "column", "ordinal", F.explode(options).alias("o"))
    best = scored.groupBy("dataset_id", F.col("o.requested").alias("requested")).agg(
        F.min(
            F.when(
                F.col("o.rank").isNotNull(),
                F.struct(F.col("o.rank.m").alias("m"), F.col("o.rank.d").alias("d"), "ordinal", "column"),
            )
        ).alias("b")
    )
    method = F.get(
        F.array(*[F.lit(x) for x in ("exact", "synonym", "substring", "fuzzy")]), F.col("b.m") - 1
    )
    conf = F.when(F.col("b.m") <= 2, "high").when(F.col("b.m") == 3, "medium").otherwise("low")
    return best.select(
        "dataset_id", "requested", F.col("b.column").alias("matched_column"),
        F.coalesce(method, F.lit("none")).alias("method"), conf.alias("confidence"),
        (conf == "low").alias("needs_review"),
    )


def mapping_guard(proposed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Proposed (dataset_id, requested, column) pairs whose column exists."""
    return proposed.join(
        catalog.select("dataset_id", "column"), ["dataset_id", "column"], "left_semi"
    )
