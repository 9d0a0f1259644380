"""Repeated passages of lines, removed by overlapping windows of three lines.

A text is split at line feeds. Every three consecutive lines form a window, unless
none of the three has a word. Windows are compared over the whole table by a
128-bit digest. Of a window met more than once, the first occurrence in order of
(document id, text digest, position) stays; all others are covered. Covered
positions of a document are merged to runs, and the lines of these runs go.

Texts of fewer than three lines have no window and stay as they are. A null text
stays null; an empty text stays empty. Rows with equal id and equal text are one
document and lose the same lines. A null id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest of the text, position, two hashes) of every window; no text."""
    start = F.size("_lines") - (WINDOW - 1)
    made = F.filter(
        F.transform(
            F.when(start >= 1, F.sequence(F.lit(1), start)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(i.alias("at"), F.slice("_lines", i, WINDOW).alias("w")),
        ),
        lambda x: F.exists(x["w"], lambda line: line.rlike(HAS_WORD)),
    )
    hashed = F.transform(
        made, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["w"]).alias("a"), F.xxhash64(F.lit(1), x["w"]).alias("b"))
    )
    return (
        docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_t"), _lines(F.col(text)).alias("_lines"))
        .select("_id", "_t", F.explode(hashed).alias("w"))
        .select("_id", "_t", "w.at", "w.a", "w.b")
    )


def covered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest of the text, sorted positions) of later occurrences."""
    every = windows(docs, key, text)
    place = F.struct("_id", "_t", "at")
    # folded before the exchange, so a frequent window travels once for each task
    first = every.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = every.join(first.select("a", "b", "first"), ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("_id", "_t").agg(F.array_sort(F.collect_set("at")).alias("_at"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the remaining text, and `n_lines`, `n_removed` (lines before, lines
    gone). Columns of docs with these names are replaced."""
    at = covered(docs, key, text)
    base = docs.drop("n_lines", "n_removed")
    # the row travels as one value, so none of its columns can clash with ours
    whole = base.select(
        F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), F.col(key).alias("_key"),
        F.xxhash64(text).alias("_hash"),
    )
    joined = whole.join(at, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_t")), "left")
    body = F.col("row")[text]
    # runs of covered lines, and the slices between them
    begins = F.filter("_at", lambda p, k: F.coalesce(p - F.get("_at", k - 1) > WINDOW, F.lit(True)))
    ends = F.filter("_at", lambda p, k: F.coalesce(F.get("_at", k + 1) - p > WINDOW, F.lit(True)))
    runs = joined.select(
        "row", _lines(body).alias("_lines"), begins.alias("_begin"),
        F.transform(ends, lambda p: p + (WINDOW - 1)).alias("_end"),
    )
    count = F.size("_lines")
    slices = F.transform(
        F.sequence(F.lit(0), F.size("_begin")),
        lambda k: F.struct(
            (F.coalesce(F.get("_end", k - 1), F.lit(0)) + 1).alias("from"),
            (F.coalesce(F.get("_begin", k), count + 1) - F.coalesce(F.get("_end", k - 1), F.lit(0)) - 1).alias("n"),
        ),
    )
    left = F.flatten(F.transform(slices, lambda s: F.slice("_lines", s["from"], s["n"])))
    cut = runs.withColumn("_left", F.when(F.col("_begin").isNotNull(), left))
    final = F.when(F.col("_left").isNotNull(), F.array_join("_left", "\n")).otherwise(body)
    return cut.select(
        *[final.alias(c) if c == text else F.col("row")[c].alias(c) for c in base.columns],
        F.when(body.isNull(), 0).otherwise(count).cast("bigint").alias("n_lines"),
        F.coalesce(count - F.size("_left"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
