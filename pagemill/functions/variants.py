"""Nested JSON as VARIANT: record arrays, paths, flattening.

Every function here is a chain of projections on one row per document; nothing is
exploded or shuffled. What depends on all levels comes from json_walk, whatever the
depth; values are picked natively.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed, json_walk
from .text import col, strip


def as_map(v) -> Column:
    return F.try_variant_get(col(v), "$", "map<string,variant>")


def as_array(v) -> Column:
    return F.try_variant_get(col(v), "$", "array<variant>")


def is_object(v) -> Column:
    # a shallow cast; a schema would be derived from everything below
    return as_map(v).isNotNull()


def is_list(v) -> Column:
    return as_array(v).isNotNull()


def is_scalar(v) -> Column:
    return ~is_object(v) & ~is_list(v)


def scalar_text(v) -> Column:
    """Text of a scalar; JSON text of anything nested; null for JSON null."""
    return F.when(is_scalar(v), F.try_variant_get(col(v), "$", "string")).otherwise(
        F.to_json(col(v))
    )


def json_path(path: str | None) -> str:
    """`a.b[0].c` as a VARIANT path."""
    if not path or path == "$":
        return "$"
    steps = re.findall(r"\[(\d+)\]|([^.\[\]]+)", path)
    return "$" + "".join(f"[{i}]" if i else f"['{k}']" for i, k in steps)


def resolve_path(v, path: str | None, as_type: str = "variant") -> Column:
    """Value at a dotted path, null when absent."""
    return F.try_variant_get(col(v), json_path(path), as_type)


def _nothing(kind: str) -> Column:
    return F.array().cast(kind)


def find_record_arrays(df: DataFrame, v: str, out: str = "arrays",
                       where: Column | None = None, depth: int | None = None,
                       list_items: int | None = None, limit: int | None = None) -> DataFrame:
    """Arrays of objects inside a document, the most useful first.

    Adds array<struct<path, steps, n, keys>>; `objects_of` picks the objects of one. An
    array qualifies with two or more objects that make up at least 60 percent of its
    items. Documents outside `where` are not searched. Levels below `depth`, items of a list after the first list_items and
    arrays after the best `limit` are left out only if these are given.
    """
    searched = F.col(v) if where is None else F.when(where, F.col(v))
    found = json_walk.record_arrays(searched, depth, list_items, limit)
    return df.withColumn(out, F.coalesce(found, _nothing(json_walk.ARRAYS)))


def objects_of(v, array: Column) -> Column:
    """The objects of an array that find_record_arrays found in v."""
    return F.filter(as_array(json_walk.at_steps(col(v), array["steps"])), is_object)


def records_of(df: DataFrame, v: str, path: str | None = None, out: str = "records") -> DataFrame:
    """Record list of a document: array<variant>.

    An explicit path that holds a list is final, even when the list is empty.
    Otherwise: the document's own objects, its scalars as {"value": x}, the best
    record array, or the document itself.
    """
    node = resolve_path(v, path) if path else F.col(v)
    df = df.withColumn("__items", as_array(node))
    items = F.col("__items")
    df = df.withColumn("__objects", F.filter(items, is_object))
    objects = F.col("__objects")
    plain = (F.size(objects) == 0) & (F.size(items) > 0) & ~F.exists(items, is_list)  # scalars alone
    settled = (F.lit(bool(path)) & items.isNotNull()) | (F.size(objects) > 0) | plain
    df = find_record_arrays(df, v, "__arrays", ~F.coalesce(settled, F.lit(False)), limit=1)  # the best of all
    values = F.transform(
        items, lambda x: F.parse_json(F.concat(F.lit('{"value":'), F.to_json(x), F.lit("}")))
    )
    best = objects_of(v, F.get(F.col("__arrays"), F.lit(0)))
    rows = (
        F.when(F.lit(bool(path)) & items.isNotNull(), objects)
        .when(F.size(objects) > 0, objects)
        .when(plain, values)
        .when(best.isNotNull(), best)
        .when(is_object(v), F.array(F.col(v)))
        .otherwise(_nothing("array<variant>"))
    )
    return df.withColumn(out, rows).drop("__arrays", "__items", "__objects")


def flatten_record(df: DataFrame, v: str, out: str = "record", depth: int | None = None,
                   list_items: int | None = None) -> DataFrame:
    """One nested record as a flat map<string,string>.

    Objects join their names with '.'; a list of scalars becomes its values; the items of
    a list of objects are numbered (`name.0.key`). Objects and lists below `depth` levels
    are JSON text, and items after the first list_items are left out, only if these are
    given.
    """
    return df.withColumn(out, F.coalesce(json_walk.leaves(F.col(v), depth, list_items), F.create_map().cast("map<string,string>")))


def describe_payload(df: DataFrame, v: str, out: str = "payload") -> DataFrame:
    """struct<records_path, keys, n> of a document: its best record array, or
    the top-level keys, or the length of a plain list."""
    df = find_record_arrays(df, v, "__arrays", limit=1)  # the best of all
    best = F.get(F.col("__arrays"), F.lit(0))
    return df.withColumn(
        out,
        F.struct(
            F.when(best["path"] != "$", best["path"]).alias("records_path"),
            F.coalesce(
                best["keys"],
                F.map_keys(as_map(v)),
                F.array().cast("array<string>"),
            ).alias("keys"),
            F.coalesce(best["n"], F.size(as_array(v)).cast("bigint")).alias("n"),
        ),
    ).drop("__arrays")


def cursor_field(v) -> Column:
    """Path of the first scalar, non-blank next-page key, top level first, then
    inside the usual containers (which may nest)."""

    def usable(x):
        return F.schema_of_variant(x).isin("STRING", "BIGINT", "BOOLEAN") & (
            strip(F.try_variant_get(x, "$", "string")) != ""
        )

    def key_in(m):
        hits = F.map_keys(F.map_filter(m, lambda k, x: k.rlike(fixed.CURSOR_KEY) & usable(x)))
        return F.get(F.array_sort(hits), F.lit(0))

    def containers(paths):
        return [p + [c] for p in paths for c in fixed.CURSOR_CONTAINERS]

    first = containers([[]])
    second = containers(first)
    options = [key_in(as_map(v))]
    for one in first:
        inside = key_in(resolve_path(v, ".".join(one), "map<string,variant>"))
        options.append(F.concat(F.lit(".".join(one) + "."), inside))
        for two in [s for s in second if s[0] == one[0]]:
            inner = key_in(resolve_path(v, ".".join(two), "map<string,variant>"))
            options.append(F.concat(F.lit(".".join(two) + "."), inner))
    return F.coalesce(*options)


def type_names(df: DataFrame, v: str, out: str = "types", depth: int | None = None,
               where: Column | None = None) -> DataFrame:
    """Distinct '@type' (else 'type') texts of all levels, or of the first `depth`, sorted."""
    searched = F.col(v) if where is None else F.when(where, F.col(v))
    return df.withColumn(out, F.coalesce(json_walk.type_texts(searched, depth), _nothing("array<string>")))


def api_score(url, keys: Column, n: Column) -> Column:
    """How promising a JSON address is, between 0.05 and 0.97."""
    keys = F.coalesce(keys, F.array().cast("array<string>"))
    score = (
        F.lit(0.4)
        + F.when(col(url).rlike(fixed.API_PATH_HINT), 0.2).otherwise(0.0)
        + F.coalesce(F.least(n / 50.0, F.lit(1.0)) * 0.2, F.lit(0.0))
        + F.least(F.size(keys) / 8.0, F.lit(1.0)) * 0.15
        + F.when(F.exists(keys, lambda k: k.rlike(fixed.DATASET_KEY_HINT)), 0.05).otherwise(0.0)
    )
    return F.greatest(F.lit(0.05), F.least(score, F.lit(0.97)))


def classify_payload(df: DataFrame, text: str, depth: int | None = None) -> DataFrame:
    """Adds kind (records, html, text, empty) and records (array<variant>) for a
    text payload that may be JSON, fenced JSON, markup or prose. Rows are looked for below
    the usual wrapper keys, at most `depth` of them if it is given."""
    body = strip(F.coalesce(F.col(text), F.lit("")))
    fenced = strip(
        F.regexp_replace(F.regexp_replace(body, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    )
    body_or_fence = F.when(F.startswith(body, F.lit("```")), fenced).otherwise(body)
    df = df.withColumn(
        "__doc",
        F.when(body_or_fence.rlike(r"^[{\[]"), F.try_parse_json(body_or_fence)),
    )
    df = df.withColumn("__steps", json_walk.steps_to_rows(F.when(is_object("__doc"), F.col("__doc")), depth))
    df = df.withColumn("__rows", json_walk.at_steps(F.col("__doc"), F.col("__steps")))
    items = as_array("__doc")
    nested = F.size(F.filter(items, lambda x: ~is_scalar(x)))
    objects = F.size(F.filter(items, is_object))
    rows = (
        F.when((F.size(items) > 0) & (objects == F.size(items)), items)
        .when(
            (F.size(items) > 0) & (nested == 0),
            F.transform(
                items, lambda x: F.parse_json(F.concat(F.lit('{"value":'), F.to_json(x), F.lit("}")))
            ),
        )
        .when(items.isNull() & F.col("__rows").isNotNull(), F.coalesce(as_array("__rows"), F.array("__rows")))
    )
    df = df.withColumn("records", F.coalesce(rows, _nothing("array<variant>")))
    kind = (
        F.when(body == "", "empty")
        .when(F.size("records") > 0, "records")
        .when(F.col("__doc").isNotNull(), "empty")
        .when(body.rlike(fixed.HTML_HINT), "html")
        .otherwise("text")
    )
    return df.withColumn("kind", kind).drop("__doc", "__steps", "__rows")
