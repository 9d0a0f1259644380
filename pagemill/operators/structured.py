"""Structured data in pages: JSON-LD, embedded JSON, application state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, variants
from ..functions.text import built_once, each, strip

_SCRIPT = r"(?is)(<script\b[^>]*>.*?</script\s*>)"


@built_once
def _scripts(html="html") -> Column:
    return F.transform(
        F.regexp_extract_all(F.col(html), F.lit(_SCRIPT), F.lit(1)),
        lambda s: F.struct(
            F.lower(strip(F.regexp_extract(s, r"(?is)^<script\b[^>]*?\btype\s*=\s*[\"']?([^\"'\s>]*)", 1)))
            .alias("type"),
            F.regexp_extract(s, r"(?is)^<script\b[^>]*?\bid\s*=\s*[\"']?([^\"'\s>]*)", 1).alias("id"),
            strip(F.regexp_extract(s, r"(?is)^<script\b[^>]*>(.*)</script\s*>$", 1)).alias("body"),
        ),
    )


def json_ld_documents(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, doc): parsed JSON-LD scripts; broken JSON is skipped."""
    bodies = F.transform(
        F.filter(_scripts(), lambda s: s["type"] == "application/ld+json"), lambda s: s["body"]
    )
    rows = each(pages, bodies, "ordinal", "body")
    return rows.select("page_id", "ordinal", F.try_parse_json("body").alias("doc")).where(
        "doc is not null"
    )


@built_once
def embedded_array(html: str = "html") -> Column:
    """array<struct<name,source,body>>: JSON scripts, then application state."""
    scripts = F.transform(
        F.filter(
            _scripts(html),
            lambda s: (s["type"].isin(fixed.JSON_SCRIPT_TYPES) | (s["id"] == "__NEXT_DATA__"))
            & (s["body"] != ""),
        ),
        lambda s: F.struct(
            F.when(s["id"] != "", s["id"]).otherwise("inline_json").alias("name"),
            F.lit("script_json").alias("source"),
            s["body"].alias("body"),
        ),
    )
    states = F.array(
        *[
            F.struct(
                F.lit("app_state").alias("name"),
                F.lit("window_state").alias("source"),
                F.regexp_extract(html, rf"(?s)window\.{name}\s*=\s*(\{{.*?\}});", 1).alias("body"),
            )
            for name in fixed.STATE_NAMES
        ]
    )
    return F.concat(scripts, F.filter(states, lambda s: s["body"] != ""))


@built_once
def json_ld_array(html: str = "html") -> Column:
    """array<string>: bodies of the JSON-LD scripts that parse."""
    bodies = F.transform(
        F.filter(_scripts(html), lambda s: s["type"] == "application/ld+json"), lambda s: s["body"]
    )
    return F.filter(bodies, lambda b: F.try_parse_json(b).isNotNull())


def embedded_documents(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, name, source, doc): JSON scripts and application state."""
    rows = each(pages, embedded_array(), "ordinal", "b")
    return rows.select(
        "page_id", "ordinal", "b.name", "b.source", F.try_parse_json("b.body").alias("doc")
    ).where("doc is not null")


def _ld_items(doc: str) -> Column:
    """Objects of a JSON-LD document: lists and @graph opened."""
    items = F.coalesce(variants.as_array(doc), F.array(F.col(doc)))

    def expand(item):
        graph = variants.as_array(variants.as_map(item)["@graph"])
        return F.when(graph.isNotNull(), graph).otherwise(F.array(item))

    return F.filter(F.flatten(F.transform(items, expand)), variants.is_object)


def json_ld_records(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, item_idx, record): lists and @graph expanded, flattened."""
    rows = each(json_ld_documents(pages), _ld_items("doc"), "item_idx", "item")
    return variants.flatten_record(rows, "item").select("page_id", "ordinal", "item_idx", "record")


def _first_arrays(docs: DataFrame) -> DataFrame:
    """Of every page, the first document with a record array. The rank limit runs
    before the exchange."""
    found = variants.find_record_arrays(docs, "doc").where(F.size("arrays") > 0)
    w = Window.partitionBy("page_id").orderBy("ordinal")
    first = found.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return first.withColumn("best", F.get("arrays", F.lit(0)))


def embedded_records(pages: DataFrame) -> DataFrame:
    """(page_id, path, item_idx, record) from the first blob of a page that holds
    a record array."""
    chosen = _first_arrays(embedded_documents(pages)).select(
        "page_id", F.col("best.path").alias("path"), variants.objects_of("doc", F.col("best")).alias("objects")
    )
    rows = each(chosen, F.col("objects"), "item_idx", "item").drop("objects")
    return variants.flatten_record(rows, "item").select("page_id", "path", "item_idx", "record")


def structured_records(pages: DataFrame) -> DataFrame:
    """JSON-LD records; pages without any fall back to embedded JSON.

    The page is read once: its documents of the kind that applies become rows,
    and every document yields its own record list.
    """
    linked = F.transform(
        json_ld_array(), lambda b: F.struct(F.lit("json_ld").alias("kind"), b.alias("body"))
    )
    other = F.transform(
        embedded_array(), lambda b: F.struct(F.lit("embedded").alias("kind"), b["body"].alias("body"))
    )
    pages = pages.withColumn("__ld", linked)
    docs = each(
        pages, F.when(F.size("__ld") > 0, F.col("__ld")).otherwise(other), "ordinal", "d"
    ).select("page_id", "ordinal", "d.kind", F.try_parse_json("d.body").alias("doc")).where(
        "doc is not null"
    )
    is_linked = F.col("kind") == "json_ld"
    found = variants.find_record_arrays(docs, "doc", where=~is_linked)
    best = variants.objects_of("doc", F.get("arrays", F.lit(0)))
    lists = found.withColumn(
        "objects", F.when(is_linked, _ld_items("doc")).otherwise(best)
    ).where(F.size("objects") > 0).drop("doc", "arrays")
    w = Window.partitionBy("page_id", "kind").orderBy("ordinal")
    first = lists.withColumn("__r", F.row_number().over(w)).where(is_linked | (F.col("__r") == 1))
    rows = each(first.drop("__r"), F.col("objects"), "item_idx", "item").drop("objects")
    return variants.flatten_record(rows, "item").select(
        "page_id", F.col("kind").alias("source"), "item_idx", "record"
    )


def structured_types(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """(page_id, types): distinct @type names of a page's JSON-LD, sorted; the first
    `limit` of them if that is given."""
    per_doc = variants.type_names(json_ld_documents(pages), "doc")
    types = F.array_sort(F.collect_set("t"))
    return (
        per_doc.select("page_id", F.explode("types").alias("t")).distinct()
        .groupBy("page_id")
        .agg((types if limit is None else F.slice(types, 1, limit)).alias("types"))
    )
