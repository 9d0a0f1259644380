"""Registry and inputs shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources import html as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dom(spark, folder) -> DataFrame:
    """The page table, parsed."""
    return H.shred_html(table(spark, folder, "pages"))


def joined(rows: DataFrame, keys: list[str], order: str, text) -> DataFrame:
    """(keys..., body): texts of a bounded block of rows, in order."""
    return rows.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))),
                lambda x: x["t"],
            ),
            "",
        ).alias("body")
    )


def block(column: str, size: int):
    """Blocks of `size` consecutive keys: groups that never grow with the table."""
    return F.floor(F.col(column) / size).cast("bigint")


# links of the given pages, as the oracle reads them
SQL_LINKS = """
links AS (
  SELECT page_id, url,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS raw,
    CAST(unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS INTEGER) AS ordinal
  FROM pages),
abs_links AS (
  SELECT page_id, url, ordinal,
    regexp_extract(url, '^(https?://[^/?#]*)', 1) || replace(href, '&amp;', '&') AS link,
    trim(regexp_replace(replace(raw, '&amp;', '&'), '\\s+', ' ', 'g')) AS text
  FROM links WHERE href LIKE '/%')
"""


def sql_canonical(url: str) -> str:
    """Canonical form of the URLs of the page table, in SQL."""
    kept = (
        f"array_to_string(list_filter(string_split(regexp_extract({url}, '\\?([^#]*)', 1), '&'),"
        " lambda x: x <> '' AND NOT regexp_matches(lower(x),"
        " '^(utm_|fbclid|gclid|mc_cid|mc_eid|igshid|ref_src)')), '&')"
    )
    path = f"regexp_extract({url}, '^https?://[^/?#]*([^?#]*)', 1)"
    return (
        f"(lower(regexp_extract({url}, '^(https?://[^/?#]*)', 1))"
        f" || CASE WHEN {path} IN ('', '/') THEN '/' ELSE rtrim({path}, '/') END"
        f" || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"
    )


# character references of the page table; a reference may lack its semicolon
SQL_TEXT = (
    "trim(regexp_replace(regexp_replace(regexp_replace(replace(replace({0}, '&copy;', '©'),"
    " '&middot;', '·'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"
)
