"""Links, files, feeds and endpoints of pages. All are projections of one page
followed by one explode; a page's own list is deduplicated inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls
from ..functions.text import built_once, each, first_per, let, strip
from ..sources import html as H


def _absolute(pairs: Column, base: Column) -> Column:
    skipped = "^(" + "|".join(fixed.SKIPPED_LINK_PREFIXES) + ")"
    kept = F.filter(pairs, lambda p: (strip(p["href"]) != "") & ~strip(p["href"]).rlike(skipped))
    full = F.transform(
        kept,
        lambda p: F.struct(urls.resolve_url(base, p["href"]).alias("url"), p["text"].alias("text")),
    )
    return F.filter(full, lambda p: urls.is_http(p["url"]))


@built_once
def link_array(dom: str = "dom", base: str = "url") -> Column:
    """array<struct<url,text>> of a page's links in page order."""
    pairs = F.transform(
        H.nodes_of(dom, "a"),
        lambda n: F.struct(
            F.coalesce(n["attrs"]["href"], F.lit("")).alias("href"),
            H.node_text(n, dom).alias("text"),
        ),
    )
    return _absolute(pairs, F.col(base))


def page_links(dom_pages: DataFrame, dom: str = "dom") -> DataFrame:
    """(page_id, url, ordinal, link, text): one row per link."""
    return each(dom_pages, link_array(dom), "ordinal", "l").select(
        "page_id", "url", "ordinal", F.col("l.url").alias("link"), F.col("l.text").alias("text")
    )


def distinct_page_links(dom_pages: DataFrame, dom: str = "dom") -> DataFrame:
    """One row per (page, URL): first position, last text. Partial aggregation
    runs before the exchange."""
    return page_links(dom_pages, dom).groupBy("page_id", "link").agg(
        F.min("ordinal").alias("ordinal"), F.max_by("text", "ordinal").alias("text")
    )


def internal_array(links: Column, limit: int | None = None) -> Column:
    """Distinct allowed addresses on the page's own site, in page order."""
    own = F.filter(
        F.array_distinct(F.transform(links, lambda l: l["url"])),
        lambda u: urls.same_site(u, F.col("url")) & urls.is_allowed(u),
    )
    return own if limit is None else F.slice(own, 1, limit)


def internal_links(dom_pages: DataFrame, dom: str = "dom",
                   limit: int | None = None) -> DataFrame:
    return each(dom_pages, internal_array(link_array(dom), limit), "ordinal", "link").select(
        "page_id", "url", "ordinal", "link"
    )


def file_array(links: Column) -> Column:
    """array<struct<url,format,label,kind>> of links that point at files."""
    typed = F.transform(
        links,
        lambda l: F.struct(
            l["url"].alias("url"), l["text"].alias("text"), urls.url_format(l["url"]).alias("format")
        ),
    )
    documents = sorted(set(fixed.DOCUMENT_EXTENSIONS.values()))

    def entry(first):
        label = strip(F.coalesce(first["text"], F.lit("")))
        return F.struct(
            first["url"].alias("url"),
            first["format"].alias("format"),
            F.when(label != "", label)
            .otherwise(F.regexp_extract(urls.part(first["url"], 3), r"([^/]*)$", 1))
            .alias("label"),
            F.when(first["format"].isin(documents), "document").otherwise("data").alias("kind"),
        )

    files = F.filter(typed, lambda l: l["format"].isNotNull() & (l["format"] != "feed"))
    return F.transform(first_per(files, lambda f: f["url"]), entry)


def file_links(dom_pages: DataFrame, dom: str = "dom") -> DataFrame:
    files = let(link_array(dom), file_array)
    return each(dom_pages, files, "ordinal", "f").select("page_id", "f.*")


@built_once
def feed_array(html="html", base="url") -> Column:
    """Feed addresses declared by <link> tags, distinct."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?i)(<link[^>]+>)"), F.lit(1))
    typed = F.filter(
        tags,
        lambda t: F.lower(t).rlike("|".join(x.replace("+", r"\+") for x in fixed.FEED_TYPES))
        & t.rlike(r"(?i)href\s*=\s*[\"']([^\"']+)[\"']"),
    )
    full = F.transform(
        typed,
        lambda t: urls.resolve_url(
            F.col(base), F.regexp_extract(t, r"(?i)href\s*=\s*[\"']([^\"']+)[\"']", 1)
        ),
    )
    return F.array_distinct(F.filter(full, urls.is_allowed))


def feed_links(pages: DataFrame) -> DataFrame:
    return each(pages, feed_array(), "ordinal", "feed_url").select("page_id", "feed_url")


@built_once
def api_url_array(html="html", base="url") -> Column:
    """Endpoint-like URLs quoted in the page, absolute, distinct."""
    raw = F.regexp_extract_all(F.col(html), F.lit(fixed.API_URL_IN_SCRIPT), F.lit(1))
    full = F.transform(raw, lambda u: urls.resolve_url(F.col(base), u))
    good = F.filter(
        full,
        lambda u: urls.is_http(u) & u.rlike(fixed.API_PATH_HINT) & urls.is_allowed(u),
    )
    return F.array_distinct(good)


def api_urls(pages: DataFrame) -> DataFrame:
    """(page_id, api_url, params)."""
    return each(pages, api_url_array(), "ordinal", "api_url").select(
        "page_id", "api_url", urls.query_map("api_url").alias("params")
    )


def verified_first(candidates: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified candidates plus the others whose URL was not verified."""
    rest = candidates.join(verified.select("page_id", "api_url"), ["page_id", "api_url"], "left_anti")
    return verified.withColumn("verified", F.lit(True)).unionByName(
        rest.withColumn("verified", F.lit(False)), allowMissingColumns=True
    )
