"""Title, text and article record of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import each, let, page_title, squash
from ..sources import html as H


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", page_title("html").alias("title"))


def article_record(dom="dom", url="url") -> Column:
    """One article per page: title, metadata and main text.

    Text is taken from the first <article>, else <main>, else the page, without
    navigation, footers, headers, asides and scripts.
    """
    texts, zones = F.col(dom)["texts"], F.col(dom)["zones"]
    landmarks = F.filter(
        F.col(dom)["nodes"],
        lambda n: n["tag"].isin("h1", "title", "article", "main")
        & (F.coalesce(F.get(zones, n["text_from"]), F.lit(0)) == 0),
    )

    def first(marks, tag):
        return F.get(F.filter(marks, lambda n: n["tag"] == tag), F.lit(0))

    def text_between(start, stop):
        kept = F.transform(
            F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.when(F.get(zones, i) == 0, F.get(texts, i)),
        )
        return squash(F.array_join(kept, ""))

    def record(marks, metas):
        def meta(*names):
            def value(name):
                found = F.try_element_at(
                    F.filter(metas, lambda m: m["name"] == name), F.lit(-1)
                )["content"]
                return F.when(found != "", found)

            return F.coalesce(*[value(n) for n in names])

        def finished(x):
            return F.struct(
                F.col(url).alias("url"),
                x["title"].alias("title"),
                meta("author", "article:author").alias("author"),
                meta("article:published_time", "date").alias("date"),
                meta("description", "og:description").alias("description"),
                meta("og:site_name").alias("sitename"),
                x["body"].alias("text"),
                F.length(x["body"]).cast("bigint").alias("text_chars"),
            )

        def text_parts(m):
            return F.struct(
                F.when(
                    m["heading"].isNotNull(), H.node_text(m["heading"], dom)
                ).alias("title"),
                text_between(
                    F.coalesce(m["main"]["text_from"], F.lit(0)),
                    F.coalesce(m["main"]["text_to"], F.size(texts)),
                ).alias("body"),
            )

        chosen = F.struct(
            F.coalesce(first(marks, "h1"), first(marks, "title")).alias("heading"),
            F.coalesce(first(marks, "article"), first(marks, "main")).alias("main"),
        )
        return let(let(chosen, text_parts), finished)

    metas = F.transform(
        F.filter(H.nodes_of(dom, "meta"), lambda n: n["attrs"]["content"].isNotNull()),
        lambda n: F.struct(
            F.lower(F.coalesce(n["attrs"]["name"], n["attrs"]["property"], F.lit(""))).alias("name"),
            n["attrs"]["content"].alias("content"),
        ),
    )
    return let(landmarks, lambda marks: let(metas, lambda ms: record(marks, ms)))


def articles(dom_pages: DataFrame) -> DataFrame:
    """One record per page with readable text."""
    return (
        each(dom_pages, F.array(article_record()), "__i", "a")
        .select("page_id", "a.*")
        .where(F.col("text") != "")
    )
