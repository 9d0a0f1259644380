"""Pagination plans from addresses, parsed pages and API payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls, variants
from ..functions.text import built_once, let, strip
from ..sources import html as H


@built_once
def plan_from_html(dom: str = "dom", html: str = "html", base: str = "url") -> Column:
    """First evidence in a page: rel=next, a next link, numbered links, a
    load-more control, an infinite-scroll hint. Null without any."""
    address = F.col(base)
    cast = lambda c: c.cast(urls.PLAN)

    def paged(url, source, conf):
        return let(
            url,
            lambda u: F.when(
                urls.page_param(u).isNotNull(),
                cast(urls.plan("page_number", urls.page_param(u)["key"], 1, 1, urls.page_template(u),
                               source=source, confidence=conf)),
            ),
        )

    rel = F.get(
        F.filter(
            H.nodes_of(dom, "link", "a"),
            lambda n: (n["attrs"]["rel"] == "next") & (F.coalesce(n["attrs"]["href"], F.lit("")) != ""),
        ),
        F.lit(0),
    )
    by_rel = let(
        rel,
        lambda n: F.when(
            n.isNotNull(),
            cast(urls.plan("next_link", selector="[rel=next]",
                           template=urls.resolve_url(address, n["attrs"]["href"]),
                           source="rel_next", confidence="high")),
        ),
    )
    anchors = F.transform(
        F.filter(H.nodes_of(dom, "a"), lambda n: n["attrs"]["href"].isNotNull()),
        lambda n: F.struct(
            strip(H.raw_text(n, dom)).alias("text"), F.lower(n["class"]).alias("cls"),
            urls.resolve_url(address, n["attrs"]["href"]).alias("url"),
        ),
    )

    def from_anchors(links):
        following = F.get(
            F.filter(
                links,
                lambda a: a["text"].rlike(fixed.NEXT_TEXT) | F.contains(a["cls"], F.lit("next")),
            ),
            F.lit(0),
        )
        by_next = let(
            following,
            lambda a: F.when(
                a.isNotNull(),
                F.coalesce(
                    paged(a["url"], "next_link_query", "high"),
                    cast(urls.plan("next_link", selector="a[rel=next], a.next", template=a["url"],
                                   source="next_link_text", confidence="medium")),
                ),
            ),
        )
        numbered = F.array_sort(
            F.transform(
                F.filter(links, lambda a: a["text"].rlike(r"^\d{1,4}$")),
                lambda a: F.struct(a["text"].cast("int").alias("n"), a["url"].alias("url")),
            )
        )

        def by_path(u):
            pattern = r"/(page|p)/\d+/?$"
            return F.when(
                urls.part(u, 3).rlike(pattern),
                cast(urls.plan("page_number", "page", 1, 1,
                               F.regexp_replace(u, pattern, "/$1/{page}"),
                               source="numbered_path", confidence="medium")),
            )

        by_number = let(
            numbered,
            lambda ns: F.when(
                F.size(ns) >= 2,
                let(
                    F.element_at(ns, -1)["url"],
                    lambda u: F.coalesce(paged(u, "numbered_links", "medium"), by_path(u)),
                ),
            ),
        )
        return F.coalesce(by_next, by_number)

    more = F.get(
        F.filter(
            H.nodes_of(dom, "button", "a"), lambda n: H.raw_text(n, dom).rlike(fixed.LOAD_MORE_TEXT)
        ),
        F.lit(0),
    )
    by_more = let(
        more,
        lambda n: F.when(
            n.isNotNull(),
            cast(urls.plan(
                "load_more",
                selector=F.concat_ws(".", n["tag"], F.get(H.class_list(n), F.lit(0))),
                source="load_more_button", confidence="medium")),
        ),
    )
    by_hint = F.when(
        F.col(html).rlike(fixed.INFINITE_HINT),
        cast(urls.plan("infinite_scroll", source="infinite_scroll_hint", confidence="low")),
    )
    return F.coalesce(by_rel, let(anchors, from_anchors), by_more, by_hint)


def pagination_plans(dom_pages: DataFrame) -> DataFrame:
    """(page_id, url, plan...): the address decides first, then the page."""
    none = urls.plan("none").cast(urls.PLAN)
    plan = F.coalesce(urls.plan_from_url("url").cast(urls.PLAN), plan_from_html(), none)
    return dom_pages.select("page_id", "url", F.explode(F.array(plan)).alias("p")).select(
        "page_id", "url", "p.*"
    )


def plans_from_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the plan columns for addresses that carry a page or offset parameter."""
    kept = df.columns
    return df.select(*kept, F.explode(F.array(urls.plan_from_url(url))).alias("p")).where(
        "p is not null"
    ).select(*kept, "p.*")


def api_plan(url: str, doc: str) -> Column:
    """Plan of a JSON endpoint: address first, then a cursor key in the payload."""
    cursor = variants.cursor_field(doc)
    return F.coalesce(
        urls.plan_from_url(url).cast(urls.PLAN),
        let(
            cursor,
            lambda c: F.when(
                c.isNotNull(),
                urls.plan("cursor", cursor_path=c, source="api_cursor_field", confidence="medium")
                .cast(urls.PLAN),
            ),
        ),
        urls.plan("none").cast(urls.PLAN),
    )


def next_cursor_url(url, param, cursor) -> Column:
    """Address of the next page: the cursor parameter set, others kept."""
    name = F.regexp_extract(F.coalesce(param, F.lit("cursor")), r"([^.]*)$", 1)
    return urls.set_query_param(url, name, cursor)
