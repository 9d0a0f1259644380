"""Repeated blocks: sibling elements that share a structure become records.

Signatures, groups and item fields are computed inside the page row (no
shuffle): the kids of a node and the descendants of an item are index ranges of
the node list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls, values
from ..functions.text import built_once, confidence, each, first_per, let, strip
from ..sources import html as H


def _sorted_classes(node: Column) -> Column:
    return F.array_join(F.array_sort(H.class_list(node)), " ")


def signature_array(dom: str = "dom", children: int | None = None) -> Column:
    """array<string>: structural fingerprint of every node, two levels deep, from tags,
    sorted classes and all children, or the first `children` of them if that is given.
    A level is hashed before the next is built on it, so a node's text is as long as
    its own list of children."""
    nodes = F.col(dom)["nodes"]

    def first(kids):
        return kids if children is None else F.slice(kids, 1, children)

    def level(own, deeper):
        # children are compared one level less deep than their parent
        return F.transform(
            F.arrays_zip(own.alias("own"), F.transform(nodes, lambda n: n["kids"]).alias("kids")),
            lambda x: F.md5(
                F.concat(x["own"], F.lit("["), F.array_join(F.transform(first(x["kids"]), lambda k: F.get(deeper, k)), "|"), F.lit("]"))
            ),
        )

    return let(
        F.transform(nodes, lambda n: F.concat(n["tag"], F.lit("."), _sorted_classes(n))),
        lambda own: let(level(own, own), lambda one: level(own, one)),
    )


def css_selector(item: Column, parent: Column) -> Column:
    """Short selector for an item: its classes, else its parent's class or id."""

    def classes(n, keep):
        return F.slice(F.filter(H.class_list(n), lambda c: ~c.rlike(r"^\d+$")), 1, keep)

    def dotted(cs):
        return F.array_join(F.transform(cs, lambda c: F.concat(F.lit("."), c)), "")

    own = classes(item, 2)
    outer = classes(parent, 1)
    ident = parent["attrs"]["id"]
    return (
        F.when(F.size(own) > 0, F.concat(item["tag"], dotted(own)))
        .when(F.size(outer) > 0, F.concat(parent["tag"], dotted(outer), F.lit(" > "), item["tag"]))
        .when(F.coalesce(ident, F.lit("")) != "", F.concat(F.lit("#"), ident, F.lit(" > "), item["tag"]))
        .otherwise(item["tag"])
    )


def _slug(text: Column) -> Column:
    cleaned = F.regexp_replace(text, r"[^0-9a-zA-Z؀-ۿ]+", "_")
    cleaned = F.lower(F.regexp_replace(cleaned, "^_+|_+$", ""))
    return cleaned


FIELDS = "array<struct<key:string,value:string>>"


def item_fields(item: Column, dom, base=None) -> Column:
    """Named values of one item as array<struct<key,value>> in field order:
    title, link, image_alt, image_url, date, then labelled elements; the text of
    the item when nothing else is found."""

    def absolute(u):
        return u if base is None else F.when(u.isNotNull(), urls.resolve_url(base, u))

    def field(key, value):
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    def given(c):
        return F.when(c != "", c)

    def landmarks(inside):
        def first(cond):
            return F.get(F.filter(inside, cond), F.lit(0))

        return F.struct(
            first(lambda n: n["tag"].rlike("^h[1-5]$")).alias("heading"),
            first(lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull()).alias("anchor"),
            first(lambda n: n["tag"] == "img").alias("image"),
            first(lambda n: n["tag"] == "time").alias("time"),
        )

    def main_fields(m):
        image, time = m["image"]["attrs"], m["time"]
        title = F.when(m["heading"].isNotNull(), H.node_text(m["heading"], dom)).otherwise(
            given(H.node_text(m["anchor"], dom))
        )
        stamp = F.coalesce(given(time["attrs"]["datetime"]), H.node_text(time, dom))
        return F.filter(
            F.array(
                field("title", title),
                field("link", absolute(m["anchor"]["attrs"]["href"])),
                field("image_alt", given(strip(image["alt"]))),
                field("image_url", absolute(F.coalesce(given(image["src"]), given(image["data-src"])))),
                field("date", stamp),
            ),
            lambda f: f["value"].isNotNull(),
        ).cast(FIELDS)

    def label(n):
        by_class = F.when(
            n["tag"].isin(fixed.NAMED_FIELD_TAGS),
            F.get(F.filter(H.class_list(n), lambda c: F.length(c) > 2), F.lit(0)),
        )
        return _slug(
            F.coalesce(given(n["attrs"]["itemprop"]), given(n["attrs"]["data-field"]), by_class)
        )

    def labelled(inside):
        marked = F.filter(
            inside,
            lambda n: ~n["tag"].isin(fixed.SKIP_TAGS + ["a", "img", "time"])
            & ((n["class"] != "") | n["attrs"]["itemprop"].isNotNull()
               | n["attrs"]["data-field"].isNotNull()),
        )
        return F.filter(
            F.transform(
                marked, lambda n: F.struct(label(n).alias("key"), H.node_text(n, dom).alias("value"))
            ),
            lambda f: f["key"].isNotNull()
            & (f["value"] != "")
            & ~f["key"].isin("title", "link", "date"),
        )

    def all_fields(main, more):
        # first value of each new name
        return F.aggregate(
            more,
            main,
            lambda acc, f: F.when(F.exists(acc, lambda a: a["key"] == f["key"]), acc).otherwise(
                F.concat(acc, F.array(f).cast(FIELDS))
            ),
        )

    def with_text(fields):
        return F.when(
            F.forall(fields, lambda f: f["key"] == "link"),
            let(
                H.node_text(item, dom),
                lambda text: F.when(
                    text != "",
                    F.concat(fields, F.array(field("text", text)).cast(FIELDS)),
                ).otherwise(fields),
            ),
        ).otherwise(fields)

    return let(
        H.below(item, dom),
        lambda inside: let(
            let(
                let(landmarks(inside), main_fields),
                lambda main: all_fields(main, labelled(inside)),
            ),
            with_text,
        ),
    )


@built_once
def repeated_array(dom: str = "dom", base: str | None = "url",
                   min_items: int = fixed.MIN_ITEMS) -> Column:
    """Groups of a page: array<struct<parent_id, selector, rows>>."""
    nodes = F.col(dom)["nodes"]
    parents = F.filter(
        nodes, lambda n: (F.size(n["kids"]) >= min_items) & ~n["tag"].isin(fixed.SKIP_TAGS)
    )

    def group(parent, signatures):
        signed = F.transform(
            parent["kids"], lambda k: F.struct(F.get(signatures, k).alias("s"), k.alias("k"))
        )
        return let(
            signed,
            lambda s: let(
                _most_common(s, min_items),
                lambda best: F.struct(
                    parent["node_id"].alias("parent_id"),
                    F.transform(F.filter(s, lambda x: x["s"] == best), lambda x: x["k"]).alias("items"),
                ),
            ),
        )

    def quiet(parent, first):
        return ~parent["class"].rlike(fixed.NOISE_CLASS) & ~first["class"].rlike(fixed.NOISE_CLASS)

    def described(g):
        items = F.transform(g["items"], lambda k: F.get(nodes, k))
        fields = lambda n: item_fields(n, dom, None if base is None else F.col(base))
        return let(
            F.struct(
                F.get(nodes, F.get(g["items"], F.lit(0))).alias("first"),
                F.get(nodes, g["parent_id"]).alias("parent"),
            ),
            lambda x: F.when(
                quiet(x["parent"], x["first"]),
                F.struct(
                    g["parent_id"].alias("parent_id"),
                    css_selector(x["first"], x["parent"]).alias("selector"),
                    F.filter(F.transform(items, fields), lambda r: F.size(r) > 0).alias("rows"),
                ),
            ),
        )

    groups = F.filter(
        let(signature_array(dom), lambda s: F.transform(parents, lambda p: group(p, s))),
        lambda g: F.size(g["items"]) >= min_items,
    )
    return F.filter(F.transform(groups, described), lambda g: F.size(g["rows"]) >= min_items)


def _most_common(signed: Column, min_items: int) -> Column:
    """Signature that occurs most often, min_items times or more; ties go to the
    earliest. In sorted order a signature repeats often enough when it equals the
    one min_items - 1 places on, so only such signatures are counted."""

    def frequent(ordered):
        return F.array_distinct(
            F.filter(
                F.transform(
                    ordered,
                    lambda x, i: F.when(F.get(ordered, i + (min_items - 1)) == x, x),
                ),
                lambda x: x.isNotNull(),
            )
        )

    def counted(names):
        return F.transform(
            names,
            lambda s: let(
                F.filter(signed, lambda x: x["s"] == s),
                lambda same: F.struct(
                    (-F.size(same)).alias("n"), F.get(same, F.lit(0))["k"].alias("first"), s.alias("s")
                ),
            ),
        )

    ordered = F.array_sort(F.transform(signed, lambda x: x["s"]))
    return F.array_min(counted(let(ordered, frequent)))["s"]


def score_group(g: Column) -> Column:
    """struct with the kept columns, fill share and score of one group."""

    def kept(n, cells):
        names = F.array_distinct(F.transform(cells, lambda c: c["key"]))
        return F.filter(
            names, lambda k: F.size(F.filter(cells, lambda c: c["key"] == k)) >= n * 0.5
        )

    def measure(n, cells, keep):
        filled = F.size(
            F.filter(cells, lambda c: F.array_contains(keep, c["key"]) & (c["value"] != ""))
        ) / (n * F.size(keep))
        text_only = (F.size(keep) == 1) & (F.get(keep, F.lit(0)) == "text")
        return let(
            filled,
            lambda share: let(
                F.greatest(
                    F.lit(0.05),
                    F.least(
                        F.lit(0.35)
                        + F.least(n / 20.0, F.lit(1.0)) * 0.25
                        + share * 0.25
                        + F.least(F.size(keep) / 5.0, F.lit(1.0)) * 0.1
                        - F.when(text_only, 0.25).otherwise(0.0),
                        F.lit(0.95),
                    ),
                ),
                lambda score: F.struct(
                    g["parent_id"].alias("parent_id"), g["selector"].alias("selector"),
                    n.cast("bigint").alias("item_count"), keep.alias("keep"),
                    share.alias("filled"), score.alias("score"),
                    confidence(score).alias("confidence"), g["rows"].alias("rows"),
                ),
            ),
        )

    n = F.size(g["rows"])
    return let(
        F.flatten(g["rows"]),
        lambda cells: let(kept(n, cells), lambda keep: measure(n, cells, keep)),
    )


def best_groups(groups: Column, limit: int | None = None) -> Column:
    """Best group per selector, by score and size."""

    def better(a, b):
        return (
            F.when(a["score"] > b["score"], -1)
            .when(a["score"] < b["score"], 1)
            .when(a["item_count"] > b["item_count"], -1)
            .when(a["item_count"] < b["item_count"], 1)
            .when(a["parent_id"] < b["parent_id"], -1)
            .otherwise(1)
        )

    scored = F.filter(F.transform(groups, score_group), lambda g: F.size(g["keep"]) > 0)
    ordered = F.array_sort(scored, better)
    best = first_per(ordered, lambda g: g["selector"])
    return best if limit is None else F.slice(best, 1, limit)


@built_once
def group_array(dom: str = "dom", base: str | None = "url",
                min_items: int = fixed.MIN_ITEMS) -> Column:
    """The page's repeated-block candidates, best first."""
    return best_groups(repeated_array(dom, base, min_items))


def repeated_items(dom_pages: DataFrame, **options) -> DataFrame:
    """(page_id, group_idx, selector, item_idx, record): one row per item, the
    record reduced to the kept columns."""
    df = each(dom_pages, group_array(**options), "group_idx", "g")
    items = each(
        df.select("page_id", "group_idx", F.col("g.selector").alias("selector"),
                  F.col("g.keep").alias("keep"), F.col("g.rows").alias("rows")),
        F.col("rows"), "item_idx", "fields",
    )
    record = F.map_from_entries(
        F.filter("fields", lambda f: F.array_contains(F.col("keep"), f["key"]))
    )
    return items.select("page_id", "group_idx", "selector", "item_idx", record.alias("record"))


def repeated_candidates(dom_pages: DataFrame, **options) -> DataFrame:
    """One row per candidate: selector, items, columns with their types, score."""
    df = each(dom_pages, group_array(**options), "group_idx", "g")
    cells = F.flatten(F.col("g.rows"))
    types = F.transform(
        F.col("g.keep"),
        lambda k: F.struct(
            k.alias("name"),
            values.infer_dtype(
                F.transform(F.filter(cells, lambda c: c["key"] == k), lambda c: c["value"])
            ).alias("dtype"),
        ),
    )
    return df.select(
        "page_id", "group_idx", F.col("g.selector").alias("selector"),
        F.col("g.item_count").alias("item_count"), types.alias("fields"),
        F.col("g.filled").alias("filled"), F.col("g.score").alias("score"),
        F.col("g.confidence").alias("confidence"),
    )


_SELECTOR = re.compile(r"^(?:(?:([\w-]+)((?:\.[\w-]+)*)|#([\w-]+))\s*>\s*)?([\w-]*)((?:\.[\w-]+)*)$")


def matches_selector(node: Column, dom, selector: str) -> Column:
    """Whether a node fits `tag.class`, `parent.class > tag` or `#id > tag`."""
    m = _SELECTOR.match(selector.strip())
    if m is None:
        raise ValueError(f"unsupported selector: {selector}")
    outer_tag, outer_classes, outer_id, tag, classes = m.groups()
    cond = F.lit(True)
    if tag:
        cond = cond & (node["tag"] == tag)
    for c in [x for x in (classes or "").split(".") if x]:
        cond = cond & F.array_contains(F.split(node["class"], r"\s+"), c)
    if outer_tag or outer_id:
        parent = H.node_at(dom, node["parent_id"])
        if outer_tag:
            cond = cond & (parent["tag"] == outer_tag)
        if outer_id:
            cond = cond & (parent["attrs"]["id"] == outer_id)
        for c in [x for x in (outer_classes or "").split(".") if x]:
            cond = cond & F.array_contains(F.split(parent["class"], r"\s+"), c)
    return F.coalesce(cond, F.lit(False))


def selected_items(dom: str, selector: str, base: str | None) -> Column:
    """Fields of every node the selector picks: array<array<struct<key,value>>>."""
    hits = F.filter(F.col(dom)["nodes"], lambda n: matches_selector(n, dom, selector))
    items = F.transform(hits, lambda n: item_fields(n, dom, None if base is None else F.col(base)))
    return F.filter(items, lambda r: F.size(r) > 0)


def rows_by_selector(dom_pages: DataFrame, selector: str, fields: list[str] | None = None,
                     dom: str = "dom", base: str | None = "url") -> DataFrame:
    """(page_id, item_idx, record) for every node the selector picks."""
    df = each(dom_pages, selected_items(dom, selector, base), "item_idx", "f").select(
        "page_id", "item_idx", F.map_from_entries("f").alias("record")
    )
    if fields:
        df = df.select("page_id", "item_idx", *[F.col("record")[f].alias(f) for f in fields])
    return df


_XPATH = re.compile(r"^//([\w-]+|\*)(?:\[@([\w-]+)(?:\s*=\s*['\"]([^'\"]*)['\"])?\])?(?:/(?:@([\w-]+)|(text\(\))))?$")


def rows_by_path(dom_pages: DataFrame, path: str, dom: str = "dom") -> DataFrame:
    """(page_id, item_idx, text, link) for `//tag[@attr='v']`, or (…, value) for
    a path that ends in `/@attr` or `/text()`."""
    m = _XPATH.match(path)
    if m is None:
        raise ValueError(f"unsupported path: {path}")
    tag, attr, wanted, out_attr, as_text = m.groups()

    def fits(n):
        cond = F.lit(True) if tag == "*" else (n["tag"] == tag)
        if attr:
            value = n["attrs"][attr]
            cond = cond & (value.isNotNull() if wanted is None else value == wanted)
        return F.coalesce(cond, F.lit(False))

    hits = F.filter(F.col(dom)["nodes"], fits)
    if out_attr or as_text:
        values_ = F.transform(
            hits,
            lambda n: strip(n["attrs"][out_attr]) if out_attr else strip(H.raw_text(n, dom)),
        )
        values_ = F.filter(values_, lambda v: v.isNotNull())
        return each(dom_pages, values_, "item_idx", "value").select("page_id", "item_idx", "value")
    rows = F.transform(
        hits,
        lambda n: F.struct(
            H.node_text(n, dom).alias("text"),
            F.when(
                F.coalesce(n["attrs"]["href"], F.lit("")) != "",
                urls.resolve_url(F.col("url"), n["attrs"]["href"]),
            ).alias("link"),
        ),
    )
    return each(dom_pages, rows, "item_idx", "r").select(
        "page_id", "item_idx", "r.text", "r.link"
    )
