"""HTML tables: from parsed pages to grids, named columns and long rows.

A grid is array<array<string>>. Building it and naming its columns are
projections inside the page row; only the finished cells are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import built_once, confidence, each, let, squash
from ..sources import html as H


# fixed values: the largest spans that a page may ask for
MAX_SPAN = {"colspan": 1000, "rowspan": 65534}


def _span(node: Column, name: str) -> Column:
    n = node["attrs"][name].try_cast("int")
    return F.greatest(F.least(F.coalesce(n, F.lit(1)), F.lit(MAX_SPAN[name])), F.lit(1))


def table_grids(dom="dom") -> Column:
    """array<struct<table_id, caption, heading, head_rows, rows>> of a page."""

    def row(tr, inside):
        return let(
            F.transform(
                F.filter(inside, lambda c: (c["row_id"] == tr["node_id"]) & c["tag"].isin("th", "td")),
                lambda c: F.struct(
                    H.node_text(c, dom).alias("text"), _span(c, "colspan").alias("across"),
                    _span(c, "rowspan").alias("down"), (c["tag"] == "th").alias("th"),
                ),
            ),
            lambda cells: F.struct(
                cells.alias("spans"),
                (
                    F.forall(cells, lambda c: c["th"])
                    | (H.node_at(dom, tr["parent_id"])["tag"] == "thead")
                ).alias("is_head"),
            ),
        )

    def grid(rows):
        plain = F.transform(
            rows,
            lambda r: F.flatten(
                F.transform(r["spans"], lambda c: F.array_repeat(c["text"], c["across"]))
            ),
        )
        has_span = F.exists(rows, lambda r: F.exists(r["spans"], lambda s: s["down"] > 1))
        return F.when(has_span, _fill_row_spans(rows)).otherwise(plain)

    def head_rows(rows):
        body_at = F.array_position(F.transform(rows, lambda r: r["is_head"]), F.lit(False))
        return F.when(body_at == 0, F.size(rows)).otherwise(body_at - 1).cast("int")

    def label(node):
        return let(
            H.node_text(node, dom), lambda text: F.when(text != "", text)
        )

    def one(table, headings):
        near = F.try_element_at(
            F.filter(
                headings,
                lambda h: (h["parent_id"] == table["parent_id"])
                & (h["ordinal"] < table["ordinal"])
                & (h["ordinal"] >= table["ordinal"] - 6),
            ),
            F.lit(-1),
        )
        earlier = F.try_element_at(
            F.filter(
                headings,
                lambda h: h["tag"].isin("h1", "h2", "h3") & (h["end_node"] < table["parent_id"]),
            ),
            F.lit(-1),
        )
        own = let(
            F.filter(
                H.below(table, dom),
                lambda n: (n["table_id"] == table["node_id"])
                & n["tag"].isin("tr", "th", "td", "caption"),
            ),
            lambda inside: let(
                F.filter(
                    F.transform(
                        F.filter(inside, lambda n: n["tag"] == "tr"), lambda tr: row(tr, H.below(tr, dom))
                    ),
                    lambda r: F.size(r["spans"]) > 0,
                ),
                lambda rows: F.struct(
                    label(
                        F.get(
                            F.filter(
                                inside,
                                lambda n: (n["tag"] == "caption")
                                & (n["parent_id"] == table["node_id"]),
                            ),
                            F.lit(0),
                        )
                    ).alias("caption"),
                    head_rows(rows).alias("head_rows"),
                    grid(rows).alias("rows"),
                ),
            ),
        )
        return let(
            own,
            lambda o: F.struct(
                table["node_id"].alias("table_id"),
                o["caption"].alias("caption"),
                F.coalesce(label(near), label(earlier)).alias("heading"),
                o["head_rows"].alias("head_rows"),
                o["rows"].alias("rows"),
            ),
        )

    return let(
        H.nodes_of(dom, "h1", "h2", "h3", "h4", "h5", "h6"),
        lambda headings: F.transform(H.nodes_of(dom, "table"), lambda t: one(t, headings)),
    )


def _fill_row_spans(rows: Column) -> Column:
    """Grid in which a cell that spans rows is repeated below."""
    pending = "array<struct<at:int,left:int,text:string>>"
    state = F.struct(
        F.array().cast("array<array<string>>").alias("grid"), F.array().cast(pending).alias("open")
    )

    def step(acc, row):
        # place the cells of this row around columns still held from above
        placed = F.aggregate(
            row["spans"],
            F.struct(
                F.array().cast("array<string>").alias("out"), F.array().cast(pending).alias("new")
            ),
            lambda a, s: _place(a, s, acc["open"]),
        )
        return let(placed, lambda done: _carry(acc, done))

    def _carry(acc, placed):
        return F.struct(
            F.concat(acc["grid"], F.array(_held(placed["out"], acc["open"]))).alias("grid"),
            F.concat(
                F.filter(
                    F.transform(
                        acc["open"],
                        lambda o: F.struct(o["at"].alias("at"), (o["left"] - 1).alias("left"),
                                           o["text"].alias("text")),
                    ),
                    lambda o: o["left"] > 0,
                ),
                placed["new"],
            ).alias("open"),
        )

    def _held(out, held):
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1))),
            out,
            lambda o, _: F.concat(
                o,
                F.transform(F.slice(F.filter(held, lambda h: h["at"] == F.size(o)), 1, 1),
                            lambda h: h["text"]),
            ),
        )

    def _place(a, span, held):
        return let(_held(a["out"], held), lambda out: _placed(a, span, out))

    def _placed(a, span, out):
        across = F.sequence(F.lit(0), span["across"] - 1)
        return F.struct(
            F.concat(out, F.array_repeat(span["text"], span["across"])).alias("out"),
            F.concat(
                a["new"],
                F.when(
                    span["down"] > 1,
                    F.transform(
                        across,
                        lambda i: F.struct((F.size(out) + i).cast("int").alias("at"),
                                           (span["down"] - 1).alias("left"),
                                           span["text"].alias("text")),
                    ),
                ).otherwise(F.array().cast(pending)),
            ).alias("new"),
        )

    return F.aggregate(rows, state, step, lambda acc: acc["grid"])


def unique_names(names: Column) -> Column:
    """Empty names become column_i; repeats get _1, _2 in order."""
    filled = F.transform(
        names, lambda n, i: F.when(n == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(n)
    )

    def numbered(known):
        return F.transform(
            known,
            lambda name, i: let(
                F.size(F.filter(F.slice(known, F.lit(1), i), lambda x: x == name)),
                lambda before: F.when(before == 0, name).otherwise(
                    F.concat(name, F.lit("_"), before.cast("string"))
                ),
            ),
        )

    return let(
        filled,
        lambda f: F.when(F.size(F.array_distinct(f)) == F.size(f), f).otherwise(numbered(f)),
    )


def _width(rows: Column) -> Column:
    return F.array_max(F.transform(rows, F.size))


def markup_header(rows: Column, head_rows: Column) -> Column:
    """Names from the header rows, joined by a space; '0','1',... without any."""

    def name(c):
        parts = F.transform(F.slice(rows, F.lit(1), head_rows), lambda r: F.get(r, c))
        named = F.filter(
            parts, lambda x: x.isNotNull() & (x != "") & ~F.contains(x, F.lit("Unnamed"))
        )
        return squash(F.array_join(named, " "))

    return let(
        F.sequence(F.lit(0), _width(rows) - 1),
        lambda columns: F.when(head_rows > 0, unique_names(F.transform(columns, name))).otherwise(
            F.transform(columns, lambda c: c.cast("string"))
        ),
    )


def first_row_rule(rows: Column) -> Column:
    """struct<names, body> when nothing marks a header: short rows are padded,
    the first row names the columns unless it is empty or too repetitive."""

    def pad(width):
        return F.transform(
            rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
        )

    def choose(padded):
        first = F.get(padded, F.lit(0))
        poor = F.forall(first, lambda x: x == "") | (
            F.size(F.array_distinct(first)) < F.greatest(F.lit(2), F.floor(F.size(first) / 2))
        )
        numbered = F.transform(first, lambda _, i: F.concat(F.lit("column_"), i.cast("string")))
        return let(
            poor,
            lambda p: F.struct(
                unique_names(F.when(p, numbered).otherwise(first)).alias("names"),
                F.when(p, padded).otherwise(F.slice(padded, F.lit(2), F.size(padded))).alias("body"),
            ),
        )

    return F.when(F.size(rows) >= 2, let(let(_width(rows), pad), choose))


@built_once
def table_array(dom="dom", header: str = "markup") -> Column:
    """Tables of a page with named columns; tables without body rows are left out.

    header='markup' uses rows of <th> or <thead>; header='first_row' applies the
    first-row rule.
    """

    def named(t):
        if header == "first_row":
            parts = first_row_rule(t["rows"])
        else:
            parts = F.when(
                F.size(t["rows"]) > 0,
                F.struct(
                    markup_header(t["rows"], t["head_rows"]).alias("names"),
                    F.slice(t["rows"], t["head_rows"] + 1, F.size(t["rows"])).alias("body"),
                ),
            )
        return let(
            parts,
            lambda p: F.struct(
                t["table_id"].alias("table_id"), t["caption"].alias("caption"),
                t["heading"].alias("heading"), p["names"].alias("names"), p["body"].alias("body"),
            ),
        )

    return F.filter(F.transform(table_grids(dom), named), lambda t: F.size(t["body"]) > 0)


def table_score(t: Column) -> Column:
    """Score of a table from its size, its named columns and its filled share."""
    rows, cols = F.size(t["body"]), F.size(t["names"])
    named = F.size(F.filter(t["names"], lambda n: ~F.lower(n).rlike("^(column_|unnamed)")))
    filled = F.size(F.filter(F.flatten(t["body"]), lambda x: x.isNotNull() & (x != "")))
    score = (
        F.lit(0.45)
        + F.when(rows >= 3, 0.15).otherwise(0.0)
        + F.when(rows >= 10, 0.1).otherwise(0.0)
        + F.when(cols >= 2, 0.1).otherwise(0.0)
        + F.when(cols >= 4, 0.05).otherwise(0.0)
        + named / F.greatest(cols, F.lit(1)) * 0.15
        + filled / F.greatest(rows * cols, F.lit(1)) * 0.1
        - F.when(rows == 1, 0.2).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(score, F.lit(0.99)))


def html_tables(dom_pages: DataFrame, header: str = "markup") -> DataFrame:
    """Long form: (page_id, table_idx, row_idx, col_idx, header, value)."""
    tables = each(dom_pages, table_array("dom", header), "table_idx", "t")
    rows = tables.select(
        "page_id", "table_idx", F.col("t.names").alias("names"),
        F.posexplode("t.body").alias("row_idx", "cells"),
    )
    cells = F.arrays_zip(F.col("names").alias("header"), F.col("cells").alias("value"))
    return rows.select(
        "page_id", "table_idx", "row_idx", F.posexplode(cells).alias("col_idx", "c")
    ).select(
        "page_id", "table_idx", "row_idx", "col_idx",
        F.coalesce("c.header", F.concat(F.lit("column_"), F.col("col_idx").cast("string"))).alias("header"),
        F.col("c.value").alias("value"),
    )


def table_rows(dom_pages: DataFrame, names: list[str], table_idx: int | None = None,
               header: str = "markup") -> DataFrame:
    """Wide form for known column names; no pivot and no shuffle, the row's own
    cells are looked up by name."""
    tables = each(dom_pages, table_array("dom", header), "table_idx", "t")
    if table_idx is not None:
        tables = tables.where(F.col("table_idx") == table_idx)
    rows = tables.select(
        "page_id", "table_idx", F.col("t.names").alias("names"),
        F.posexplode("t.body").alias("row_idx", "cells"),
    )
    record = F.map_from_arrays(
        F.slice("names", F.lit(1), F.size("cells")), F.slice("cells", F.lit(1), F.size("names"))
    )
    rows = rows.withColumn("__r", record)
    return rows.select(
        "page_id", "table_idx", "row_idx", *[F.col("__r")[n].alias(n) for n in names]
    )


def table_candidates(dom_pages: DataFrame) -> DataFrame:
    """One row per table: size, names, caption, heading, score, confidence."""
    tables = each(dom_pages, table_array(), "table_idx", "t").withColumn(
        "__score", let(F.col("t"), table_score)
    )
    score = F.col("__score")
    return tables.select(
        "page_id", "table_idx",
        F.size("t.body").cast("bigint").alias("n_rows"),
        F.size("t.names").cast("bigint").alias("n_columns"),
        F.col("t.names").alias("column_names"),
        F.col("t.caption").alias("caption"), F.col("t.heading").alias("heading"),
        score.alias("score"), confidence(score).alias("confidence"),
    )


def pivot_table(cells: DataFrame, headers: list[str]) -> DataFrame:
    """Long cells to one column per header (page_id, table_idx, row_idx, ...)."""
    return (
        cells.groupBy("page_id", "table_idx", "row_idx")
        .pivot("header", headers)
        .agg(F.first("value"))
    )
