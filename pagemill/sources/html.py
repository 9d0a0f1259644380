"""HTML pages as data.

`shred_html` is the one place where Python reads a page: it turns the body into
a flat node list in document order. Each node knows its parent, the index of its
last descendant, the text pieces below it and its enclosing table and row, so
everything else is a Spark expression over slices of that list. One page is one
row; nothing here needs a shuffle.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import col, each, squash

# the parser travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE = (
    "struct<node_id:int,parent_id:int,end_node:int,depth:int,ordinal:int,tag:string,"
    "class:string,attrs:map<string,string>,text_from:int,text_to:int,table_id:int,"
    "row_id:int,kids:array<int>>"
)
_FIELDS = ["node_id", "parent_id", "end_node", "depth", "ordinal", "tag", "class", "attrs",
           "text_from", "text_to", "table_id", "row_id", "kids"]
DOM = f"struct<nodes:array<{NODE}>,texts:array<string>,zones:array<int>>"

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
# opening tag -> (open tags it ends, tags that shield outer ones)
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
_P_SHIELD = {"td", "th", "table", "button", "body", "li"}
_SHIELD = {"td", "th", "table", "body", "html"}
_CROSSES_SHIELD = _SHIELD | {"tr", "thead", "tbody", "tfoot"}
_HIDDEN = {"script", "style", "noscript"}
_CHROME = {"nav", "footer", "header", "aside"}
_SKIP = frozenset(fixed.SKIP_TAGS)


# comment | declaration | closing tag | opening tag with its attributes. A quote opens
# a string only behind "="; "<" outside a string ends the attempt, so no part of a
# page is read for more than one tag. At the end of the page a tag may lack its ">".
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*(?:>|\Z)|</([a-zA-Z][^\s/<>]*)[^<>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/<>]*)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)?|[\"'])*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?", re.DOTALL
)
_UNQUOTED_LAST = re.compile(r"=\s*[^\s\"'<>][^\s<>]*\Z")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title")}


class _Shredder:
    """Appends the nodes of one page, in document order, to shared columns."""

    def __init__(self, nodes: dict[str, list], texts: list, zones: list):
        self.n, self.texts, self.zones = nodes, texts, zones

    def page(self, html: str):
        self.base, self.text_base = len(self.n["tag"]), len(self.texts)
        self.open: list[tuple[int, str, int]] = []  # (node, tag, zone)
        self.children = [0]
        at, size = 0, len(html)
        while at < size:
            token = _TOKEN.search(html, at)
            self.text(html[at : token.start() if token else size])
            if token is None:
                break
            at = token.end()
            closing, opening, attributes = token.groups()
            if closing:
                self.end(closing.lower())
            elif opening:
                tag = opening.lower()
                self.start(tag, attributes)
                if tag in _RAW_END:
                    stop = _RAW_END[tag].search(html, at)
                    until = stop.start() if stop else size
                    self.text(html[at:until], raw=tag in ("script", "style"))
                    at = until
        self.close_to(0)

    def start(self, tag, attributes):
        if tag in _ENDS:
            self.end_open(*_ENDS[tag])
        if tag in _ENDS_P:
            self.end_open({"p"}, _P_SHIELD)
        n = self.n
        me = len(n["tag"]) - self.base
        parent, zone = (self.open[-1][0], self.open[-1][2]) if self.open else (-1, 0)
        table = row = -1
        if parent >= 0:
            table, row = n["table_id"][self.base + parent], n["row_id"][self.base + parent]
            if tag not in _SKIP:
                n["kids"][self.base + parent].append(me)
        if tag == "table":
            table, row = me, -1
        elif tag == "tr":
            row = me
        values = {}
        if attributes and not attributes.isspace():
            for name, double, single, bare in _ATTRIBUTE.findall(attributes):
                value = double or single or bare
                values.setdefault(name.lower(), unescape(value) if "&" in value else value)
        text = len(self.texts) - self.text_base
        for name, value in zip(
            _FIELDS,
            (me, parent, me, len(self.open), self.children[-1], tag, values.get("class", ""),
             list(values.items()), text, text, table, row, []),
        ):
            n[name].append(value)
        self.children[-1] += 1
        closed = attributes and attributes.endswith("/") and not _UNQUOTED_LAST.search(attributes)
        if tag not in _VOID and not closed:
            zone = 2 if zone == 2 or tag in _HIDDEN else 1 if zone == 1 or tag in _CHROME else 0
            self.open.append((me, tag, zone))
            self.children.append(0)

    def end(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][1]
            if name == tag:
                self.close_to(at)
                return
            if name in _SHIELD and tag not in _CROSSES_SHIELD:
                return

    def text(self, data, raw=False):
        if data:
            self.texts.append(unescape(data) if not raw and "&" in data else data)
            self.zones.append(self.open[-1][2] if self.open else 0)

    def end_open(self, ended, shield):
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][1]
            if name in ended:
                self.close_to(at)
                return
            if name in shield:
                return

    def close_to(self, at):
        last, texts = len(self.n["tag"]) - self.base - 1, len(self.texts) - self.text_base
        for node, _, _ in self.open[at:]:
            self.n["end_node"][self.base + node] = last
            self.n["text_to"][self.base + node] = texts
        del self.open[at:]
        del self.children[at + 1 :]


def _lists(values, kind):
    offsets = [0]
    for v in values:
        offsets.append(offsets[-1] + len(v))
    flat = pa.array([x for v in values for x in v], type=kind)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def _shred_batch(html):
    """Arrow column of page bodies -> Arrow struct column (see DOM)."""
    nodes: dict[str, list] = {f: [] for f in _FIELDS}
    texts: list[str] = []
    zones: list[int] = []
    node_at, text_at = [0], [0]
    shredder = _Shredder(nodes, texts, zones)
    for body in html.to_pylist():
        shredder.page(body or "")
        node_at.append(len(nodes["tag"]))
        text_at.append(len(texts))
    columns = []
    for name in _FIELDS:
        values = nodes[name]
        if name == "attrs":
            offsets = [0]
            for v in values:
                offsets.append(offsets[-1] + len(v))
            columns.append(
                pa.MapArray.from_arrays(
                    pa.array(offsets, pa.int32()),
                    pa.array([k for v in values for k, _ in v], pa.string()),
                    pa.array([x for v in values for _, x in v], pa.string()),
                )
            )
        elif name == "kids":
            columns.append(_lists(values, pa.int32()))
        else:
            columns.append(pa.array(values, pa.string() if name in ("tag", "class") else pa.int32()))
    rows = pa.array(node_at, pa.int32())
    pieces = pa.array(text_at, pa.int32())
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(rows, pa.StructArray.from_arrays(columns, names=_FIELDS)),
            pa.ListArray.from_arrays(pieces, pa.array(texts, pa.string())),
            pa.ListArray.from_arrays(pieces, pa.array(zones, pa.int32())),
        ],
        names=["nodes", "texts", "zones"],
    )


_PART = 1 << 20  # bytes of bodies that are nodes in Python at a time


def _parts(html: pa.Array) -> Iterator[pa.Array]:
    """Stretches of a batch, each of one body or of few bytes: a body becomes many times
    its size while it is parsed, and a batch may hold thousands."""
    start = size = 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(html), 0).to_pylist()):
        if size and size + n > _PART:
            yield html.slice(start, at - start)
            start = at
            size = 0
        size += n + 1
    yield html.slice(start)


def _arrow_shredder():
    def shred(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for html in batches:
            for part in _parts(html):
                yield _shred_batch(part)

    # not repeatable on purpose: the optimizer must not run the parser twice
    return F.arrow_udf(shred, DOM).asNondeterministic()


def shred_html(pages: DataFrame, html: str = "html", out: str = "dom") -> DataFrame:
    """Adds the parsed page: struct<nodes, texts, zones>.

    `texts` are the text pieces in document order; `zones` marks each as normal
    (0), page chrome (1: nav, footer, header, aside) or hidden (2: script,
    style, noscript).
    """
    return pages.withColumn(out, _arrow_shredder()(F.col(html)))


# ---- expressions over a parsed page -----------------------------------------


def raw_text(node: Column, dom) -> Column:
    """Text below a node as written. Pieces are picked by index: inside a lambda
    slice() copies the whole array first, which would make a page quadratic."""
    texts = col(dom)["texts"]
    start, stop = node["text_from"], node["text_to"]
    several = F.transform(F.sequence(start, stop - 1), lambda i: F.get(texts, i))
    return (
        F.when(stop == start + 1, F.get(texts, start))
        .when(stop > start, F.array_join(several, ""))
        .when(stop == start, "")
    )


def node_text(node: Column, dom) -> Column:
    """All text below a node, whitespace collapsed."""
    return squash(raw_text(node, dom))


def nodes_of(dom, *tags: str) -> Column:
    return F.filter(col(dom)["nodes"], lambda n: n["tag"].isin(list(tags)))


def below(node: Column, dom) -> Column:
    """Descendants of a node in document order."""
    return F.transform(
        F.when(
            node["end_node"] > node["node_id"], F.sequence(node["node_id"] + 1, node["end_node"])
        ).otherwise(F.array().cast("array<int>")),
        lambda i: F.get(col(dom)["nodes"], i),
    )


def node_at(dom, index: Column) -> Column:
    return F.get(col(dom)["nodes"], index)


def class_list(node: Column) -> Column:
    return F.filter(F.split(node["class"], r"\s+"), lambda c: c != "")


def visible_text(dom) -> Column:
    """Page text without script, style and noscript."""
    texts = F.filter(
        F.arrays_zip(col(dom)["texts"], col(dom)["zones"]), lambda t: t["zones"] < 2
    )
    return squash(F.array_join(F.transform(texts, lambda t: t["texts"]), ""))


def elements(dom_pages: DataFrame, *tags: str, dom: str = "dom", text: bool = True) -> DataFrame:
    """Elements table: one row per element (of the given tags, or all)."""
    chosen = nodes_of(dom, *tags) if tags else F.col(dom)["nodes"]
    packed = F.transform(
        chosen,
        lambda n: F.struct(
            *[n[f].alias(f) for f in ("node_id", "parent_id", "end_node", "depth", "ordinal",
                                      "tag", "class", "attrs", "table_id", "row_id")],
            *([node_text(n, dom).alias("text")] if text else []),
        ),
    )
    keep = [c for c in dom_pages.columns if c not in (dom, "html")]
    rows = each(dom_pages.select(*keep, F.col(dom)), packed, "__i", "__n")
    return rows.select(*keep, "__n.*")


def inside(dom_pages: DataFrame, outer: str, inner: str, dom: str = "dom") -> DataFrame:
    """(page_id, outer_id, node_id): every `inner` element within an `outer` element.

    A node's descendants are the range up to its `end_node`, so both lists of a page
    are compared by their numbers, in the page's own row."""
    def pairs(o):
        return F.transform(
            F.filter(nodes_of(dom, inner), lambda n: (n["node_id"] > o["node_id"]) & (n["node_id"] <= o["end_node"])),
            lambda n: F.struct(o["node_id"].alias("outer_id"), n["node_id"].alias("node_id")),
        )

    found = F.flatten(F.transform(nodes_of(dom, outer), pairs))
    rows = each(dom_pages.select("page_id", F.col(dom)), found, "__i", "n")
    return rows.select("page_id", "n.outer_id", "n.node_id")
