"""URL expressions: splitting, joining, canonical form, policy, parameters."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col, let, strip

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url, index: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment ('' when absent)."""
    return F.regexp_extract(col(url), _PARTS, index)


def scheme(url) -> Column:
    return F.lower(part(url, 1))


def authority(url) -> Column:
    return F.lower(part(url, 2))


def site(url) -> Column:
    """The host a link belongs to: authority without a leading 'www.'."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def same_site(a, b) -> Column:
    return site(a) == site(b)


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    # Java leaves '*' and escapes '~'; the canonical form does the opposite
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url, keep_blank: bool = False) -> Column:
    """Decoded query parameters in order: array<struct<key,value>>."""
    pieces = F.filter(
        F.split(part(url, 4), "&"),
        lambda p: (p != "") if keep_blank else p.rlike("(?s)=."),
    )
    return F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("key"),
            _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )


def query_map(url) -> Column:
    """Query parameters as a map; the last value of a repeated key wins."""
    pairs = query_pairs(url)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(
        keys,
        F.transform(
            keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
        ),
    )


def canonical_url(url, drop_tracking: bool = True) -> Column:
    """Form used to compare URLs: lower-case scheme and host, no default port,
    no trailing slash, no fragment, no tracking parameters."""
    s, host, path, query = scheme(url), authority(url), part(url, 3), part(url, 4)
    host = F.when(s == "http", F.regexp_replace(host, ":80$", "")).otherwise(
        F.when(s == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    )
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    if drop_tracking:
        kept = F.filter(
            query_pairs(url, keep_blank=True),
            lambda p: ~F.lower(p["key"]).rlike("^(" + "|".join(fixed.TRACKING_PREFIXES) + ")"),
        )
        query = F.when(
            query != "",
            F.array_join(
                F.transform(kept, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))),
                "&",
            ),
        ).otherwise("")
    return F.concat(
        F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def _tidy_path(path: Column) -> Column:
    """Resolve '.' and '..' segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..",
            F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
        ).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg))),
    )
    tidy = F.concat(
        F.array_join(walked, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise("")
    )
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), tidy).otherwise(path)


def resolve_url(base, href) -> Column:
    """Absolute form of a link found on the page at `base`."""
    base, href = col(base), strip(col(href))
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(part(base, 3), r"(?s)^(.*/)[^/]*$", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    link_path = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike(_SCHEME), href)
        .when(href == "", base)
        .when(F.startswith(href, F.lit("//")), F.concat(part(base, 1), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, _tidy_path(link_path), rest))
        .when(F.startswith(href, F.lit("?")), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(root, _tidy_path(F.concat(folder, link_path)), rest))
    )


def is_http(url) -> Column:
    return col(url).rlike("^https?://")


def _v4_number(host: Column) -> Column:
    octets = F.split(host, r"\.")
    value = F.lit(0).cast("bigint")
    for i in range(4):
        value = value * 256 + F.get(octets, F.lit(i)).try_cast("bigint")
    return value


def _not_public(host: Column) -> Column:
    def private(number):
        hit = F.lit(False)
        for start, bits in fixed.NON_PUBLIC_V4:
            net = ipaddress.ip_network(f"{start}/{bits}")
            hit = hit | number.between(int(net[0]), int(net[-1]))
        return F.coalesce(hit, F.lit(False))

    v6 = F.regexp_extract(host, r"^\[([^\]]*)\]$", 1)
    return F.when(
        host.rlike(r"^(\d{1,3})(\.\d{1,3}){3}$"), let(_v4_number(host), private)
    ).otherwise((v6 != "") & v6.rlike(fixed.NON_PUBLIC_V6))


def normalize_url(raw) -> Column:
    """Trimmed URL with a scheme, lower-case scheme and host, without fragment.
    Null when it cannot be one."""
    text = strip(col(raw))
    full = F.when(F.contains(text, F.lit("://")), text).when(
        ~text.rlike(_SCHEME) & (text != ""),
        F.concat(F.lit("https://"), F.regexp_replace(text, "^/+", "")),
    )
    pattern = r"(?s)^([^:/?#]*://[^/?#]+)([^#]*)(#.*)?$"
    return let(
        full,
        lambda u: F.when(
            u.rlike(pattern),
            F.concat(F.lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)),
        ),
    )


def _url_problem(url: Column) -> Column:
    """Reason for a normalized URL, from its scheme and authority alone."""
    suffix = "(" + "|".join(s.replace(".", r"\.") for s in fixed.BLOCKED_HOST_SUFFIXES) + ")$"
    head = F.struct(
        F.regexp_extract(url, r"^([^:]*):", 1).alias("scheme"),
        F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1).alias("authority"),
    )

    def located(h):
        port_text = F.regexp_extract(
            h["authority"], r"^(?:[^@]*@)?(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1
        )
        return F.struct(
            h["scheme"].alias("scheme"),
            F.contains(h["authority"], F.lit("@")).alias("user"),
            F.regexp_extract(h["authority"], r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1).alias("host"),
            F.when(port_text == "", F.when(h["scheme"] == "https", 443).otherwise(80))
            .otherwise(port_text.try_cast("int"))
            .alias("port"),
        )

    def judged(p):
        host = p["host"]
        return (
            F.when(~p["scheme"].isin("http", "https"), "scheme")
            .when(p["user"], "userinfo")
            .when(host == "", "host")
            .when(p["port"].isNull() | ~p["port"].between(0, 65535), "port")
            .when(p["port"].isin(fixed.BLOCKED_PORTS), "port")
            .when(host.isin(fixed.BLOCKED_HOST_NAMES) | host.rlike(suffix), "local")
            .when(host.isin(fixed.METADATA_HOSTS), "metadata")
            .when(_not_public(host), "private")
        )

    return let(let(head, located), judged)


def block_reason(raw) -> Column:
    """Why a URL must not be visited, or null. Syntactic rules only (no DNS)."""
    return let(
        normalize_url(raw),
        lambda url: F.when(F.coalesce(strip(col(raw)), F.lit("")) == "", "empty")
        .when(url.isNull(), "invalid")
        .otherwise(_url_problem(url)),
    )


def is_allowed(raw) -> Column:
    return block_reason(raw).isNull()


def url_label(url) -> Column:
    """Short label of a graph node: path, cut at 40 characters."""
    path = part(url, 3)
    path = F.when(path == "", "/").otherwise(path)
    return F.when(F.length(path) <= 40, path).otherwise(
        F.concat(F.substring(path, 1, 37), F.lit("..."))
    )


def _template(url, key: Column) -> Column:
    """URL in which the parameter is replaced by {page}, moved to the end."""
    others = F.filter(query_pairs(url), lambda p: F.lower(p["key"]) != F.lower(key))
    joined = F.transform(others, lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    pieces = F.concat(joined, F.array(F.concat(key, F.lit("={page}"))))
    return F.concat(
        part(url, 1), F.lit("://"), part(url, 2), part(url, 3), F.lit("?"),
        F.array_join(pieces, "&"),
    )


def page_param(url) -> Column:
    """First page-number parameter of a URL: struct<key,value> or null."""
    return F.get(
        F.filter(
            query_pairs(url),
            lambda p: F.lower(p["key"]).isin(fixed.PAGE_PARAMS) & p["value"].rlike(r"^\d+$"),
        ),
        F.lit(0),
    )


def page_template(url) -> Column:
    return _template(url, page_param(url)["key"])


PLAN = "struct<type:string,param:string,start:bigint,step:bigint,template:string," \
       "selector:string,cursor_path:string,source:string,confidence:string>"


def plan(type_, param=None, start=None, step=None, template=None, selector=None,
         cursor_path=None, source=None, confidence="low") -> Column:
    def lit(v, kind="string"):
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)

    return F.struct(
        lit(type_).alias("type"), lit(param).alias("param"),
        lit(1 if start is None else start, "bigint").alias("start"),
        lit(1 if step is None else step, "bigint").alias("step"),
        lit(template).alias("template"), lit(selector).alias("selector"),
        lit(cursor_path).alias("cursor_path"), lit(source).alias("source"),
        lit(confidence).alias("confidence"),
    )


def plan_from_url(url) -> Column:
    """Pagination plan from a page or offset parameter of the URL, or null."""
    params = F.filter(
        query_pairs(url),
        lambda p: F.lower(p["key"]).isin(fixed.PAGE_PARAMS + fixed.OFFSET_PARAMS)
        & p["value"].rlike(r"^\d+$"),
    )
    first = F.get(params, F.lit(0))
    limits = query_map(url)
    step = F.coalesce(
        limits["limit"].try_cast("bigint"), limits["per_page"].try_cast("bigint"), F.lit(50)
    )
    is_page = F.lower(first["key"]).isin(fixed.PAGE_PARAMS)
    return F.when(
        first.isNotNull(),
        F.when(
            is_page,
            plan("page_number", first["key"], first["value"], 1, _template(url, first["key"]),
                 source="url_query", confidence="high"),
        ).otherwise(
            plan("offset_limit", first["key"], first["value"], step, _template(url, first["key"]),
                 source="url_query", confidence="high")
        ),
    )


def set_query_param(url, key, value) -> Column:
    """URL with one query parameter set, the others kept in order."""
    others = F.filter(query_pairs(url), lambda p: p["key"] != key)
    pieces = F.concat(
        F.transform(others, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))),
        F.array(F.concat(_encode(key), F.lit("="), _encode(value))),
    )
    return F.concat(
        part(url, 1), F.lit("://"), part(url, 2), part(url, 3), F.lit("?"),
        F.array_join(pieces, "&"),
    )


def url_format(url) -> Column:
    """File format implied by the path, else 'feed' for feed-like addresses."""
    path = F.lower(part(url, 3))
    result = F.lit(None).cast("string")
    known = {**fixed.DATA_EXTENSIONS, **fixed.DOCUMENT_EXTENSIONS}
    for ext, fmt in reversed(list(known.items())):
        result = F.when(F.endswith(path, F.lit(ext)), fmt).otherwise(result)
    return F.coalesce(result, F.when(col(url).rlike(fixed.FEED_HINT), "feed"))


def content_type_format(content_type) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.CONTENT_TYPES.items() for x in kv])
    return table[F.lower(strip(F.get(F.split(col(content_type), ";"), F.lit(0))))]


def detect_format(url, content_type=None) -> Column:
    """Content type wins over the URL."""
    by_url = url_format(url)
    return by_url if content_type is None else F.coalesce(content_type_format(content_type), by_url)
