"""What datasets a page holds: page profile, candidates, ranking, default rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, urls, variants
from ..functions.text import any_marker, strip, built_once, confidence, each, injection_phrases, let, map_last_wins
from ..sources import html as H
from . import article, captures, links, repeated, structured, tables

def page_flags(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds challenge and login_wall."""
    return pages.withColumns(
        {
            "challenge": any_marker(html, fixed.CHALLENGE_MARKERS),
            "login_wall": any_marker(html, fixed.LOGIN_MARKERS),
        }
    )


def needs_js(text_chars: Column, html: Column, has_tables: Column, has_repeated: Column,
             has_embedded: Column, has_api: Column) -> Column:
    """Whether a page likely renders its data in the browser: two kinds of
    evidence, or nothing found in little text."""
    nothing = ~has_tables & ~has_repeated
    evidence = (
        html.rlike(fixed.SCRIPT_FRAMEWORK_HINT).cast("int")
        + ((text_chars < 500) & (F.length(html) > 5000)).cast("int")
        + (nothing & (text_chars < 1500)).cast("int")
        + (has_embedded & nothing).cast("int")
    )
    return (evidence >= 2) | (nothing & ~has_api & (text_chars < 800))


def with_format(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds usable, file_format (of addresses that are files), json_body (of JSON
    bodies; lines of JSON as a list) and feed_items."""
    none = F.lit(None).cast("string")
    kind = F.lower(strip(F.get(F.split("content_type", ";"), F.lit(0)))) if "content_type" in pages.columns else none
    fmt = urls.detect_format("url", "content_type" if "content_type" in pages.columns else None)
    is_page = F.coalesce(kind.isin(fixed.PAGE_TYPES), F.lit(False))
    is_json = F.coalesce(F.contains(kind, F.lit("json")), F.lit(False)) | F.coalesce(
        fmt.isin("json", "jsonl") & ~is_page, F.lit(False)
    )
    is_feed = F.coalesce(kind.isin(fixed.FEED_BODY_TYPES), F.lit(False))
    body = strip(F.col(html))
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: strip(x) != "")
    by_line = (F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(r"^\s*\{.*\}\s*$"))
    listed = F.when(by_line, F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))).otherwise(body)
    ok = F.coalesce(F.col("status") < 400, F.lit(True)) if "status" in pages.columns else F.lit(True)
    return pages.withColumns(
        {
            "usable": ok,
            "file_format": F.when(fmt.isNotNull() & ~fmt.isin("feed", "json", "jsonl") & ~is_page & ~is_json, fmt),
            "json_body": F.when(is_json, listed),
            "feed_items": F.when(
                is_feed, F.size(F.regexp_extract_all(F.col(html), F.lit(r"(?i)<(?:\w+:)?(item|entry)[\s>/]"), F.lit(1)))
            ),
        }
    )


def page_profile(dom_pages: DataFrame) -> DataFrame:
    """One row per page: what the detectors found, plus flags. Detectors run in
    one projection over the parsed page; no shuffle.

    Columns `content_type` and `status` of the captures are honoured where they are
    given: a body of another type than its address promises is what its type says, and
    a capture that failed is no source."""
    dom_pages = with_format(dom_pages)
    anchors = links.link_array("dom")
    found = dom_pages.withColumns(
        {
            "tables": F.transform(
                tables.table_array(),
                lambda t: F.struct(
                    t["table_id"].alias("table_id"), t["caption"].alias("caption"),
                    t["heading"].alias("heading"), t["names"].alias("names"),
                    F.size(t["body"]).cast("bigint").alias("n_rows"),
                    tables.table_score(t).alias("score"),
                ),
            ),
            "groups": repeated.group_array(),
            "page_text": H.visible_text("dom"),
            "found_links": let(
                anchors,
                lambda ls: F.struct(links.internal_array(ls).alias("internal"), links.file_array(ls).alias("files")),
            ),
            "apis": links.api_url_array(),
            "blobs": F.transform(
                F.filter(
                    structured.embedded_array(), lambda b: F.try_parse_json(b["body"]).isNotNull()
                ),
                lambda b: b["body"],
            ),
            "linked": structured.json_ld_array(),
        }
    )
    found = page_flags(found.withColumn("has_embedded", F.size("blobs") > 0))
    has_tables, has_repeated = F.size("tables") > 0, F.size("groups") > 0
    text_chars = F.length("page_text")
    return found.withColumns(
        {
            "text_chars": text_chars.cast("bigint"),
            "injections": injection_phrases("page_text"),
            "requires_js": needs_js(
                text_chars, F.col("html"), has_tables, has_repeated, F.col("has_embedded"),
                F.size("apis") > 0,
            ),
        }
    ).drop("dom", "html")


_CANDIDATE = (
    "array<struct<kind:string,id:string,title:string,score:double,n_rows:bigint,"
    "columns:array<string>>>"
)


def _candidate(kind, id_, title, score, n_rows=None, columns=None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(kind).alias("kind"), lit(id_).alias("id"), lit(title).alias("title"),
        lit(score).cast("double").alias("score"), lit(n_rows).cast("bigint").alias("n_rows"),
        (F.array().cast("array<string>") if columns is None else columns).alias("columns"),
    )


@built_once
def _page_options() -> Column:
    """Candidates that come from the parsed page (table, repeated, article, links,
    api addresses)."""
    by_table = F.transform(
        "tables",
        lambda t, i: _candidate(
            "table", F.concat(F.lit("table_"), i.cast("string")),
            F.concat(
                F.lit("Table "), (i + 1).cast("string"), F.lit(" · "),
                F.coalesce(t["caption"], t["heading"], F.concat(F.lit("Table "), (i + 1).cast("string"))),
            ),
            F.least(F.lit(0.93), t["score"]), t["n_rows"], t["names"],
        ),
    )
    by_group = F.transform(
        "groups",
        lambda g, i: _candidate(
            "repeated", F.concat(F.lit("repeated_"), i.cast("string")),
            F.concat(F.lit("Repeated items · "), g["selector"]), g["score"], g["item_count"], g["keep"],
        ),
    )
    by_api = F.transform(
        "apis",
        lambda u, i: _candidate(
            "api", F.concat(F.lit("api_"), i.cast("string")), u,
            variants.api_score(u, F.array().cast("array<string>"), F.lit(None).cast("bigint")),
        ),
    )
    structured_page = (F.size("tables") > 0) | (F.size("groups") > 0)
    files = F.col("found_links.files")
    singles = F.array_compact(
        F.array(
            F.when(
                F.col("text_chars") >= 400,
                _candidate("article", "article_0", fixed.ARTICLE_TITLE,
                           F.when(structured_page, 0.55).otherwise(0.7)),
            ),
            F.when(
                F.size(files) > 0,
                _candidate(
                    "links", "links_files", fixed.FILES_TITLE,
                    F.when(F.exists(files, lambda f: f["kind"] == "data"), 0.75).otherwise(0.45),
                    F.size(files),
                ),
            ),
            F.when(
                F.size("found_links.internal") > 0,
                _candidate("links", "links_internal", fixed.LINKS_TITLE, 0.3,
                           F.size("found_links.internal")),
            ),
        )
    )
    return F.concat(*[x.cast(_CANDIDATE) for x in (by_table, by_group, by_api, singles)])


def _file_option(fmt: Column) -> Column:
    """Candidate of an address that points straight at a file."""
    is_document = fmt.isin(sorted(set(fixed.DOCUMENT_EXTENSIONS.values())))
    return F.array(
        _candidate(
            F.when(is_document, "document").otherwise("file"), "file_0",
            F.concat(F.lit("Direct "), F.upper(fmt), F.lit(" file")),
            F.when(is_document, 0.6).otherwise(0.95),
        )
    ).cast(_CANDIDATE)


def page_candidates(profile: DataFrame) -> DataFrame:
    """Candidates from the parsed page alone: (page_id, kind, id, title, score,
    n_rows, columns)."""
    return each(profile, _page_options(), "__i", "c").select("page_id", "c.*")


def _feed_option(items: Column) -> Column:
    return F.array(_candidate("feed", "feed_0", fixed.FEED_TITLE, 0.9, items)).cast(_CANDIDATE)


def all_candidates(profile: DataFrame) -> DataFrame:
    """Every candidate of every page, from one pass over the profile.

    A page becomes one row for its markup, one for its JSON-LD and one per
    embedded JSON document; each row states its own candidates, so nothing is
    joined and the pages are read once. An address that is a file, a feed with
    entries and a JSON body are judged by that alone.
    """
    none = F.lit(None).cast("string")
    is_feed = F.coalesce(F.col("feed_items") > 0, F.lit(False))
    own = profile.where("usable").withColumn("__fmt", F.when(F.col("json_body").isNull(), F.coalesce(
        "file_format", F.when(is_feed, "feed")))).withColumn(
        "__page",
        F.when(F.col("json_body").isNotNull(), F.array().cast(_CANDIDATE))
        .when(F.col("file_format").isNotNull(), _file_option(F.col("file_format")))
        .when(is_feed, _feed_option(F.col("feed_items")))
        .otherwise(_page_options()),
    )
    part = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("body"))
    linked = F.concat(F.lit("["), F.array_join("linked", ","), F.lit("]"))
    parts = F.concat(
        F.when(F.col("json_body").isNotNull(), F.array(part("json", F.col("json_body")))).otherwise(
            F.array(part("page", none))
        ),
        F.when(
            F.col("__fmt").isNull() & F.col("json_body").isNull(),
            F.concat(
                F.when(F.size("linked") > 0, F.array(part("linked", linked)))
                .otherwise(F.array().cast("array<struct<kind:string,body:string>>")),
                F.transform("blobs", lambda b: part("blob", b)),
            ),
        ).otherwise(F.array().cast("array<struct<kind:string,body:string>>")),
    )
    rows = each(own.select("page_id", "url", "__page", "linked", "blobs", "json_body", "__fmt"), parts, "__i", "__p").select(
        "page_id", "url", F.col("__i").alias("ordinal"), F.col("__p.kind").alias("kind"),
        F.when(F.col("__p.kind") == "page", F.col("__page")).alias("own"),
        F.try_parse_json("__p.body").alias("doc"),
    )
    rows = variants.type_names(rows, "doc", where=F.col("kind") == "linked")
    rows = variants.find_record_arrays(rows, "doc", where=F.col("kind").isin("blob", "json"))
    typed = F.when(
        F.size("types") > 0,
        F.array(_candidate("structured", "structured_0", fixed.STRUCTURED_TITLE, 0.62)),
    )
    embedded = F.transform(
        "arrays",
        lambda a, i: _candidate(
            "api",
            F.concat_ws("_", F.lit("embedded"), F.col("ordinal").cast("string"), i.cast("string")),
            a["path"],
            F.least(F.lit(0.85), F.least(a["n"] / 60.0, F.lit(0.3)) + 0.55), a["n"],
            a["keys"],
        ),
    )
    best = F.get("arrays", F.lit(0))
    keys = F.coalesce(best["keys"], F.map_keys(variants.as_map("doc")), F.array().cast("array<string>"))
    n = F.coalesce(best["n"], F.size(variants.as_array("doc")).cast("bigint"))
    answered = F.when(
        F.col("doc").isNotNull(),
        F.array(_candidate("api", "api_0", F.col("url"),
                           F.greatest(F.lit(0.92), variants.api_score("url", keys, n)), n, keys)),
    )
    options = (
        F.when(F.col("kind") == "json", answered.cast(_CANDIDATE))
        .when(F.col("kind") == "page", F.col("own"))
        .when(F.col("kind") == "linked", typed.cast(_CANDIDATE))
        .otherwise(embedded.cast(_CANDIDATE))
    )
    return each(rows.withColumn("__c", options), F.col("__c"), "__j", "c").select("page_id", "c.*")


def rank_candidates(candidates: DataFrame, preset: str = "auto") -> DataFrame:
    """Adds rank per page: preferred kinds first, then score; and confidence.

    A page has a few dozen candidates at most, so a page is a small group.
    """
    kinds = fixed.PRESETS[preset]
    preferred = F.col("kind").isin(kinds) if kinds else F.lit(False)
    w = Window.partitionBy("page_id").orderBy(preferred.desc(), F.desc("score"), "id")
    return candidates.withColumns(
        {"rank": F.row_number().over(w), "confidence": confidence(F.col("score"))}
    )


def best_per_selector(candidates: DataFrame, keep: int | None = None) -> DataFrame:
    """Best candidate per (page, selector); the best `keep` of a page if given."""
    one = Window.partitionBy("page_id", "selector").orderBy(F.desc("score"), F.desc("item_count"), "group_idx")
    top = Window.partitionBy("page_id").orderBy(F.desc("score"), F.desc("item_count"), "group_idx")
    first = candidates.withColumn("__r", F.row_number().over(one)).where("__r = 1")
    if keep is None:
        return first.drop("__r")
    return first.withColumn("__r", F.row_number().over(top)).where(F.col("__r") <= keep).drop("__r")


def difficulty(profile: DataFrame, candidates: DataFrame) -> DataFrame:
    """(page_id, best_score, difficulty)."""
    best = candidates.groupBy("page_id").agg(F.max("score").alias("best_score"))
    some = F.col("best_score").isNotNull()
    return profile.select("page_id", "challenge", "login_wall", "requires_js").join(
        best, "page_id", "left"
    ).select(
        "page_id", "best_score",
        F.when(F.col("challenge") | F.col("login_wall"), "high")
        .when(F.col("best_score") >= 0.8, "low")
        .when(some, "medium")
        .otherwise("high")
        .alias("difficulty"),
    )


def _fits_selector(node: Column, selector: Column) -> Column:
    """Node against a selector held in a column (forms made by css_selector)."""
    outer = F.regexp_extract(selector, r"^(.*) > ", 1)
    inner = F.regexp_replace(selector, r"^.* > ", "")
    parent = H.node_at("dom", node["parent_id"])

    def fits(n, sel):
        classes = F.slice(F.split(sel, r"\."), 2, F.size(F.split(sel, r"\.")))
        return (n["tag"] == F.get(F.split(sel, r"\."), F.lit(0))) & (
            F.size(F.array_except(classes, H.class_list(n))) == 0
        )

    up = F.when(outer == "", True).when(
        F.startswith(outer, F.lit("#")), F.concat(F.lit("#"), parent["attrs"]["id"]) == outer
    ).otherwise(fits(parent, outer))
    return F.coalesce(fits(node, inner) & up, F.lit(False))


def table_rows(t: Column) -> Column:
    """array<map> of a table's body rows by its header names."""
    return F.transform(
        t["body"],
        lambda r: F.map_from_arrays(
            F.slice(t["names"], F.lit(1), F.size(r)), F.slice(r, F.lit(1), F.size(t["names"]))
        ),
    )


def group_rows(g: Column) -> Column:
    """array<map> of a repeated group's selector, applied to the whole page."""
    return F.transform(
        F.filter(F.col("dom")["nodes"], lambda n: _fits_selector(n, g["selector"])),
        lambda n: let(
            repeated.item_fields(n, "dom", F.col("url")),
            lambda f: map_last_wins(F.filter(f, lambda x: F.array_contains(g["keep"], x["key"]))),
        ),
    )


def row_lists(dom_pages: DataFrame, selector: str | None = None,
              table_index: int | None = None) -> DataFrame:
    """Adds source and rows (array<map>): the named table, else the selector, else
    the first table, else the best repeated group's selector re-applied."""

    def sourced(found, name, rows):
        return let(
            found,
            lambda x: F.when(
                x.isNotNull(), F.struct(F.lit(name).alias("source"), rows(x).alias("rows"))
            ),
        )

    kept = [c for c in dom_pages.columns if c != "dom"]
    if selector and table_index is None:
        found = repeated.selected_items("dom", selector, "url")
        return dom_pages.select(
            *kept, F.lit("selector").alias("source"), F.transform(found, map_last_wins).alias("rows")
        )
    # one step per column: an analyzer pass resolves one level of nesting
    dom_pages = dom_pages.withColumn("__tables", tables.table_array())
    chosen = sourced(F.get("__tables", F.lit(table_index or 0)), "table", table_rows)
    if table_index is None:
        dom_pages = dom_pages.withColumn("__groups", repeated.group_array())
        chosen = F.coalesce(chosen, sourced(F.get("__groups", F.lit(0)), "repeated", group_rows))
    picked = dom_pages.withColumn("__p", chosen)
    return picked.select(*kept, F.col("__p.source").alias("source"), F.col("__p.rows").alias("rows"))


def rows_from_html(dom_pages: DataFrame, selector: str | None = None,
                   table_index: int | None = None) -> DataFrame:
    """(page_id, source, row_idx, record): the default rows of every page."""
    listed = row_lists(dom_pages, selector, table_index).select("page_id", "source", "rows")
    return each(listed, F.col("rows"), "row_idx", "record").select(
        "page_id", "source", "row_idx", "record"
    )


_RECORD = "map<string,string>"


def _own_rows(df: DataFrame, rows: Column) -> DataFrame:
    listed = df.withColumn("__rows", rows)
    return each(listed, F.col("__rows"), "row_idx", "record").select("page_id", "row_idx", F.col("record").cast(_RECORD).alias("record"))


def _records(df: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """Rows of a finished relation as records without nulls; a page is a small group."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names])
    w = Window.partitionBy("page_id").orderBy(*order)
    return df.select(
        "page_id", (F.row_number().over(w) - 1).alias("row_idx"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("record"),
    )


def candidate_rows(chosen: DataFrame) -> DataFrame:
    """chosen(page_id, url, html, kind, id), one candidate of a page -> (page_id, row_idx,
    record): the rows that the candidate stands for, whatever its kind.

    Tables and repeated groups by their number; JSON-LD items; record arrays of embedded
    JSON and of JSON bodies; the article as one row; links; entries of feeds. Candidates
    that only name an address (files, documents, found API addresses) have no rows in the
    page. Every kind reads only its own pages, so chosen should be written before.
    """
    def of(*kinds):
        return chosen.where(F.col("kind").isin(*kinds))

    number = F.element_at(F.split("id", "_"), -1).try_cast("int")
    tabled = H.shred_html(of("table")).withColumn("__tables", tables.table_array())
    grouped = H.shred_html(of("repeated")).withColumn("__groups", repeated.group_array())
    read = H.shred_html(of("article")).select("page_id", "url", "dom")
    linked = of("links")
    listed = links.file_links(H.shred_html(linked.where("id = 'links_files'")))
    inner = links.internal_links(H.shred_html(linked.where("id = 'links_internal'")))
    entries = captures.feed_entries(of("feed").select("page_id", F.col("html").alias("body")))
    items = structured.json_ld_records(of("structured"))
    w = Window.partitionBy("page_id").orderBy("ordinal", "item_idx")
    # an embedded document's number counts the page, then its JSON-LD if it has any
    blobs = F.filter(structured.embedded_array(), lambda b: F.try_parse_json(b["body"]).isNotNull())
    before = 1 + (F.size(structured.json_ld_array()) > 0).cast("int")
    inside = of("api").where(F.startswith("id", F.lit("embedded_"))).select(
        "page_id", number.alias("nth"), F.get(blobs, F.split("id", "_")[1].try_cast("int") - before)["body"].alias("body")
    ).withColumn("doc", F.try_parse_json("body"))
    inside = variants.find_record_arrays(inside, "doc").withColumn("objects", variants.objects_of("doc", F.get("arrays", F.col("nth"))))
    answers = of("api").where(~F.startswith("id", F.lit("embedded_"))).select("page_id", F.try_parse_json("html").alias("doc"))
    answers = variants.records_of(answers.where("doc is not null"), "doc", out="objects")
    objects = inside.select("page_id", "objects").unionAll(answers.select("page_id", "objects"))
    flat = variants.flatten_record(each(objects, F.col("objects"), "row_idx", "item").select("page_id", "row_idx", "item"), "item")
    parts = [
        _own_rows(tabled, let(F.get("__tables", number), table_rows)),
        _own_rows(grouped, let(F.get("__groups", number), group_rows)),
        _records(article.articles(read), ["url", "title", "author", "date", "description", "sitename", "text"], ["url"]),
        _records(listed.withColumn("ordinal", F.monotonically_increasing_id()), ["url", "format", "label", "kind"], ["ordinal"]),
        _records(inner.select("page_id", "ordinal", F.col("link").alias("url")), ["url"], ["ordinal"]),
        _records(entries, ["title", "link", "published", "author", "summary", "id"], ["ordinal"]),
        items.select("page_id", (F.row_number().over(w) - 1).alias("row_idx"), "record"),
        flat.select("page_id", "row_idx", "record"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part.select("page_id", F.col("row_idx").cast("int"), F.col("record").cast(_RECORD)))
    return out
