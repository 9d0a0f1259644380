"""Captured page sequences, robots rules, sitemaps, feeds, crawl lists."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import cut, each, let, strip
from ..sinks.files import kept
from .ranks import ranked


_BLOCK = 1000  # pages whose row counts are summed before a run's blocks are


def _marked(captures: DataFrame, run: str, page: str) -> DataFrame:
    """(run, page, n_rows, reason): numbers only; a body is read once, travels as its
    digest and is met again as that."""
    slim = kept(captures.select(run, page, "status", "n_rows", F.unhex(F.sha2("body", 256)).alias("__digest")), "digests")
    first = slim.groupBy(run, "__digest").agg(F.min(page).alias("__first"))
    first = first.toDF("__run", "__seen", "__first")
    same = F.col(run).eqNullSafe(F.col("__run")) & F.col("__digest").eqNullSafe(F.col("__seen"))
    seen = slim.join(first, same)
    reason = (
        F.when(F.col("status") >= 400, "error")
        .when(F.col("n_rows") == 0, "empty")
        .when(F.col("__first") < F.col(page), "repeated")
    )
    return seen.select(run, page, "n_rows", reason.alias("reason"))


def _rows_before(pages: DataFrame, run: str, page: str) -> DataFrame:
    """(run, page, rows_before): running sums, taken within blocks of pages and over
    the blocks of a run, so no task holds the pages of a long run."""
    blocked = pages.withColumn("__block", F.floor(F.col(page) / _BLOCK))
    sums = blocked.groupBy(run, "__block").agg(F.sum("n_rows").alias("__sum"))
    earlier = Window.partitionBy(run).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(run, "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    own = Window.partitionBy(run, "__block").orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    within = blocked.withColumn("__within", F.coalesce(F.sum("n_rows").over(own), F.lit(0)))
    return within.join(sums, [run, "__block"]).select(
        run, page, (F.col("__base") + F.col("__within")).alias("rows_before")
    )


def stop_conditions(captures: DataFrame, run: str = "run_id", page: str = "page_no",
                    max_rows: int | None = None) -> DataFrame:
    """Pages of a run that are read before it stops, with rows_before and rows_kept.

    A run ends before a failed, empty or already-seen body and, if max_rows is given,
    with the page that reaches it. Needs columns status, body and n_rows; a page
    number occurs once in a run. Only numbers are compared and summed; the pages
    themselves meet the result once, by run and page.
    """
    marked = _marked(captures, run, page)
    ends = marked.where("reason IS NOT NULL").groupBy(run).agg(F.min(page).alias("__end"))
    read = marked.join(ends, run, "left").where(F.col("__end").isNull() | (F.col(page) < F.col("__end")))
    counted = _rows_before(read.select(run, page, "n_rows"), run, page)
    if max_rows is not None:
        counted = counted.where(F.col("rows_before") < max_rows)
    rows = F.col("n_rows")
    kept = rows if max_rows is None else F.least(rows, F.lit(max_rows) - F.col("rows_before"))
    return captures.drop("body").join(counted, [run, page]).withColumn("rows_kept", kept)


def stop_reasons(captures: DataFrame, run: str = "run_id", page: str = "page_no") -> DataFrame:
    """(run, stop_page, reason): the first page that ended a run, if any."""
    marked = _marked(captures, run, page).where("reason IS NOT NULL")
    return marked.groupBy(run).agg(F.min(F.struct(page, "reason")).alias("s")).select(
        run, F.col(f"s.{page}").alias("stop_page"), F.col("s.reason").alias("reason")
    )


# ---- robots ------------------------------------------------------------------


def robots_rules(body: Column) -> Column:
    """array<struct<agents,kind,value>> of a robots body. Agent lines that follow
    each other form one group and own the rules up to the next agent line."""
    lines = F.filter(
        F.transform(
            F.split(body, r"\r\n|\r|\n"),
            lambda l: F.struct(
                F.lower(strip(F.regexp_extract(l, r"^([^:#]*):", 1))).alias("key"),
                strip(F.regexp_extract(l, r"^[^:#]*:([^#]*)", 1)).alias("value"),
            ),
        ),
        lambda l: l["key"].isin("user-agent", "allow", "disallow", "crawl-delay"),
    )
    rules = "array<struct<agents:array<string>,kind:string,value:string>>"
    start = F.struct(
        F.array().cast("array<string>").alias("agents"), F.lit(False).alias("ruled"),
        F.array().cast(rules).alias("rules"),
    )

    def step(acc, line):
        agent = F.array(F.lower(line["value"]))
        return F.when(
            line["key"] == "user-agent",
            F.struct(
                F.when(acc["ruled"], agent).otherwise(F.concat(acc["agents"], agent)).alias("agents"),
                F.lit(False).alias("ruled"),
                acc["rules"].alias("rules"),
            ),
        ).otherwise(
            F.struct(
                acc["agents"].alias("agents"),
                F.lit(True).alias("ruled"),
                F.concat(
                    acc["rules"],
                    F.array(
                        F.struct(acc["agents"].alias("agents"), line["key"].alias("kind"),
                                 line["value"].alias("value"))
                    ),
                ).cast(rules).alias("rules"),
            )
        )

    return F.aggregate(lines, start, step, lambda acc: acc["rules"])


def _rules_for(rules: Column, agent: str) -> Column:
    """Rules of the groups that name the agent, else of the '*' groups."""
    own = F.filter(
        rules,
        lambda r: F.exists(
            r["agents"], lambda a: (a != "*") & (a != "") & F.contains(F.lit(agent.lower()), a)
        ),
    )
    return let(
        own,
        lambda o: F.when(F.size(o) > 0, o).otherwise(
            F.filter(rules, lambda r: F.array_contains(r["agents"], "*"))
        ),
    )


def _path_pattern(value: Column) -> Column:
    """Rule path as a regular expression ('*' any run, '$' end)."""
    escaped = F.regexp_replace(value, r"([\\.\[\](){}+?^|])", r"\\$1")
    starred = F.replace(escaped, F.lit("*"), F.lit(".*"))
    return F.concat(
        F.lit("^"),
        F.when(F.endswith(starred, F.lit("$")), starred).otherwise(
            F.replace(starred, F.lit("$"), F.lit(r"\$"))
        ),
    )


_SALTS = 16  # tasks that the addresses of one host are dealt over


def robots_filter(pages: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Adds robots_state (allowed, restricted, unknown) and crawl_delay.

    robots(host, status, body) has one row per host. Plain rules are looked up: an address
    makes one key for each rule length that its host has, and keys meet the rules by
    (host, prefix), whatever their number. Only rules with * or $ are matched one by one.
    Each (host, path) is decided once. A host with very many addresses is dealt over
    tasks by a salt, its row copied to each.
    """
    rules = robots.select(
        F.col("host").alias("__host"), "status",
        F.filter(
            _rules_for(robots_rules(F.coalesce("body", F.lit(""))), agent), lambda r: (r["kind"] == "crawl-delay") | (r["value"] != "")
        ).alias("rules"),
        (F.coalesce("body", F.lit("")) != "").alias("has_body"),
    )
    verdicts = F.filter("rules", lambda r: r["kind"].isin("allow", "disallow"))
    plain = lambda r: ~r["value"].rlike(r"[*$]")
    delay = F.get(F.filter("rules", lambda r: r["kind"] == "crawl-delay"), F.lit(0))["value"].try_cast("double")
    hosts = rules.select(
        "__host", "status", "has_body", delay.alias("crawl_delay"),
        F.array_distinct(F.transform(F.filter(verdicts, plain), lambda r: F.length(r["value"]))).alias("__lengths"),
        F.filter(verdicts, lambda r: ~plain(r)).alias("__wild"),
        F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("__salt"),
    )
    # of equal rules allow wins
    known = rules.select("__host", F.explode(F.filter(verdicts, plain)).alias("r")).groupBy(
        F.col("__host").alias("__rule_host"), F.col("r.value").alias("__prefix")
    ).agg(F.max(F.col("r.kind") == "allow").alias("__allow"))
    path = F.concat(
        F.when(urls.part("url", 3) == "", "/").otherwise(urls.part("url", 3)),
        F.when(urls.part("url", 4) != "", F.concat(F.lit("?"), urls.part("url", 4))).otherwise(""),
    )
    located = pages.withColumn("__host", urls.authority("url")).withColumn("__path", path)
    asked = located.select("__host", "__path", F.pmod(F.xxhash64("__path"), F.lit(_SALTS)).cast("int").alias("__salt")).distinct()
    met = asked.join(hosts, ["__host", "__salt"])
    lengths = F.filter("__lengths", lambda n: n <= F.length("__path"))
    wild = F.array_max(
        F.transform(
            F.filter("__wild", lambda r: F.rlike(F.col("__path"), _path_pattern(r["value"]))),
            lambda r: F.struct(F.length(r["value"]).alias("l"), (r["kind"] == "allow").alias("allow")),
        )
    )
    keys = met.select(
        "__host", "__path", "status", "has_body", "crawl_delay", wild.alias("__wild"),
        F.explode_outer(F.transform(lengths, lambda n: F.substring(F.col("__path"), F.lit(1), n))).alias("__key"),
    )
    same = (F.col("__host") == F.col("__rule_host")) & (F.col("__key") == F.col("__prefix"))
    found = keys.join(known, same, "left").withColumn(
        "__rule", F.when(F.col("__allow").isNotNull(), F.struct(F.length("__prefix").alias("l"), F.col("__allow").alias("allow")))
    )
    # the longest rule decides; allow wins a tie
    decided = found.groupBy("__host", "__path").agg(
        F.any_value("status").alias("status"), F.any_value("has_body").alias("has_body"),
        F.any_value("crawl_delay").alias("crawl_delay"), F.greatest(F.max("__rule"), F.max("__wild")).alias("__rule"),
    )
    state = (
        F.when(F.col("status") == 404, "allowed")
        .when((F.col("status") >= 400) | ~F.col("has_body"), "unknown")
        .when(F.coalesce(F.col("__rule")["allow"], F.lit(True)), "allowed")
        .otherwise("restricted")
    )
    states = decided.where("status IS NOT NULL").select("__host", "__path", state.alias("robots_state"), "crawl_delay")
    kept_columns = [c for c in pages.columns if c not in ("robots_state", "crawl_delay")]
    joined = located.select(*kept_columns, "__host", "__path").join(states, ["__host", "__path"], "left")
    return joined.withColumn("robots_state", F.coalesce("robots_state", F.lit("unknown"))).select(
        *kept_columns, "robots_state", "crawl_delay"
    )


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(host, sitemap) listed in robots bodies."""
    listed = F.filter(
        F.transform(
            F.regexp_extract_all(
                F.col("body"), F.lit(r"(?im)^sitemap:[ \t]*([^\r\n]*)"), F.lit(1)
            ),
            lambda s: strip(s),
        ),
        lambda s: s != "",
    )
    return each(robots, listed, "ordinal", "sitemap").select("host", "sitemap")


# ---- sitemaps and feeds --------------------------------------------------------


def _entity_text(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
                       ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def sitemap_entries(captures: DataFrame, body: str = "body") -> DataFrame:
    """Adds (ordinal, loc, kind) rows: kind is page, or sitemap when the root is a
    sitemap index. Only http(s) addresses. Works on damaged XML too."""
    locs = F.regexp_extract_all(
        F.col(body), F.lit(r"(?is)<(?:\w+:)?loc\b[^>]*>(.*?)</(?:\w+:)?loc\s*>"), F.lit(1)
    )
    clean = F.filter(F.transform(locs, lambda u: strip(_entity_text(u))), urls.is_http)
    is_index = F.col(body).rlike(r"(?is)^\s*(<\?xml.*?\?>)?\s*(<!--.*?-->\s*)*<(\w+:)?sitemapindex\b")
    kept = [c for c in captures.columns if c != body]
    return (
        each(captures.withColumn("kind", F.when(is_index, "sitemap").otherwise("page")), clean,
             "ordinal", "loc").select(*kept, "ordinal", "loc", "kind")
    )


def sitemap_frontier(captures: DataFrame, roots: DataFrame, max_urls: int | None = None,
                     max_sitemaps: int | None = None, depth: int | None = None) -> DataFrame:
    """(site, ordinal, loc): page addresses reached from each site's root sitemap.

    captures(url, body) holds fetched sitemaps, roots(site, url) the starting points.
    Sitemap indexes are followed level by level until none is new, at most `depth`
    levels if it is given. Levels are written, so that the plan does not grow with them.
    With max_sitemaps or max_urls only the first ones of a site are kept.
    """
    entries = sitemap_entries(captures.select("url", "body"))
    index = entries.where("kind = 'sitemap'")
    seen = roots.select("site", "url", F.array(F.lit(0)).alias("step"))
    level = seen
    for _ in itertools.count() if depth is None else range(depth):
        deeper = level.join(index, "url").select(
            "site", F.col("loc").alias("url"), F.concat("step", F.array(F.col("ordinal") + 1)).alias("step")
        )
        known = seen.select(F.col("site").alias("__site"), F.col("url").alias("__url"))
        again = F.col("site").eqNullSafe(F.col("__site")) & (F.col("url") == F.col("__url"))
        level = deeper.groupBy("site", "url").agg(F.min("step").alias("step")).join(known, again, "left_anti")
        level = kept(level, "sitemaps")
        if level.isEmpty():
            break
        seen = seen.unionAll(level)
    first = seen.groupBy("site", "url").agg(F.min(F.struct(F.size("step"), "step")).alias("step"))
    visited = first.where(urls.is_allowed("url"))
    if max_sitemaps is not None:
        visited = ranked(visited, ["site"], ["step", "url"], "__nth").where(F.col("__nth") <= max_sitemaps).drop("__nth")
    pages = (
        visited.join(entries.where("kind = 'page'"), "url")
        .groupBy("site", "loc")
        .agg(F.min(F.struct("step", "url", "ordinal")).alias("at"))
    )
    placed = ranked(pages, ["site"], ["at", "loc"], "ordinal").select("site", "ordinal", "loc")
    return placed if max_urls is None else placed.where(F.col("ordinal") <= max_urls)


def feed_entries(captures: DataFrame, body: str = "body", max_summary: int | None = None) -> DataFrame:
    """RSS/Atom entries: (..., ordinal, title, link, published, author, summary, id).
    Summaries are whole unless max_summary is given."""
    kept = [c for c in captures.columns if c != body]
    items = F.regexp_extract_all(
        F.col(body), F.lit(r"(?is)(<(?:\w+:)?(?:item|entry)\b.*?</(?:\w+:)?(?:item|entry)\s*>)"), F.lit(1)
    )
    rows = each(captures, items, "ordinal", "__item")
    item = F.col("__item")

    def tag(*names):
        values = []
        for name in names:
            raw = F.regexp_extract(item, rf"(?is)<(?:\w+:)?{name}\b[^>]*?>(.*?)</(?:\w+:)?{name}\s*>", 1)
            cdata = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
            value = strip(
                F.when(F.contains(raw, F.lit("<![CDATA[")), cdata).otherwise(_entity_text(raw))
            )
            values.append(F.when(value != "", value))
        return F.coalesce(*values, F.lit(""))

    atom_link = F.regexp_extract(item, r"(?is)<(?:\w+:)?link\b[^>]*href\s*=\s*[\"']([^\"']*)[\"']", 1)
    link = tag("link")
    author = tag("author", "creator")
    person = strip(F.regexp_extract(author, r"(?is)<(?:\w+:)?name\b[^>]*>(.*?)</", 1))
    return rows.select(
        *kept, "ordinal",
        tag("title").alias("title"),
        F.when(link != "", link).otherwise(_entity_text(atom_link)).alias("link"),
        tag("pubDate", "published", "date", "updated").alias("published"),
        F.when(person != "", person).otherwise(author).alias("author"),
        strip(cut(F.regexp_replace(tag("description", "summary", "content"), "<[^>]+>", " "), max_summary)).alias("summary"),
        tag("guid", "id").alias("id"),
    )


# ---- crawl lists ---------------------------------------------------------------


def page_urls(plans: DataFrame, template: str = "template", start: str = "start",
              step: str = "step", max_pages: str = "max_pages") -> DataFrame:
    """(..., page_index, page_url): the addresses a pagination plan stands for."""
    n = F.greatest(F.col(max_pages), F.lit(1))
    kept = plans.columns
    return (
        plans.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("page_index"))
        .withColumn(
            "page_url",
            F.replace(
                F.col(template), F.lit("{page}"),
                (F.col(start) + F.col("page_index") * F.greatest(F.col(step), F.lit(1))).cast("string"),
            ),
        )
        .select(*kept, "page_index", "page_url")
    )


def crawl_frontier(urls_df: DataFrame, run: str, url: str, order: str,
                   max_pages: int | None = None) -> DataFrame:
    """Distinct allowed addresses of each run in first-seen order; the first max_pages
    of them if that is given. Duplicates fold before the exchange, and a run of any size
    is numbered in ranges."""
    distinct = urls_df.groupBy(run, url).agg(F.min(order).alias(order)).where(urls.is_allowed(url))
    placed = ranked(distinct, [run], [order, url], "position")
    return placed if max_pages is None else placed.where(F.col("position") <= max_pages)
