"""Queries over markup composed from tables: what was written must be read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators import article, candidates, links, pagination, repeated, structured, tables
from pagemill.sources import html as H

from .base import block, joined, query, table

PER_PAGE = 25


def supplier_pages(spark, d, header="<tr><th>Key</th><th>Name</th><th>Balance</th></tr>", row=None,
                   caption=True):
    """One page with one table per 25 suppliers."""
    s = table(spark, d, "supplier").withColumn("page_id", block("s_suppkey", PER_PAGE))
    cells = row if row is not None else F.concat(
        F.lit("<tr><td>"), F.col("s_suppkey").cast("string"), F.lit("</td><td> "), F.col("s_name"),
        F.lit("\n</td><td>"), F.col("s_acctbal").cast("string"), F.lit("</td></tr>"),
    )
    rows = joined(s, ["page_id"], "s_suppkey", cells)
    pid = F.col("page_id").cast("string")
    # even pages carry a caption, all of them a heading before the table
    cap = F.when(
        F.lit(caption) & (F.col("page_id") % 2 == 0),
        F.concat(F.lit("<caption>Block  "), pid, F.lit("</caption>")),
    ).otherwise("")
    return rows.select(
        "page_id",
        F.concat(F.lit("https://data.example.org/suppliers/"), pid).alias("url"),
        F.concat(
            F.lit("<html><body><h1>Suppliers</h1><div><h2>Part "), pid,
            F.lit("</h2><p>Note</p><table>"), cap, F.lit(header), F.col("body"),
            F.lit("</table></div></body></html>"),
        ).alias("html"),
    )


@query("src11_html_tables", """
WITH s AS (
  SELECT s_suppkey // 25 AS page_id, row_number() OVER (PARTITION BY s_suppkey // 25 ORDER BY s_suppkey) - 1 AS r,
    s_suppkey, s_name, s_acctbal FROM supplier)
SELECT page_id, 0 AS table_idx, CAST(r AS INTEGER) AS row_idx, c.i AS col_idx, c.h AS header, c.v AS value
FROM (SELECT page_id, r, unnest([{'i': 0, 'h': 'Key', 'v': CAST(s_suppkey AS VARCHAR)},
  {'i': 1, 'h': 'Name', 'v': s_name}, {'i': 2, 'h': 'Balance', 'v': CAST(s_acctbal AS VARCHAR)}]) AS c FROM s)""")
def html_tables(spark, d):
    return tables.html_tables(H.shred_html(supplier_pages(spark, d)))


@query("src11_table_rows", """
SELECT s_suppkey // 25 AS page_id, CAST(s_suppkey AS VARCHAR) AS "Key", s_name AS "Name",
  CAST(s_acctbal AS VARCHAR) AS "Balance" FROM supplier""")
def table_rows(spark, d):
    pages = H.shred_html(supplier_pages(spark, d))
    return tables.table_rows(pages, ["Key", "Name", "Balance"], 0).drop("table_idx", "row_idx")


@query("src11_pivot_table", """
SELECT s_suppkey // 25 AS page_id, CAST(s_suppkey AS VARCHAR) AS "Key", s_name AS "Name" FROM supplier""")
def pivot_table(spark, d):
    cells = tables.html_tables(H.shred_html(supplier_pages(spark, d)))
    return tables.pivot_table(cells, ["Key", "Name"]).drop("table_idx", "row_idx")


@query("src12_first_row_header", """
WITH s AS (
  SELECT s_suppkey // 25 AS page_id, row_number() OVER (PARTITION BY s_suppkey // 25 ORDER BY s_suppkey) - 1 AS r, * FROM supplier)
SELECT page_id, CAST(r AS INTEGER) AS row_idx, c.h AS header, c.v AS value
FROM (SELECT page_id, r, unnest([{'h': 'Key', 'v': CAST(s_suppkey AS VARCHAR)}, {'h': 'Name', 'v': s_name},
  {'h': 'Balance', 'v': CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(s_acctbal AS VARCHAR) END}]) AS c FROM s)""")
def first_row_header(spark, d):
    # no <th>; every third row lacks its last cell
    row = F.concat(
        F.lit("<tr><td>"), F.col("s_suppkey").cast("string"), F.lit("<td>"), F.col("s_name"),
        F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(
            F.concat(F.lit("<td>"), F.col("s_acctbal").cast("string"))
        ),
    )
    pages = supplier_pages(spark, d, "<tr><td>Key<td>Name<td>Balance", row)
    return tables.html_tables(H.shred_html(pages), "first_row").select(
        "page_id", "row_idx", "header", "value"
    )


@query("src13_header_cleaning", """
WITH s AS (
  SELECT s_suppkey // 25 AS page_id, row_number() OVER (PARTITION BY s_suppkey // 25 ORDER BY s_suppkey) - 1 AS r, * FROM supplier)
SELECT page_id, CAST(r AS INTEGER) AS row_idx, c.h AS header, c.v AS value
FROM (SELECT page_id, r, unnest([{'h': 'Id Key', 'v': CAST(s_suppkey AS VARCHAR)}, {'h': 'Id Name', 'v': s_name},
  {'h': 'column_2', 'v': 'x'}, {'h': 'Id Name_1', 'v': CAST(s_acctbal AS VARCHAR)}]) AS c FROM s)""")
def header_cleaning(spark, d):
    header = (
        "<thead><tr><th colspan=2>Id</th><th>Unnamed: 2</th><th>Id</th></tr>"
        "<tr><th>Key</th><th> Name</th><th></th><th>Name</th></tr></thead>"
    )
    row = F.concat(
        F.lit("<tr><td>"), F.col("s_suppkey").cast("string"), F.lit("</td><td>"), F.col("s_name"),
        F.lit("</td><td>x</td><td>"), F.col("s_acctbal").cast("string"), F.lit("</td></tr>"),
    )
    return tables.html_tables(H.shred_html(supplier_pages(spark, d, header, row))).select(
        "page_id", "row_idx", "header", "value"
    )


@query("src13_row_spans", """
WITH s AS (
  SELECT s_suppkey // 25 AS page_id, row_number() OVER (PARTITION BY s_suppkey // 25 ORDER BY s_suppkey) - 1 AS r, * FROM supplier)
SELECT page_id, CAST(r AS INTEGER) AS row_idx,
  CAST(page_id AS VARCHAR) || '-' || CAST(r // 2 AS VARCHAR) AS pair, s_name AS name FROM s""")
def row_spans(spark, d):
    at = F.col("s_suppkey") % PER_PAGE
    pair = F.concat(block("s_suppkey", PER_PAGE).cast("string"), F.lit("-"), F.floor(at / 2).cast("string"))
    row = F.concat(
        F.lit("<tr>"),
        F.when(at % 2 == 0, F.concat(F.lit("<td rowspan=2>"), pair, F.lit("</td>"))).otherwise(""),
        F.lit("<td>"), F.col("s_name"), F.lit("</td></tr>"),
    )
    pages = supplier_pages(spark, d, "<tr><th>pair</th><th>name</th></tr>", row)
    return tables.table_rows(H.shred_html(pages), ["pair", "name"], 0).drop("table_idx")


@query("src14_table_context", """
SELECT DISTINCT s_suppkey // 25 AS page_id,
  CASE WHEN (s_suppkey // 25) % 2 = 0 THEN 'Block ' || CAST(s_suppkey // 25 AS VARCHAR) END AS caption,
  'Part ' || CAST(s_suppkey // 25 AS VARCHAR) AS heading FROM supplier""")
def table_context(spark, d):
    return tables.table_candidates(H.shred_html(supplier_pages(spark, d))).select(
        "page_id", "caption", "heading"
    )


@query("join5_table_caption", """
SELECT s_suppkey // 25 AS page_id, 'Block ' || CAST(s_suppkey // 25 AS VARCHAR) AS caption, count(*) AS n_rows
FROM supplier WHERE (s_suppkey // 25) % 2 = 0 GROUP BY ALL
UNION ALL
SELECT s_suppkey // 25, NULL, count(*) FROM supplier WHERE (s_suppkey // 25) % 2 = 1 GROUP BY ALL""")
def table_caption(spark, d):
    pages = H.shred_html(supplier_pages(spark, d))
    el = H.elements(pages, "table", "caption", "td")
    t = el.where("tag = 'table'").select("page_id", F.col("node_id").alias("table_id"))
    caption = el.where("tag = 'caption'").select("page_id", "table_id", F.col("text").alias("caption"))
    rows = el.where("tag = 'td'").groupBy("page_id", "table_id").agg(
        F.countDistinct("row_id").alias("n_rows")
    )
    return (
        t.join(rows, ["page_id", "table_id"]).join(caption, ["page_id", "table_id"], "left")
        .select("page_id", "caption", "n_rows")
    )


@query("win5_table_score", """
WITH s AS (SELECT s_suppkey // 25 AS page_id, count(*) AS n FROM supplier GROUP BY ALL)
SELECT page_id, n AS n_rows, 3::BIGINT AS n_columns,
  round(least(0.99, 0.45 + CASE WHEN n >= 3 THEN 0.15 ELSE 0 END + CASE WHEN n >= 10 THEN 0.1 ELSE 0 END
    + 0.1 + 0.15 + 0.1 - CASE WHEN n = 1 THEN 0.2 ELSE 0 END), 6)::DOUBLE AS score FROM s""")
def table_score(spark, d):
    return tables.table_candidates(H.shred_html(supplier_pages(spark, d))).select(
        "page_id", "n_rows", "n_columns", F.round("score", 6).alias("score")
    )


def card_pages(spark, d, balance=True):
    """One page of cards per 20 customers."""
    c = table(spark, d, "customer").withColumn("page_id", block("c_custkey", 20))
    key = F.col("c_custkey").cast("string")
    shown = F.col("c_acctbal").cast("string") if balance is True else balance
    card = F.concat(
        F.lit('<div class="card big"><h3>'), F.col("c_name"), F.lit('</h3><a href="../c/'), key,
        F.lit('">more</a><span class="segment">'), F.col("c_mktsegment"),
        F.lit('</span><span itemprop="balance">'), shown,
        F.lit('</span><time datetime="2024-01-'), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"),
        F.lit('">x</time><img src="/i/'), key, F.lit('.png" alt=" pic '), key, F.lit('"></div>'),
    )
    rows = joined(c, ["page_id"], "c_custkey", card)
    pid = F.col("page_id").cast("string")
    return rows.select(
        "page_id",
        F.concat(F.lit("https://shop.example.org/list/all/"), pid, F.lit(".html")).alias("url"),
        F.concat(
            F.lit('<html><body><div class="main-menu"><i>1</i><i>2</i><i>3</i><i>4</i></div>'
                  '<div class="cards" id="list">'),
            F.col("body"), F.lit("</div></body></html>"),
        ).alias("html"),
    )


CARDS = """
WITH c AS (
  SELECT c_custkey // 20 AS page_id, row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) - 1 AS i,
    count(*) OVER (PARTITION BY c_custkey // 20) AS n, * FROM customer)
"""


@query("src16_card_records", CARDS + """
SELECT page_id, CAST(i AS INTEGER) AS item_idx, c_name AS title,
  'https://shop.example.org/list/c/' || CAST(c_custkey AS VARCHAR) AS link,
  'pic ' || CAST(c_custkey AS VARCHAR) AS image_alt,
  'https://shop.example.org/i/' || CAST(c_custkey AS VARCHAR) || '.png' AS image_url,
  '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS date,
  c_mktsegment AS segment, CAST(c_acctbal AS VARCHAR) AS balance
FROM c WHERE n >= 4""")
def card_records(spark, d):
    items = repeated.repeated_items(H.shred_html(card_pages(spark, d)))
    r = F.col("record")
    return items.select(
        "page_id", "item_idx",
        *[r[k].alias(k) for k in ("title", "link", "image_alt", "image_url", "date", "segment", "balance")],
    )


@query("src17_keep_columns", CARDS + """
, k AS (SELECT page_id, n, sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS have FROM c GROUP BY ALL)
SELECT page_id, have >= n * 0.5 AS keeps_balance,
  round(CASE WHEN have >= n * 0.5 THEN (n * 6 + have) / (n * 7.0) ELSE 1.0 END, 6) AS filled
FROM k WHERE n >= 4""")
def keep_columns(spark, d):
    # the balance is shown for some customers only; the element is always there
    shown = F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal").cast("string")).otherwise("")
    found = repeated.repeated_candidates(H.shred_html(card_pages(spark, d, shown)))
    return found.select(
        "page_id",
        F.exists("fields", lambda f: f["name"] == "balance").alias("keeps_balance"),
        F.round("filled", 6).alias("filled"),
    )


@query("prj7_item_field_types", CARDS + """
SELECT DISTINCT page_id, 'div.card.big' AS selector, n AS item_count,
  'balance:number date:date image_alt:string image_url:url link:url segment:string title:string' AS types
FROM c WHERE n >= 4""")
def item_field_types(spark, d):
    found = repeated.repeated_candidates(H.shred_html(card_pages(spark, d)))
    types = F.array_join(
        F.array_sort(F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), f["dtype"]))), " "
    )
    return found.select("page_id", "selector", "item_count", types.alias("types"))


@query("win5_repeated_score", CARDS + """
SELECT DISTINCT page_id, round(least(0.35 + 0.25 * least(n / 20.0, 1.0) + 0.25 + 0.1, 0.95), 6) AS score,
  CASE WHEN least(0.35 + 0.25 * least(n / 20.0, 1.0) + 0.25 + 0.1, 0.95) >= 0.8 THEN 'high' ELSE 'medium' END AS confidence
FROM c WHERE n >= 4""")
def repeated_score(spark, d):
    return repeated.repeated_candidates(H.shred_html(card_pages(spark, d))).select(
        "page_id", F.round("score", 6).alias("score"), "confidence"
    )


@query("src18_rows_by_selector", CARDS + """
SELECT page_id, CAST(i AS INTEGER) AS item_idx, c_name AS title, c_mktsegment AS segment FROM c""")
def rows_by_selector(spark, d):
    return repeated.rows_by_selector(
        H.shred_html(card_pages(spark, d)), "div.card", ["title", "segment"]
    )


@query("src18_rows_by_child_selector", CARDS + "SELECT page_id, CAST(i AS INTEGER) AS item_idx, c_name AS title FROM c")
def rows_by_child_selector(spark, d):
    return repeated.rows_by_selector(H.shred_html(card_pages(spark, d)), "#list > div", ["title"])


@query("src19_rows_by_path", CARDS + """
SELECT page_id, CAST(i AS INTEGER) AS item_idx, c_mktsegment AS text, CAST(NULL AS VARCHAR) AS link FROM c""")
def rows_by_path(spark, d):
    return repeated.rows_by_path(H.shred_html(card_pages(spark, d)), "//span[@class='segment']")


@query("src19_path_values", CARDS + """
SELECT page_id, CAST(i AS INTEGER) AS item_idx, '../c/' || CAST(c_custkey AS VARCHAR) AS value FROM c""")
def path_values(spark, d):
    return repeated.rows_by_path(H.shred_html(card_pages(spark, d)), "//a[@href]/@href")


@query("win3_file_candidates", """
WITH p AS (SELECT *, ['csv', 'pdf', 'html', 'xlsx', 'jsonl'][p_partkey % 5 + 1] AS ext FROM part)
SELECT p_partkey AS page_id, CASE WHEN ext = 'pdf' THEN 'document' ELSE 'file' END AS kind,
  'Direct ' || CASE ext WHEN 'csv' THEN 'CSV' WHEN 'pdf' THEN 'PDF' WHEN 'xlsx' THEN 'EXCEL' ELSE 'JSONL' END || ' file' AS title,
  CASE WHEN ext = 'pdf' THEN 0.6 ELSE 0.95 END::DOUBLE AS score FROM p WHERE ext NOT IN ('html', 'jsonl')
UNION ALL SELECT p_partkey, 'links', 'Files linked from this page', 0.75::DOUBLE FROM p WHERE ext = 'html'""")
def file_candidates(spark, d):
    # an address with a data extension is a file whatever its body says, unless it
    # promises JSON: that is read, and these bodies hold none
    p = table(spark, d, "part")
    ext = F.get(
        F.array(*[F.lit(x) for x in ("csv", "pdf", "html", "xlsx", "jsonl")]),
        (F.col("p_partkey") % 5).cast("int"),
    )
    pages = p.select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("https://f.example.org/"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("url"),
        F.lit("<html><body><a href='https://other.example.org/x.csv'>x</a></body></html>").alias("html"),
    )
    found = candidates.all_candidates(candidates.page_profile(H.shred_html(pages)))
    return found.select("page_id", "kind", "title", "score")


@query("win3_api_candidates", """
WITH o AS (
  SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey AS page_id, 'api' AS kind, 'https://f.example.org/' || o_custkey || CASE WHEN o_custkey % 3 = 0 THEN '.json' WHEN o_custkey % 3 = 1 THEN '.jsonl' ELSE '' END AS title,
  greatest(0.92, 0.05 + 0.4 + least(n / 50.0, 1.0) * 0.2 + 2 / 8.0 * 0.15) AS least_score, n AS n_rows, 'order,total' AS columns
FROM o WHERE o_custkey % 5 <> 0 AND n > 1""")
def api_candidates(spark, d):
    """Captured JSON bodies, by address or content type; a fifth of them failed."""
    o = table(spark, d, "orders")
    items = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("order"), F.col("o_totalprice").alias("total"))))
    o = o.groupBy("o_custkey").agg(items.alias("items")).where(F.size("items") > 1)
    k = F.col("o_custkey")
    lines = F.array_join(F.transform("items", lambda x: F.to_json(x)), "\n")
    listed = F.to_json(F.struct(F.struct(F.lit(1).alias("page")).alias("meta"), F.col("items").alias("rows")))
    ending = F.when(k % 3 == 0, ".json").when(k % 3 == 1, ".jsonl").otherwise("")
    pages = o.select(
        k.alias("page_id"), F.concat(F.lit("https://f.example.org/"), k.cast("string"), ending).alias("url"),
        F.when(k % 3 == 1, lines).otherwise(listed).alias("html"),
        F.when(k % 3 == 2, "application/json; charset=utf-8").alias("content_type"),
        F.when(k % 5 == 0, 503).otherwise(200).alias("status"),
    )
    found = candidates.all_candidates(candidates.page_profile(H.shred_html(pages)))
    return found.select("page_id", "kind", "title", F.greatest("score", F.lit(0.92)).alias("least_score"), "n_rows", F.array_join("columns", ",").alias("columns"))


@query("win3_feed_candidates", """
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 2 THEN 'file' ELSE 'feed' END AS kind,
  CASE WHEN p_partkey % 3 = 2 THEN 'Direct CSV file' ELSE 'RSS/Atom feed entries' END AS title,
  CASE WHEN p_partkey % 3 = 2 THEN 0.95 ELSE 0.9 END::DOUBLE AS score,
  CASE WHEN p_partkey % 3 <> 2 THEN p_size + 1 END::BIGINT AS n_rows FROM part""")
def feed_candidates(spark, d):
    """Feeds of both kinds; an address of a third ends like a file and is one.
    Parts are dealt evenly first: their file is small, the work on their pages is not."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, "item").otherwise("entry")
    entry = F.concat(F.lit("<"), name, F.lit("><title>x</title></"), name, F.lit(">"))
    parts = table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    pages = parts.select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("https://f.example.org/"), F.col("p_partkey").cast("string"), F.when(k == 2, ".csv").otherwise("")).alias("url"),
        F.concat(F.lit("<rss><channel><items>2</items>"), F.repeat(entry, (F.col("p_size") + 1).cast("int")), F.lit("</channel></rss>")).alias("html"),
        F.when(k == 0, "application/rss+xml").when(k == 1, "application/atom+xml").alias("content_type"),
    )
    found = candidates.all_candidates(candidates.page_profile(H.shred_html(pages)))
    return found.select("page_id", "kind", "title", "score", "n_rows")


@query("src33_rows_from_html", CARDS + """
SELECT 'table' AS source, s_suppkey // 25 AS page_id, s_name AS name FROM supplier
UNION ALL SELECT 'repeated', 1000000 + page_id, c_name FROM c WHERE n >= 4""")
def rows_from_html(spark, d):
    cards = card_pages(spark, d).withColumn("page_id", F.col("page_id") + 1000000)
    pages = H.shred_html(supplier_pages(spark, d).unionByName(cards))
    rows = candidates.rows_from_html(pages)
    return rows.select(
        "source", "page_id", F.coalesce(F.col("record")["Name"], F.col("record")["title"]).alias("name")
    )


@query("src25_article_metadata", """
SELECT doc_id AS page_id, 'Story ' || CAST(doc_id AS VARCHAR) AS title, source AS author,
  '2024-02-0' || CAST(doc_id % 9 + 1 AS VARCHAR) AS date, lang AS description, 'Example' AS sitename,
  'Story ' || CAST(doc_id AS VARCHAR) || ' of ' || source AS text FROM documents""")
def article_metadata(spark, d):
    doc = F.col("doc_id").cast("string")
    page = F.concat(
        F.lit("<html><head><title>t</title><meta name='author' content='"), F.col("source"),
        F.lit("'><meta property='article:published_time' content='2024-02-0"),
        (F.col("doc_id") % 9 + 1).cast("string"), F.lit("'><meta property='og:description' content='"),
        F.col("lang"), F.lit("'><meta property='og:site_name' content='Example'></head><body><header>top"
                             "</header><main><h1>Story "), doc, F.lit("</h1><aside>no</aside> of "),
        F.col("source"), F.lit("<script>x()</script><nav>n</nav></main><footer>f</footer></body></html>"),
    )
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("https://n.example/").alias("url"), page.alias("html")
    )
    return article.articles(H.shred_html(docs)).drop("url", "text_chars")


def file_pages(spark, d):
    """Pages that link to files of several kinds, 20 parts each; every link twice."""
    p = table(spark, d, "part").withColumn("page_id", block("p_partkey", 20))
    ext = F.get(
        F.array(*[F.lit(x) for x in ("csv", "pdf", "html", "xlsx", "jsonl")]),
        (F.col("p_partkey") % 5).cast("int"),
    )
    key = F.col("p_partkey").cast("string")
    href = F.concat(F.lit("/d/"), key, F.lit("."), ext)
    label = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("")
    anchor = F.concat(F.lit('<a href="'), href, F.lit('">'), label, F.lit('</a> <a href="'), href,
                      F.lit('#x">again</a>'))
    rows = joined(p, ["page_id"], "p_partkey", anchor)
    return rows.select(
        "page_id", F.lit("https://files.example.org/").alias("url"),
        F.concat(F.lit("<html><body>"), F.col("body"), F.lit("</body></html>")).alias("html"),
    )


@query("src21_file_links", """
WITH p AS (SELECT *, ['csv', 'pdf', 'html', 'xlsx', 'jsonl'][p_partkey % 5 + 1] AS ext FROM part),
l AS (
  SELECT p_partkey // 20 AS page_id, 'https://files.example.org/d/' || p_partkey || '.' || ext AS url, ext,
    CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_partkey || '.' || ext END AS label FROM p WHERE ext <> 'html'
  UNION ALL
  SELECT p_partkey // 20, 'https://files.example.org/d/' || p_partkey || '.' || ext || '#x', ext, 'again'
  FROM p WHERE ext <> 'html')
SELECT page_id, url, CASE ext WHEN 'xlsx' THEN 'excel' ELSE ext END AS format, label,
  CASE WHEN ext = 'pdf' THEN 'document' ELSE 'data' END AS kind FROM l""")
def file_links(spark, d):
    return links.file_links(H.shred_html(file_pages(spark, d)))


@query("src22_detect_format", """
SELECT p_partkey, CASE p_partkey % 8
  WHEN 0 THEN 'csv' WHEN 1 THEN 'excel' WHEN 2 THEN 'parquet' WHEN 3 THEN 'pdf' WHEN 4 THEN 'feed'
  WHEN 5 THEN NULL WHEN 6 THEN 'json' ELSE 'jsonl' END AS format FROM part""")
def detect_format(spark, d):
    forms = [
        ("/data.CSV", None), ("/x", "application/vnd.ms-excel; charset=utf-8"), ("/a/b.parquet?v=1", None),
        ("/doc", "application/pdf"), ("/blog/feed/", None), ("/page.html", "text/html"),
        ("/list.csv", "application/json"), ("/rows.ndjson", "text/plain"),
    ]
    pick = (F.col("p_partkey") % 8).cast("int")
    path = F.get(F.array(*[F.lit(a) for a, _ in forms]), pick)
    kind = F.get(F.array(*[F.lit(b) for _, b in forms]), pick)
    df = table(spark, d, "part").select(
        "p_partkey",
        F.concat(F.lit("https://h"), F.col("p_partkey").cast("string"), F.lit(".example.org"), path).alias("url"),
        kind.alias("content_type"),
    )
    return df.select("p_partkey", urls.detect_format("url", "content_type").alias("format"))


@query("src26_feed_links", """
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/feeds/' || CAST(page_id % 4 AS VARCHAR) || '.xml' AS feed_url
FROM pages
UNION ALL SELECT page_id, 'https://cdn.example.org/all.atom' FROM pages WHERE page_id % 2 = 0""")
def feed_links(spark, d):
    head = F.concat(
        F.lit('<link rel="alternate" type="application/rss+xml" href="/feeds/'),
        (F.col("page_id") % 4).cast("string"), F.lit('.xml">'),
        F.when(F.col("page_id") % 2 == 0,
               "<LINK type='application/atom+xml' href='https://cdn.example.org/all.atom'>").otherwise(""),
        F.lit('<link rel="stylesheet" href="/s.css"></head>'),
    )
    pages = table(spark, d, "pages").withColumn("html", F.replace(F.col("html"), F.lit("</head>"), head))
    return links.feed_links(pages)


def api_pages(spark, d):
    call = F.concat(
        F.lit('<script>fetch("/api/v1/items/'), F.col("page_id").cast("string"),
        F.lit("?page=2&size=10\"); load('https://api.example.org/data/list.json'); go(\"/static/app.js\");"
              "</script></head>"),
    )
    return table(spark, d, "pages").withColumn("html", F.replace(F.col("html"), F.lit("</head>"), call))


@query("src30_api_urls", """
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/api/v1/items/' || page_id || '?page=2&size=10' AS api_url,
  '2' AS page_param, '10' AS size_param FROM pages
UNION ALL SELECT page_id, 'https://api.example.org/data/list.json', NULL, NULL FROM pages""")
def api_urls(spark, d):
    return links.api_urls(api_pages(spark, d)).select(
        "page_id", "api_url", F.col("params")["page"].alias("page_param"),
        F.col("params")["size"].alias("size_param"),
    )


@query("join3_verified_first", """
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/api/v1/items/' || page_id || '?page=2&size=10' AS api_url,
  page_id % 2 = 0 AS verified FROM pages
UNION ALL SELECT page_id, 'https://api.example.org/data/list.json', FALSE FROM pages""")
def verified_first(spark, d):
    found = links.api_urls(api_pages(spark, d)).select("page_id", "api_url")
    answered = found.where("page_id % 2 = 0 and api_url like '%/items/%'")
    return links.verified_first(found, answered)


# ---- structured data --------------------------------------------------------------


def part_json(kind=True):
    """JSON of one part."""
    brand = F.struct(F.lit("Brand").alias("@type"), F.col("p_brand").alias("name"))
    offers = F.array(F.struct(F.col("p_retailprice").alias("price"), F.lit("EUR").alias("cur")))
    fields = [
        F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"), brand.alias("brand"),
        offers.alias("offers"), F.split("p_name", " ").alias("words"),
    ]
    return F.to_json(F.struct(*([F.lit("Product").alias("@type")] if kind else []), *fields))


def part_pages(spark, d, wrap):
    p = table(spark, d, "part").withColumn("page_id", block("p_partkey", 10))
    sep = F.when(F.col("p_partkey") % 10 == 0, "").otherwise(",")
    rows = joined(p, ["page_id"], "p_partkey", F.concat(sep, part_json()))
    return rows.select(
        "page_id", F.lit("https://shop.example.org/p").alias("url"), wrap(F.col("body")).alias("html")
    )


def ld_page(body):
    """Even pages: a list; odd pages: an @graph. A broken script comes first."""
    doc = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(
        F.concat(F.lit('{"@context":"https://schema.org","@graph":['), body, F.lit("]}"))
    )
    return F.concat(
        F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">\n'),
        doc, F.lit("</script><p>text</p></html>"),
    )


def state_page(body):
    """Even pages: a JSON script; odd pages: application state."""
    doc = F.concat(F.lit('{"props":{"page":{"items":['), body, F.lit(']}},"n":[1,2]}'))
    return F.when(
        F.col("page_id") % 2 == 0,
        F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), doc,
                 F.lit("</script></html>")),
    ).otherwise(
        F.concat(F.lit("<html><script>window.__INITIAL_STATE__ = "), doc, F.lit(";</script></html>"))
    )


PARTS = """
SELECT p_partkey // 10 AS page_id, CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, p_brand AS brand,
  CAST(p_retailprice AS DOUBLE) AS price, replace(p_name, ' ', ', ') AS words FROM part
"""


def part_record(df):
    r = F.col("record")
    return df.select(
        "page_id", r["sku"].alias("sku"), r["name"].alias("name"), r["brand.name"].alias("brand"),
        r["offers.0.price"].cast("double").alias("price"), r["words"].alias("words"),
    )


@query("src27_json_ld", PARTS)
def json_ld(spark, d):
    return part_record(structured.json_ld_records(part_pages(spark, d, ld_page)))


@query("src28_embedded_json", """
WITH g AS (SELECT p_partkey // 10 AS page_id, count(*) AS n FROM part GROUP BY ALL)
SELECT p.page_id, sku, name, brand, price, words FROM (""" + PARTS + """) p JOIN g USING (page_id) WHERE n >= 2""")
def embedded_json(spark, d):
    return part_record(structured.embedded_records(part_pages(spark, d, state_page)))


@query("src28_embedded_sources", """
SELECT DISTINCT p_partkey // 10 AS page_id,
  CASE WHEN (p_partkey // 10) % 2 = 0 THEN '__NEXT_DATA__' ELSE 'app_state' END AS name,
  CASE WHEN (p_partkey // 10) % 2 = 0 THEN 'script_json' ELSE 'window_state' END AS source FROM part""")
def embedded_sources(spark, d):
    return structured.embedded_documents(part_pages(spark, d, state_page)).select(
        "page_id", "name", "source"
    )


@query("src28_structured_fallback", """
SELECT 'json_ld' AS source, p_partkey // 10 AS page_id, count(*) AS n FROM part GROUP BY ALL
UNION ALL
SELECT 'embedded', 1000000 + p_partkey // 10, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 2""")
def structured_fallback(spark, d):
    linked = part_pages(spark, d, lambda b: F.concat(ld_page(b), state_page(b)))
    plain = part_pages(spark, d, state_page).withColumn("page_id", F.col("page_id") + 1000000)
    rows = structured.structured_records(linked.unionByName(plain))
    return rows.groupBy("source", "page_id").agg(F.count("*").alias("n"))


@query("src29_structured_types", """
SELECT DISTINCT p_partkey // 10 AS page_id, 'Brand,Product' AS types FROM part""")
def structured_types(spark, d):
    return structured.structured_types(part_pages(spark, d, ld_page)).select(
        "page_id", F.array_join("types", ",").alias("types")
    )


@query("win3_structured_candidates", """
SELECT DISTINCT p_partkey // 10 AS page_id, 'structured' AS kind, 0.62 AS score, 0::DOUBLE AS n FROM part
UNION ALL
SELECT 1000000 + p_partkey // 10, 'api', round(least(0.85, 0.55 + least(count(*) / 60.0, 0.3)), 6), count(*)::DOUBLE
FROM part GROUP BY 1 HAVING count(*) >= 2""")
def structured_candidates(spark, d):
    linked = part_pages(spark, d, ld_page)
    plain = part_pages(spark, d, state_page).withColumn("page_id", F.col("page_id") + 1000000)
    profile = candidates.page_profile(H.shred_html(linked.unionByName(plain)))
    found = candidates.all_candidates(profile).where("kind in ('structured', 'api')")
    return found.select(
        "page_id", "kind", F.round("score", 6).alias("score"),
        F.coalesce("n_rows", F.lit(0)).cast("double").alias("n"),
    )


# ---- pagination evidence in markup ------------------------------------------------


@query("pag2_pagination_from_html", """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'next_link' WHEN 1 THEN 'page_number' WHEN 2 THEN 'next_link'
    WHEN 3 THEN 'page_number' WHEN 4 THEN 'page_number' WHEN 5 THEN 'load_more' WHEN 6 THEN 'infinite_scroll'
    ELSE 'none' END AS type,
  CASE page_id % 8 WHEN 0 THEN 'rel_next' WHEN 1 THEN 'next_link_query' WHEN 2 THEN 'next_link_text'
    WHEN 3 THEN 'numbered_links' WHEN 4 THEN 'numbered_path' WHEN 5 THEN 'load_more_button'
    WHEN 6 THEN 'infinite_scroll_hint' END AS source,
  CASE page_id % 8 WHEN 0 THEN 'https://l.example.org/n/' || page_id
    WHEN 1 THEN 'https://l.example.org/q?k=' || page_id || '&page={page}' WHEN 2 THEN 'https://l.example.org/older/' || page_id
    WHEN 3 THEN 'https://l.example.org/s?p={page}' WHEN 4 THEN 'https://l.example.org/news/page/{page}' END AS template,
  CASE page_id % 8 WHEN 0 THEN '[rel=next]' WHEN 2 THEN 'a[rel=next], a.next' WHEN 5 THEN 'button.more' END AS selector
FROM pages""")
def pagination_from_html(spark, d):
    pid = F.col("page_id").cast("string")
    forms = F.array(
        F.concat(F.lit('<link rel="next" href="/n/'), pid, F.lit('">')),
        F.concat(F.lit('<a class="btn-next" href="/q?page=2&k='), pid, F.lit('">x</a>')),
        F.concat(F.lit('<a href="/older/'), pid, F.lit('"> Older </a>')),
        F.lit('<a href="/s?p=2">2</a><a href="/s?p=10">10</a>'),
        F.lit('<a href="/news/page/2/">2</a><a href="/news/page/3/">3</a>'),
        F.lit('<button class="more big">Load more</button>'),
        F.lit('<div data-infinite="1"></div>'),
        F.lit("<p>end</p>"),
    )
    extra = F.get(forms, (F.col("page_id") % 8).cast("int"))
    pages = table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("https://l.example.org/list/"), pid).alias("url"),
        F.concat(F.col("html"), extra).alias("html"),
    )
    return pagination.pagination_plans(H.shred_html(pages)).select(
        "page_id", "type", "source", "template", "selector"
    )
