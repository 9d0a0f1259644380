"""Queries over captures, feeds, sitemaps, robots rules, files and the run store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import captures, columns, quality
from pagemill.plans import pages as flows
from pagemill.sinks import files as sinks
from pagemill.sources import files

from .base import block, joined, query, table
from .markup_queries import supplier_pages

# ---- files ------------------------------------------------------------------------


def written(spark, df, fmt, name):
    path = sinks.shared_folder(spark, name)
    sinks.write_dataset(df, path, fmt)
    return path


PART_SCHEMA = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


@query("src1_read_csv", PART)
def read_csv(spark, d):
    path = written(spark, table(spark, d, "part"), "csv", "part-csv")
    return files.read_csv(spark, path, PART_SCHEMA)


@query("src1_sniffed_delimiter", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name || ', Inc' AS c_name, c_acctbal FROM customer""")
def sniffed_delimiter(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(", Inc")).alias("c_name"), "c_acctbal"
    )
    path = sinks.shared_folder(spark, "customer-csv")
    c.write.option("header", True).option("sep", ";").csv(path)
    return files.read_csv(spark, path)


@query("src2_read_tsv", PART)
def read_tsv(spark, d):
    path = written(spark, table(spark, d, "part"), "tsv", "part-tsv")
    return files.read_file(spark, path, "tsv", schema=PART_SCHEMA)


@query("src3_read_jsonl", """
SELECT c_custkey AS id, c_name AS "who.name", c_mktsegment AS "who.market.segment", c_acctbal AS balance FROM customer""")
def read_jsonl(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.struct(
            F.struct(F.col("c_mktsegment").alias("segment")).alias("market"), F.col("c_name").alias("name")
        ).alias("who"),
        F.col("c_acctbal").alias("balance"),
    )
    path = written(spark, c, "jsonl", "customer-jsonl")
    return files.read_jsonl(spark, path)


@query("src4_read_json_documents", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer""")
def read_json_documents(spark, d):
    c = table(spark, d, "customer").withColumn("b", block("c_custkey", 500))
    text = F.concat(
        F.when(F.col("c_custkey") % 500 == 0, '{"page": 1, "hits": [').otherwise(","),
        F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))),
    )
    docs = joined(c, ["b"], "c_custkey", text)
    path = sinks.shared_folder(spark, "customer-json")
    # a document is a line, so the number of files does not follow that of documents
    docs.select(F.concat("body", F.lit("]}")).alias("value")).write.text(path)
    rows = files.read_json_documents(spark, path, per_line=True)
    return rows.select(F.col("record")["id"].alias("id"), F.col("record")["name"].alias("name"))


@query("src5_read_parquet", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem
WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL""")
def read_parquet(spark, d):
    li = files.read_file(spark, f"{d}/lineitem.parquet", "parquet")
    return li.where("l_shipdate < timestamp_ntz'1999-01-01'").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )


@query("src6_read_xml", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def read_xml(spark, d):
    s = table(spark, d, "supplier").withColumn("b", block("s_suppkey", 50))
    item = F.concat(
        F.lit("<supplier id='"), F.col("s_suppkey").cast("string"), F.lit("'><name>"), F.col("s_name"),
        F.lit("</name><balance>"), F.col("s_acctbal").cast("string"), F.lit("</balance></supplier>\n"),
    )
    body = joined(s, ["b"], "s_suppkey", item)
    path = sinks.shared_folder(spark, "supplier-xml")
    # several documents in a file
    body.select(F.concat(F.lit("<root>\n"), "body", F.lit("</root>")).alias("value")).write.text(path)
    rows = files.read_xml(spark, path, "supplier", "_id bigint, name string, balance double")
    return rows.select(F.col("_id").alias("id"), "name", "balance")


# ---- feeds, sitemaps, robots ----------------------------------------------------------


@query("src7_read_feed", """
SELECT p_partkey // 30 AS feed_id, CAST(row_number() OVER (PARTITION BY p_partkey // 30 ORDER BY p_partkey) - 1 AS INTEGER) AS ordinal,
  p_name || ' & more' AS title, 'https://f.example/p/' || p_partkey AS link,
  CASE WHEN (p_partkey // 30) % 2 = 0 THEN 'Mon, 01 Jan 2024' ELSE '2024-01-01' END AS published, p_brand AS author,
  'Size  ' || p_size || '  now' AS summary, 'id-' || p_partkey AS id FROM part""")
def read_feed(spark, d):
    p = table(spark, d, "part").withColumn("feed_id", block("p_partkey", 30))
    key = F.col("p_partkey").cast("string")
    rss = F.concat(
        F.lit("<item><title>"), F.col("p_name"), F.lit(" &amp; more</title><link>https://f.example/p/"), key,
        F.lit("</link><pubDate>Mon, 01 Jan 2024</pubDate><dc:creator>"), F.col("p_brand"),
        F.lit("</dc:creator><description><![CDATA[Size <b>"), F.col("p_size").cast("string"),
        F.lit("</b> now]]></description><guid isPermaLink='false'>id-"), key, F.lit("</guid></item>"),
    )
    atom = F.concat(
        F.lit("<entry><title type='text'>"), F.col("p_name"), F.lit(" &amp; more</title><link rel='alternate' href='https://f.example/p/"), key,
        F.lit("'/><updated>2024-01-01</updated><author><name>"), F.col("p_brand"),
        F.lit("</name></author><summary>Size &lt;b&gt;"), F.col("p_size").cast("string"),
        F.lit("&lt;/b&gt; now</summary><id>id-"), key, F.lit("</id></entry>"),
    )
    feeds = joined(p, ["feed_id"], "p_partkey", F.when(F.col("feed_id") % 2 == 0, rss).otherwise(atom))
    shell = F.when(
        F.col("feed_id") % 2 == 0,
        F.concat(F.lit('<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Top</title>'), F.col("body"), F.lit("</channel></rss>")),
    ).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Top</title>'), F.col("body"), F.lit("</feed>")))
    return captures.feed_entries(feeds.select("feed_id", shell.alias("body")))


@query("src8_read_sitemap", """
SELECT page_id // 20 AS map_id, CAST(row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS INTEGER) AS ordinal,
  url AS loc, CASE WHEN (page_id // 20) % 3 = 0 THEN 'sitemap' ELSE 'page' END AS kind FROM pages""")
def read_sitemap(spark, d):
    p = table(spark, d, "pages").select("page_id", "url").withColumn("map_id", block("page_id", 20))
    entry = F.concat(
        F.lit("<sm:url><sm:loc> "), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")),
        F.lit("\n</sm:loc></sm:url><sm:url><sm:loc>ftp://skip.example/</sm:loc></sm:url>"),
    )
    body = joined(p, ["map_id"], "page_id", entry)
    root = F.when(F.col("map_id") % 3 == 0, "sitemapindex").otherwise("urlset")
    text = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!-- made --><sm:'), root, F.lit(' xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        F.col("body"), F.lit("</sm:"), root, F.lit(">"),
    )
    return captures.sitemap_entries(body.select("map_id", text.alias("body")))


@query("src9_sitemap_frontier", """
WITH p AS (SELECT page_id // 60 AS site, (page_id % 60) // 15 AS part, page_id, url FROM pages),
f AS (SELECT site, url AS loc, min((part, page_id)) AS first_at FROM p GROUP BY site, url)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY first_at, loc) AS ordinal, loc FROM f""")
def sitemap_frontier(spark, d):
    p = table(spark, d, "pages").select("page_id", "url").withColumn("site", block("page_id", 60))
    p = p.withColumn("part", F.floor((F.col("page_id") % 60) / 15))
    address = F.concat(
        F.lit("https://maps.example.org/"), F.col("site").cast("string"), F.lit("/"),
        F.col("part").cast("string"), F.lit(".xml"),
    )
    p = p.withColumn("map", address)
    loc = lambda c: F.concat(F.lit("<url><loc>"), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    leaf = joined(p, ["map"], "page_id", loc(F.col("url"))).select(
        F.col("map").alias("url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("body")
    )
    index_url = F.concat(F.lit("https://maps.example.org/index-"), F.col("site").cast("string"), F.lit(".xml"))
    maps = p.select("site", "part", "map").distinct()
    index = joined(maps, ["site"], "part", loc(F.col("map"))).select(
        index_url.alias("url"), F.concat(F.lit("<sitemapindex>"), "body", F.lit("</sitemapindex>")).alias("body")
    )
    roots = p.select("site").distinct().select("site", index_url.alias("url"))
    return captures.sitemap_frontier(leaf.unionByName(index), roots)


def robots_bodies(spark, d):
    hosts = table(spark, d, "pages").select(
        F.lower(F.regexp_extract("url", r"^https?://([^/?#]*)", 1)).alias("host")
    ).distinct()
    n = F.length("host") % 5
    body = F.when(
        n == 0, F.lit("# rules\nUser-agent: *\nDisallow: /en/\nAllow: /en/4\nCrawl-delay: 2\nSitemap: https://s.example/a.xml\n")
    ).when(
        n == 1, F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /*.html$\nDisallow:\nsitemap: https://s.example/b.xml")
    ).when(n == 2, F.lit("")).otherwise(F.lit("gone"))
    status = F.when(n == 3, 404).when(n == 4, 503).otherwise(200)
    return hosts.select("host", status.alias("status"), body.alias("body"))


@query("flt6_robots_filter", """
WITH p AS (SELECT page_id, length(regexp_extract(url, '^https?://([^/?#]*)', 1)) % 5 AS n,
  regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, CASE n WHEN 0 THEN CASE WHEN path LIKE '/en/4%' THEN 'allowed' WHEN path LIKE '/en/%' THEN 'restricted' ELSE 'allowed' END
  WHEN 1 THEN CASE WHEN path LIKE '%.html' THEN 'restricted' ELSE 'allowed' END
  WHEN 3 THEN 'allowed' ELSE 'unknown' END AS robots_state,
  CASE WHEN n = 0 THEN 2.0::DOUBLE END AS crawl_delay FROM p""")
def robots_filter(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return captures.robots_filter(pages, robots_bodies(spark, d)).drop("url")


@query("flt6_robots_sitemaps", """
SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
  CASE WHEN length(regexp_extract(url, '^https?://([^/?#]*)', 1)) % 5 = 0 THEN 'https://s.example/a.xml' ELSE 'https://s.example/b.xml' END AS sitemap
FROM pages WHERE length(regexp_extract(url, '^https?://([^/?#]*)', 1)) % 5 IN (0, 1)""")
def robots_sitemaps(spark, d):
    return captures.robots_sitemaps(robots_bodies(spark, d))


# ---- captured sequences -----------------------------------------------------------------


def sequence(spark, d):
    """Conversations as runs: a turn is a page. Turn 5 fails, turn 4 of every third
    run repeats turn 1, turn 3 of every fifth is empty."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    first = c.where("turn = 1").select("conv_id", F.col("text").alias("first_text"))
    joined_ = c.join(first, "conv_id", "left")
    body = F.when((F.col("turn") == 4) & (F.col("conv_id") % 3 == 0), F.col("first_text")).otherwise(
        F.concat(F.col("turn").cast("string"), F.lit(":"), F.col("text"))
    )
    body = F.when(F.col("turn") == 1, F.col("text")).otherwise(body)
    return joined_.select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("page_no"),
        F.when(F.col("turn") == 5, 500).otherwise(200).alias("status"), body.alias("body"),
        F.when((F.col("turn") == 3) & (F.col("conv_id") % 5 == 0), 0)
        .otherwise(F.length("text")).cast("bigint").alias("n_rows"),
    )


SEQ = """
c AS (SELECT conv_id AS run_id, turn AS page_no,
  CASE WHEN turn = 5 THEN 'error' WHEN turn = 3 AND conv_id % 5 = 0 THEN 'empty'
       WHEN turn = 4 AND conv_id % 3 = 0 AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = 1) THEN 'repeated' END AS stop,
  CASE WHEN turn = 3 AND conv_id % 5 = 0 THEN 0 ELSE length(text) END AS n_rows FROM conversations c),
s AS (SELECT *, min(CASE WHEN stop IS NOT NULL THEN page_no END) OVER (PARTITION BY run_id) AS ended,
  coalesce(sum(n_rows) OVER (PARTITION BY run_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
"""


@query("win2_stop_conditions", f"""
WITH {SEQ}
SELECT run_id, page_no, CAST(least(n_rows, 600 - before) AS BIGINT) AS rows_kept FROM s
WHERE (ended IS NULL OR page_no < ended) AND before < 600""")
def stop_conditions(spark, d):
    return captures.stop_conditions(sequence(spark, d), max_rows=600).select("run_id", "page_no", "rows_kept")


@query("win2_stop_reasons", f"""
WITH {SEQ}
SELECT run_id, page_no AS stop_page, stop AS reason FROM s WHERE page_no = ended""")
def stop_reasons(spark, d):
    return captures.stop_reasons(sequence(spark, d))


@query("agg15_run_counters", """
SELECT conv_id AS run_id, count(*) AS pages_requested, count(*) FILTER (WHERE turn <> 5) AS pages_successful,
  sum(CASE WHEN turn = 3 AND conv_id % 5 = 0 THEN 0 ELSE length(text) END)::BIGINT AS n_rows,
  count(*) FILTER (WHERE turn = 5) AS warnings FROM conversations GROUP BY conv_id""")
def run_counters(spark, d):
    seq = sequence(spark, d).withColumn("warning", F.when(F.col("status") >= 400, "page failed"))
    return quality.run_counters(seq)


@query("agg14_schema_drift", """
SELECT conv_id AS run_id, turn AS page_no, CASE WHEN turn % 3 = 1 THEN 'extra' ELSE '' END AS new_columns,
  CASE WHEN turn % 2 = 1 THEN 'text' ELSE '' END AS missing_columns
FROM conversations c WHERE (turn % 3 = 1 OR turn % 2 = 1) AND turn > 0""")
def schema_drift(spark, d):
    c = table(spark, d, "conversations")
    # the first page of every run is made from turn 0, so each run has a baseline
    base = c.select("conv_id").distinct().select(
        F.col("conv_id").alias("run_id"), F.lit(0).cast("bigint").alias("page_no"), F.lit(0).alias("i"),
        F.create_map(F.lit("role"), F.lit("user"), F.lit("text"), F.lit("hi")).alias("record"),
    )
    pairs = F.array(
        F.struct(F.lit("role").alias("k"), F.col("role").alias("v")),
        F.when(F.col("turn") % 2 == 0, F.struct(F.lit("text").alias("k"), F.col("text").alias("v"))),
        F.when(F.col("turn") % 3 == 1, F.struct(F.lit("extra").alias("k"), F.col("role").alias("v"))),
    )
    later = c.where("turn > 0").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("page_no"), F.lit(0).alias("i"),
        F.map_from_entries(F.array_compact(pairs)).alias("record"),
    )
    drift = quality.schema_drift(base.unionByName(later), "run_id", "page_no", "i")
    return drift.select(
        "run_id", "page_no", F.array_join("new_columns", ",").alias("new_columns"),
        F.array_join("missing_columns", ",").alias("missing_columns"),
    )


@query("agg14_drift_messages", """
WITH t AS (SELECT conv_id, bool_or(turn % 3 = 1) AS n, bool_or(turn % 2 = 1) AS m FROM conversations WHERE turn > 0 GROUP BY conv_id)
SELECT conv_id AS run_id, CASE WHEN n AND m THEN 'Expected fields were absent on some pages: text; New fields appeared on later pages: extra'
  WHEN n THEN 'New fields appeared on later pages: extra' ELSE 'Expected fields were absent on some pages: text' END AS messages
FROM t WHERE n OR m""")
def drift_messages(spark, d):
    drift = schema_drift(spark, d).select(
        "run_id", "page_no", F.filter(F.split("new_columns", ","), lambda x: x != "").alias("new_columns"),
        F.filter(F.split("missing_columns", ","), lambda x: x != "").alias("missing_columns"),
    )
    return quality.drift_messages(drift, "run_id").select("run_id", F.array_join("messages", "; ").alias("messages"))


@query("win2_extract_runs", """
SELECT 'crawl' AS run_id, s_name AS name, 'table' AS _extraction_method, 'https://data.example.org/suppliers/' || (s_suppkey // 25) AS _source_url,
  s_suppkey // 25 AS _source_page FROM supplier""")
def extract_runs(spark, d):
    runs = supplier_pages(spark, d).select(
        F.lit("crawl").alias("run_id"), F.col("page_id").alias("page_no"), "page_id", "url",
        F.lit(200).alias("status"), "html",
    )
    return flows.extract(runs, fields=["Name"]).select(
        "run_id", F.col("Name").alias("name"), "_extraction_method", "_source_url", "_source_page"
    )


# ---- sinks -----------------------------------------------------------------------------


CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("snk1_write_csv", CUSTOMER)
def write_csv(spark, d):
    path = written(spark, table(spark, d, "customer"), "csv", "customer")
    return files.read_csv(spark, path, CUSTOMER_SCHEMA)


@query("snk1_write_tsv_nested", """
SELECT event_id, event_type, '{"k":' || json_extract_string(props, '$.k') || '}' AS nested FROM events""")
def write_tsv_nested(spark, d):
    e = table(spark, d, "events").select(
        "event_id", "event_type", F.struct(F.get_json_object("props", "$.k").cast("int").alias("k")).alias("nested")
    )
    path = written(spark, e, "tsv", "events")
    return files.read_tsv(spark, path, "event_id bigint, event_type string, nested string")


@query("snk2_write_jsonl", CUSTOMER)
def write_jsonl(spark, d):
    path = written(spark, table(spark, d, "customer"), "jsonl", "customer")
    return files.read_jsonl(spark, path, CUSTOMER_SCHEMA)


@query("snk3_json_array", "SELECT n_nationkey, n_name FROM nation")
def json_array(spark, d):
    blocks = sinks.json_array(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 10)
    rows = F.from_json("records", "array<struct<n_nationkey:int,n_name:string>>")
    return blocks.select(F.explode(rows).alias("r")).select("r.*")


@query("snk4_write_parquet", CUSTOMER)
def write_parquet(spark, d):
    path = written(spark, table(spark, d, "customer"), "parquet", "customer")
    return files.read_parquet(spark, path)


def stored_runs(spark, d):
    import datetime

    root = sinks.shared_folder(spark, "runs")
    s = table(spark, d, "supplier")
    for i in range(3):
        clean = s.where(F.col("s_nationkey") % 3 == i)
        sinks.save_run(
            root, f"2024010{i}-run", clean, s if i == 0 else None,
            {"created_at": datetime.datetime(2024, 1, i + 1), "source_url": f"https://e.example/{i}", "method": "table",
             "n_columns": 4, "title": f"Run {i}", "recipe_hash": "h", "n_rows": clean.count()},
        )
    return root


@query("snk5_run_store", """
SELECT CAST('2024010' || (s_nationkey % 3) || '-run' AS VARCHAR) AS run_id, count(*) AS stored, count(*) AS listed FROM supplier GROUP BY 1""")
def run_store(spark, d):
    root = stored_runs(spark, d)
    stored = spark.read.parquet(f"{root}/dataset").groupBy("run_id").agg(F.count("*").alias("stored"))
    runs = sinks.list_runs(spark, root).select("run_id", F.col("n_rows").alias("listed"))
    return stored.join(runs, "run_id")


@query("snk6_load_run", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey % 3 = 1")
def load_run(spark, d):
    return sinks.load_run(spark, stored_runs(spark, d), "20240101-run")


@query("srt5_newest_runs", """
SELECT o_orderkey AS run_id, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 50""")
def newest_runs(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), "o_totalprice")
    return sinks.newest_runs(runs)


@query("snk8_provenance_rows", """
WITH m AS (SELECT count(*) AS n, min(o_orderdate) AS first_day, list_sort(list_distinct(list(o_orderstatus))) AS states FROM orders)
SELECT 'n_rows' AS field, CAST(n AS VARCHAR) AS value FROM m
UNION ALL SELECT 'first_day', strftime(first_day, '%Y-%m-%d') FROM m
UNION ALL SELECT 'states', '["' || array_to_string(states, '","') || '"]' FROM m
UNION ALL SELECT 'method', 'table'""")
def provenance_rows(spark, d):
    manifest = table(spark, d, "orders").agg(
        F.count("*").alias("n_rows"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"),
        F.array_sort(F.collect_set("o_orderstatus")).alias("states"), F.lit("table").alias("method"),
    )
    return columns.provenance_rows(manifest)




@query("snk7_export_check", """
SELECT 'orders' AS dataset, f AS format, n AS n_rows, NULL AS reason
FROM (SELECT unnest(['csv', 'jsonl', 'parquet', 'tsv']) AS f), (SELECT count(*) AS n FROM orders)
UNION ALL SELECT 'orders', 'xlsx', 0, 'unknown export format ''xlsx'''
UNION ALL SELECT 'untyped', 'parquet', 0, 'parquet needs a type for note'
UNION ALL SELECT 'none', f, 0, 'the dataset is empty, nothing was exported' FROM (SELECT unnest(['csv', 'jsonl', 'parquet', 'tsv']) AS f)""")
def export_check(spark, d):
    """What the check lets through is written, and counted as it is read again."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    wanted = [("orders", orders, f) for f in (*sinks.FORMATS, "xlsx")]
    wanted += [("untyped", orders.withColumn("note", F.lit(None)), "parquet")]
    wanted += [("none", orders.where("o_orderkey < 0"), f) for f in sinks.FORMATS]
    ddl = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    out = []
    for name, df, fmt in wanted:
        path, reason = sinks.shared_folder(spark, f"check-{fmt}"), None
        try:
            sinks.write_dataset(df, path, fmt)
        except (sinks.EmptyDataset, sinks.FormatLimit) as error:
            rows, reason = spark.range(1).select(F.lit(0).cast("bigint").alias("n_rows")), str(error)
        else:
            again = files.read_parquet(spark, path) if fmt == "parquet" else files.read_file(spark, path, fmt, schema=ddl)
            rows = again.where("o_orderkey IS NOT NULL").agg(F.count("*").alias("n_rows"))
        labels = F.lit(name).alias("dataset"), F.lit(fmt).alias("format")
        out.append(rows.select(*labels, "n_rows", F.lit(reason).cast("string").alias("reason")))
    return reduce(DataFrame.unionAll, out)


@query("win3_best_rows", """
SELECT s_name AS name, 'table' AS _extraction_method, 'https://data.example.org/suppliers/' || (s_suppkey // 25) AS _source_url FROM supplier""")
def best_rows(spark, d):
    rows = flows.best_rows(supplier_pages(spark, d), fields=["name"])
    return rows.select(F.col("record")["name"].alias("name"), "_extraction_method", "_source_url")
