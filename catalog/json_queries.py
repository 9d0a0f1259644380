"""Queries over JSON documents composed from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import urls, variants
from pagemill.functions.text import each
from pagemill.operators import pagination
from pagemill.sources import files

from .base import query, table


def order_lines(spark, d):
    """One row per order with its lines as an array of structs, in line order."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey",
        F.struct(
            F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
            F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"),
            F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"),
        ).alias("item"),
    )
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item")).alias("items"))


def order_documents(spark, d):
    """JSON text per order: {"meta": {...}, "data": [lines], "tags": [...]}."""
    body = F.struct(
        F.struct(F.col("l_orderkey").alias("order"), F.size("items").alias("count")).alias("meta"),
        F.transform(
            "items",
            lambda x: F.struct(
                x["line"].alias("line"), x["part"].alias("part"),
                F.struct(x["qty"].cast("int").alias("value"), F.lit("pcs").alias("unit")).alias("qty"),
                F.array(x["flag"], F.lit("z")).alias("flags"),
                F.array(F.struct(x["supp"].alias("supp")), F.struct((x["supp"] + 1).alias("supp"))).alias("alt"),
            ),
        ).alias("data"),
        F.array(F.lit("a"), F.lit("b")).alias("tags"),
    )
    return order_lines(spark, d).select("l_orderkey", F.to_json(body).alias("body"))


def parsed(spark, d):
    return order_documents(spark, d).select("l_orderkey", F.try_parse_json("body").alias("doc"))


LINES = """
l AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag, l_suppkey) - 1 AS i,
    count(*) OVER (PARTITION BY l_orderkey) AS n, * EXCLUDE (l_orderkey) FROM lineitem)
"""


@query("jsn1_find_record_arrays", f"""
WITH {LINES}, d AS (SELECT DISTINCT l_orderkey, n FROM l)
SELECT l_orderkey, 0 AS rank, 'data' AS path, n, 'alt,flags,line,part,qty' AS keys FROM d WHERE n >= 2
UNION ALL
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY 'data[' || i || '].alt') - (n < 2)::INT AS INTEGER),
  'data[' || i || '].alt', 2, 'supp' FROM l""")
def find_record_arrays(spark, d):
    found = variants.find_record_arrays(parsed(spark, d), "doc")
    return each(found.select("l_orderkey", "arrays"), F.col("arrays"), "rank", "a").select(
        "l_orderkey", "rank", "a.path", "a.n", F.array_join("a.keys", ",").alias("keys")
    )


@query("jsn2_resolve_path", f"""
WITH {LINES}
SELECT l_orderkey, max(n) AS lines, max(CASE WHEN i = 0 THEN l_partkey END) AS first_part,
  max(CASE WHEN i = 1 THEN CAST(l_quantity AS BIGINT) END) AS second_qty, NULL::BIGINT AS absent
FROM l GROUP BY l_orderkey""")
def resolve_path(spark, d):
    return parsed(spark, d).select(
        "l_orderkey",
        variants.resolve_path("doc", "meta.count", "bigint").alias("lines"),
        variants.resolve_path("doc", "data[0].part", "bigint").alias("first_part"),
        variants.resolve_path("doc", "data[1].qty.value", "bigint").alias("second_qty"),
        variants.resolve_path("doc", "data[0].nothing.here", "bigint").alias("absent"),
    )


@query("jsn3_records_by_path", f"""
WITH {LINES}
SELECT l_orderkey, CAST(i AS INTEGER) AS row_idx, CAST(l_partkey AS VARCHAR) AS part FROM l""")
def records_by_path(spark, d):
    rows = files.json_records(parsed(spark, d), "doc", "data")
    return rows.select("l_orderkey", "row_idx", F.col("record")["part"].alias("part"))


@query("jsn3_records_from_payload", f"""
WITH {LINES}, o AS (SELECT DISTINCT l_orderkey, n FROM l)
SELECT l_orderkey, CASE l_orderkey % 4 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN 3 ELSE 1 END AS n_rows,
  CASE l_orderkey % 4 WHEN 0 THEN 'line,part' WHEN 1 THEN 'line,part' WHEN 2 THEN 'value' ELSE 'meta.order,note' END AS keys
FROM o WHERE l_orderkey % 4 <> 0 OR n >= 2
UNION ALL
SELECT l_orderkey, 1, 'data.0.line,data.0.part' FROM o WHERE l_orderkey % 4 = 0 AND n = 1""")
def records_from_payload(spark, d):
    # four shapes: wrapped array, plain array, array of scalars, single object.
    # a wrapped array of one object is too short to count, so the object itself is the row
    rows = F.transform("items", lambda x: F.struct(x["line"].alias("line"), x["part"].alias("part")))
    shape = F.col("l_orderkey") % 4
    body = (
        F.when(shape == 0, F.concat(F.lit('{"data":'), F.to_json(rows), F.lit("}")))
        .when(shape == 1, F.to_json(rows))
        .when(shape == 2, F.concat(F.lit("["), F.col("l_orderkey").cast("string"), F.lit(',"x",null]')))
        .otherwise(F.concat(F.lit('{"meta":{"order":'), F.col("l_orderkey").cast("string"), F.lit('},"note":"n"}')))
    )
    docs = order_lines(spark, d).select("l_orderkey", F.try_parse_json(body).alias("doc"))
    out = files.json_records(docs, "doc")
    return out.groupBy("l_orderkey").agg(
        F.count("*").alias("n_rows"),
        F.max(F.array_join(F.array_sort(F.map_keys("record")), ",")).alias("keys"),
    )


@query("jsn4_flatten_record", f"""
WITH {LINES}
SELECT l_orderkey, CAST(i AS INTEGER) AS row_idx, CAST(l_linenumber AS VARCHAR) AS line,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty, 'pcs' AS unit,
  l_returnflag || ', z' AS flags, CAST(l_suppkey AS VARCHAR) AS supp FROM l""")
def flatten_record(spark, d):
    rows = files.json_records(parsed(spark, d), "doc", "data")
    r = F.col("record")
    return rows.select(
        "l_orderkey", "row_idx", r["line"].alias("line"), r["qty.value"].alias("qty"),
        r["qty.unit"].alias("unit"), r["flags"].alias("flags"), r["alt.0.supp"].alias("supp"),
    )


@query("jsn5_describe_payload", f"""
WITH {LINES}, o AS (SELECT DISTINCT l_orderkey, n FROM l)
SELECT l_orderkey, CASE WHEN n >= 2 THEN 'data' ELSE 'data[0].alt' END AS records_path,
  CASE WHEN n >= 2 THEN n ELSE 2 END AS n,
  CASE WHEN n >= 2 THEN 'alt,flags,line,part,qty' ELSE 'supp' END AS keys FROM o""")
def describe_payload(spark, d):
    found = variants.describe_payload(parsed(spark, d), "doc")
    return found.select(
        "l_orderkey", "payload.records_path", "payload.n",
        F.array_join("payload.keys", ",").alias("keys"),
    )


def cursor_documents(spark, d):
    """Orders as API responses whose cursor sits in different places."""
    key = F.col("o_orderkey").cast("string")
    shape = F.col("o_orderkey") % 6
    body = (
        F.when(shape == 0, F.concat(F.lit('{"data":[],"next_cursor":"c'), key, F.lit('"}')))
        .when(shape == 1, F.concat(F.lit('{"meta":{"next":"'), key, F.lit('"}}')))
        .when(shape == 2, F.concat(F.lit('{"next":null,"paging":{"after":'), key, F.lit("}}")))
        .when(shape == 3, F.lit('{"next":" ","items":[1]}'))
        .when(shape == 4, F.concat(F.lit('{"page":{"info":{"continuationToken":"'), key, F.lit('"}}}')))
        .otherwise(F.lit("[1,2]"))
    )
    return table(spark, d, "orders").select("o_orderkey", F.try_parse_json(body).alias("doc"))


@query("jsn6_cursor_field", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'next_cursor' WHEN 1 THEN 'meta.next' WHEN 2 THEN 'paging.after'
  WHEN 4 THEN 'page.info.continuationToken' END AS cursor FROM orders""")
def cursor_field(spark, d):
    return cursor_documents(spark, d).select("o_orderkey", variants.cursor_field("doc").alias("cursor"))


@query("pag3_api_plan", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'page_number' WHEN o_orderkey % 6 IN (0, 1, 2, 4) THEN 'cursor'
  ELSE 'none' END AS type,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CASE o_orderkey % 6 WHEN 0 THEN 'next_cursor' WHEN 1 THEN 'meta.next'
    WHEN 2 THEN 'paging.after' WHEN 4 THEN 'page.info.continuationToken' END END AS cursor_path FROM orders""")
def api_plan(spark, d):
    url = F.concat(
        F.lit("https://api.example.org/o"), F.when(F.col("o_orderkey") % 5 == 0, "?page=4").otherwise("")
    )
    df = cursor_documents(spark, d).withColumn("url", url)
    return df.select("o_orderkey", pagination.api_plan("url", "doc").alias("p")).select(
        "o_orderkey", "p.type", "p.cursor_path"
    )


@query("pag5_next_cursor_url", """
SELECT o_orderkey, 'https://api.example.org/o?size=5&q=a+b&next_cursor=' || 'c%2F' || o_orderkey AS next_url FROM orders""")
def next_cursor_url(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", F.lit("https://api.example.org/o?size=5&next_cursor=old&q=a%20b#f").alias("url"),
        F.concat(F.lit("c/"), F.col("o_orderkey").cast("string")).alias("cursor"),
    )
    return df.select(
        "o_orderkey",
        pagination.next_cursor_url("url", F.lit("meta.next_cursor"), F.col("cursor")).alias("next_url"),
    )


@query("jsn7_api_score", """
WITH p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 0.2 ELSE 0 END AS hint, p_size AS n,
  p_partkey % 11 AS k FROM part)
SELECT p_partkey, round(greatest(0.05, least(0.97, 0.4 + hint + least(n / 50.0, 1.0) * 0.2 + least(k / 8.0, 1.0) * 0.15
  + CASE WHEN k >= 1 AND p_partkey % 3 = 0 THEN 0.05 ELSE 0 END)), 6) AS score FROM p""")
def api_score(spark, d):
    p = table(spark, d, "part")
    n_keys = (F.col("p_partkey") % 11).cast("int")
    keys = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(10)), lambda i: i < n_keys),
        lambda i: F.when((i == 0) & (F.col("p_partkey") % 3 == 0), "Results").otherwise(
            F.concat(F.lit("k"), i.cast("string"))
        ),
    )
    url = F.when(F.col("p_partkey") % 2 == 0, "https://h.example/api/x").otherwise("https://h.example/x")
    return p.select(
        "p_partkey", F.round(variants.api_score(url, keys, F.col("p_size")), 6).alias("score")
    )


@query("src32_classify_payload", f"""
WITH {LINES}, o AS (SELECT DISTINCT l_orderkey, n FROM l)
SELECT l_orderkey, CASE WHEN l_orderkey % 8 IN (0, 1, 2, 3) THEN 'records' WHEN l_orderkey % 8 = 4 THEN 'html'
    WHEN l_orderkey % 8 = 5 THEN 'text' ELSE 'empty' END AS kind,
  CASE l_orderkey % 8 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n_records FROM o""")
def classify_payload(spark, d):
    rows = F.to_json(F.transform("items", lambda x: F.struct(x["line"], x["part"])))
    shape = F.col("l_orderkey") % 8
    body = (
        F.when(shape == 0, F.concat(F.lit('```json\n{"data":{"results":'), rows, F.lit("}}\n```")))
        .when(shape == 1, F.concat(F.lit('{"items":[],"rows":'), rows, F.lit("}")))
        .when(shape == 2, F.lit('["a", 3]'))
        .when(shape == 3, F.concat(F.lit('{"order":'), F.col("l_orderkey").cast("string"), F.lit(',"ok":true}')))
        .when(shape == 4, F.lit("Here: <table><tr><td>1</td></tr></table>"))
        .when(shape == 5, F.lit("I could not find any data."))
        .when(shape == 6, F.lit('{"data":[],"meta":{"n":{}}}'))
        .otherwise(F.lit("  \n "))
    )
    docs = order_lines(spark, d).select("l_orderkey", body.alias("payload"))
    return variants.classify_payload(docs, "payload").select(
        "l_orderkey", "kind", F.size("records").cast("bigint").alias("n_records")
    )


@query("src32_payload_records", f"""
WITH {LINES}
SELECT l_orderkey, CAST(i AS INTEGER) AS row_idx, CAST(l_partkey AS VARCHAR) AS part FROM l WHERE l_orderkey % 2 = 0
UNION ALL SELECT DISTINCT l_orderkey, 0, CAST(l_orderkey AS VARCHAR) FROM l WHERE l_orderkey % 2 = 1""")
def payload_records(spark, d):
    rows = F.to_json(F.transform("items", lambda x: F.struct(x["line"].alias("line"), x["part"].alias("part"))))
    body = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit('{"output":{"records":'), rows, F.lit("}}"))).otherwise(
        F.concat(F.lit('{"extracted":{"part":'), F.col("l_orderkey").cast("string"), F.lit('},"log":[]}'))
    )
    docs = variants.classify_payload(order_lines(spark, d).select("l_orderkey", body.alias("t")), "t")
    items = each(docs.select("l_orderkey", "records"), F.col("records"), "row_idx", "item").drop("records")
    flat = variants.flatten_record(items, "item")
    return flat.select("l_orderkey", "row_idx", F.col("record")["part"].alias("part"))


@query("src4_json_document_rows", f"""
WITH {LINES}
SELECT l_orderkey, CAST(i AS INTEGER) AS row_idx, CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supp
FROM l WHERE n >= 2
UNION ALL
SELECT l_orderkey, CAST(k AS INTEGER), NULL, CAST(l_suppkey + k AS VARCHAR)
FROM (SELECT l_orderkey, l_suppkey, unnest(range(2)) AS k FROM l WHERE n = 1)""")
def json_document_rows(spark, d):
    rows = files.json_records(parsed(spark, d), "doc")
    r = F.col("record")
    return rows.select(
        "l_orderkey", "row_idx", r["part"].alias("part"),
        F.coalesce(r["alt.0.supp"], r["supp"]).alias("supp"),
    )


@query("src31_document_tables", """
WITH o AS (SELECT o_orderkey // 40 AS doc_id, row_number() OVER (PARTITION BY o_orderkey // 40 ORDER BY o_orderkey) - 1 AS i, * FROM orders)
SELECT doc_id, 1 AS _page, 1 AS _table, CAST(i AS INTEGER) AS row_idx, CAST(o_orderkey AS VARCHAR) AS key,
  o_orderstatus AS status, NULL AS text FROM o
UNION ALL SELECT DISTINCT doc_id, 2, CAST(NULL AS INTEGER), 0, NULL, NULL, 'Summary of ' || doc_id FROM o""")
def document_tables(spark, d):
    o = table(spark, d, "orders").withColumn("doc_id", F.floor(F.col("o_orderkey") / 40).cast("bigint"))
    rows = o.groupBy("doc_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))),
            lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderstatus"]),
        ).alias("rows")
    )
    header = F.array(F.array(F.lit("key"), F.lit("")))
    small = F.array(F.array(F.lit("only"), F.lit("header")))
    empty = F.array().cast("array<array<array<string>>>")
    pages = F.array(
        F.struct(F.lit(1).alias("number"), F.lit("ignored").alias("text"),
                 F.array(F.concat(header, F.col("rows")), small).alias("tables")),
        F.struct(F.lit(2).alias("number"),
                 F.concat(F.lit(" Summary of "), F.col("doc_id").cast("string"), F.lit(" ")).alias("text"),
                 empty.alias("tables")),
        F.struct(F.lit(3).alias("number"), F.lit("  ").alias("text"), empty.alias("tables")),
    )
    out = files.document_records(rows.select("doc_id", pages.alias("pages")))
    r = F.col("record")
    return out.select(
        "doc_id", "_page", "_table", "row_idx", r["key"].alias("key"), r["column_1"].alias("status"),
        r["text"].alias("text"),
    )


@query("cln16_recipe_hash", """
SELECT p_partkey, substr(sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}'), 1, 16) AS fingerprint
FROM part""")
def recipe_hash(spark, d):
    from pagemill.operators import clean

    p = table(spark, d, "part")
    return p.select(
        "p_partkey", clean.row_fingerprint(p, ["p_size", "p_partkey", "p_brand"]).alias("fingerprint")
    )


@query("pag1_query_params", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, p_name AS name FROM part""")
def query_params(spark, d):
    url = F.concat(
        F.lit("https://h.example/x?name="), F.replace(F.col("p_name"), F.lit(" "), F.lit("+")),
        F.lit("&size=0&blank=&size="), F.col("p_size").cast("string"), F.lit("#frag"),
    )
    df = table(spark, d, "part").select("p_partkey", urls.query_map(url).alias("q"))
    return df.select("p_partkey", F.col("q")["size"].alias("size"), F.col("q")["name"].alias("name"))
