"""Queries on tables: cleaning, columns, duplicates, quality, charts, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text, values
from pagemill.operators import charts, clean, columns, dedupe, evidence, mapping, quality
from pagemill.operators.quality import Field
from pagemill.plans import recipe as R

from .base import query, table


def dirty_orders(spark, d):
    """Orders with their values written the way people write them."""
    o = table(spark, d, "orders")
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    grouped = F.format_number(x, 2)
    shape = (k % 10).cast("int")
    price = F.get(
        F.array(
            F.concat(F.lit("$"), grouped), F.concat(F.lit("("), grouped, F.lit(")")),
            F.concat(F.translate(grouped, ",.", ".,"), F.lit(" €")), F.lit("N/A"),
            F.concat(F.lit("no price "), k.cast("string")), F.concat(F.lit(" "), x.cast("decimal(18,2)").cast("string"), F.lit("\t")),
            F.concat(F.lit("EUR "), grouped), F.format_number(F.floor(x), 0), F.lit("-"),
            F.concat(F.lit("-"), x.cast("decimal(18,2)").cast("string")),
        ),
        shape,
    )
    day = F.col("o_orderdate")
    when = F.get(
        F.array(
            F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "yyyy/MM/dd"),
            F.date_format(day, "d MMM yyyy"), F.date_format(day, "MMMM d, yyyy"), F.lit("soon"),
            F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(day, "dd.MM.yyyy"),
        ),
        (k % 8).cast("int"),
    )
    return o.select(
        "o_orderkey", price.alias("price"), when.alias("ordered"),
        F.concat((k % 100).cast("string"), F.when(k % 4 == 0, "").otherwise(F.lit("%"))).alias("share"),
        F.get(F.array(*[F.lit(v) for v in ("Yes", " no ", "TRUE", "0", "y")]), (k % 5).cast("int")).alias("paid"),
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.when(k % 3 == 0, "  x \n").otherwise("")).alias("note"),
        F.get(F.array(*[F.lit(v) for v in ("n/a", "--", "F", "غير متاح", "None", "ok")]), (k % 6).cast("int")).alias("state"),
    )


PRICE = """CASE o_orderkey % 10 WHEN 1 THEN -o_totalprice WHEN 9 THEN -o_totalprice WHEN 3 THEN NULL WHEN 4 THEN NULL
  WHEN 8 THEN NULL WHEN 7 THEN floor(o_totalprice) ELSE o_totalprice END"""


@query("cln1_trim_whitespace", r"""
SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' x' ELSE '' END AS note FROM orders""")
def trim_whitespace(spark, d):
    return clean.trim_whitespace(dirty_orders(spark, d).select("o_orderkey", "note"), ["note"])


@query("cln2_normalize_missing", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 'F' WHEN 5 THEN 'ok' END AS state FROM orders""")
def normalize_missing(spark, d):
    return clean.normalize_missing(dirty_orders(spark, d).select("o_orderkey", "state"), ["state"])


@query("cln3_parse_number", f"SELECT o_orderkey, {PRICE} AS price, o_orderkey % 10 = 4 AS failed FROM orders")
def parse_number(spark, d):
    return dirty_orders(spark, d).select(
        "o_orderkey", values.parse_number("price").alias("price"), values.number_failed("price").alias("failed")
    )


@query("cln4_numeric_conversion", f"""
SELECT o_orderkey, {PRICE} AS price,
  CASE WHEN o_orderkey % 10 = 4 THEN 'no price ' || o_orderkey END AS price__raw,
  CASE o_orderkey % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN '--' WHEN 2 THEN 'F' WHEN 3 THEN 'غير متاح' WHEN 4 THEN 'None' ELSE 'ok' END AS state
FROM orders""")
def numeric_conversion(spark, d):
    # state fails in a third of its rows and is converted too unless left out
    df = dirty_orders(spark, d).select("o_orderkey", "price", "state")
    return clean.numeric_conversion(df, ["price"])


@query("cln4_conversion_failures", """
SELECT 'price' AS "column", count(*) AS cells, count(*) FILTER (WHERE o_orderkey % 10 = 4) AS failures,
  count(*) FILTER (WHERE o_orderkey % 10 NOT IN (3, 4, 8)) AS converted, 0::BIGINT AS percent_cells FROM orders
UNION ALL SELECT 'share', count(*), 0, count(*), count(*) FILTER (WHERE o_orderkey % 4 <> 0) FROM orders
UNION ALL SELECT 'note', count(*), count(*), 0, 0 FROM orders""")
def conversion_failures(spark, d):
    return clean.number_stats(dirty_orders(spark, d), ["price", "share", "note"])


@query("cln5_parse_percentages", """
SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS share FROM orders""")
def parse_percentages(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "share")
    return clean.numeric_conversion(df, ["share"], percentages=True, keep_raw=False)


@query("cln6_parse_currency", """
SELECT p_partkey, round(p_retailprice, 2) AS price FROM part""")
def parse_currency(spark, d):
    marks = F.array(*[F.lit(m) for m in ("$", "€", "£", "¥", "₹", "USD", "eur ", "GBP", "SAR", "AED", "DZD")])
    mark = F.get(marks, (F.col("p_partkey") % 11).cast("int"))
    amount = F.format_number("p_retailprice", 2)
    written = F.when(F.col("p_partkey") % 2 == 0, F.concat(mark, amount)).otherwise(
        F.concat(amount, F.lit(" "), mark)
    )
    return table(spark, d, "part").select("p_partkey", values.parse_number(written).alias("price"))


@query("cln7_numeric_candidates", """
WITH f AS (SELECT * FROM orders)
SELECT 'price' AS "column", round(avg(CASE WHEN o_orderkey % 10 IN (1, 3, 4, 8) THEN 0 ELSE 1 END), 6) AS share,
  avg(CASE WHEN o_orderkey % 10 IN (1, 3, 4, 8) THEN 0 ELSE 1 END) >= 0.7 AS is_candidate FROM f
UNION ALL SELECT 'share', 1, TRUE
UNION ALL SELECT 'paid', round(avg((o_orderkey % 5 = 3)::INT), 6), FALSE FROM f UNION ALL SELECT 'note', 0, FALSE
UNION ALL SELECT 'state', 0, FALSE
UNION ALL SELECT 'ordered', round(avg((o_orderkey % 8 = 7)::INT) * 0, 6), FALSE FROM f""")
def numeric_candidates(spark, d):
    # yyyyMMdd-like dates do not occur; "0" is the only number among the yes/no words
    return clean.numeric_shares(dirty_orders(spark, d)).select(
        "column", F.round("share", 6).alias("share"), "is_candidate"
    )


@query("cln8_parse_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 5 THEN NULL
  WHEN o_orderkey % 8 = 7 AND day(o_orderdate) <= 12 THEN make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0)
  ELSE o_orderdate END AS ordered,
  CASE WHEN o_orderkey % 8 = 5 THEN 'soon' END AS ordered__raw FROM orders""")
def parse_dates(spark, d):
    return clean.parse_dates(dirty_orders(spark, d).select("o_orderkey", "ordered"), ["ordered"])


@query("cln9_date_candidates", """
SELECT 'ordered' AS "column", round(avg((o_orderkey % 8 NOT IN (3, 4, 5))::INT), 6) AS share,
  avg((o_orderkey % 8 NOT IN (3, 4, 5))::INT) >= 0.6 AS is_candidate FROM orders
UNION ALL SELECT 'updated_by', 0, TRUE
UNION ALL SELECT 'half', round(avg((o_orderkey % 2 = 0)::INT), 6), avg((o_orderkey % 2 = 0)::INT) >= 0.6 FROM orders
UNION ALL SELECT 'most', round(avg((o_orderkey % 3 <> 0)::INT), 6), avg((o_orderkey % 3 <> 0)::INT) >= 0.6 FROM orders""")
def date_candidates(spark, d):
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    df = dirty_orders(spark, d).select("o_orderkey", "ordered").withColumn("updated_by", F.lit("bob"))
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 2 == 0, day).otherwise("never").alias("half"), F.when(k % 3 != 0, day).otherwise("never").alias("most")
    )
    return clean.date_shares(df.join(o, "o_orderkey")).select("column", F.round("share", 6).alias("share"), "is_candidate")


@query("cln10_normalize_booleans", """
SELECT o_orderkey, o_orderkey % 5 IN (0, 2, 4) AS paid,
  CASE o_orderkey % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN '--' WHEN 2 THEN 'F' WHEN 3 THEN 'غير متاح' WHEN 4 THEN 'None' ELSE 'ok' END AS state
FROM orders""")
def normalize_booleans(spark, d):
    return clean.normalize_booleans(dirty_orders(spark, d).select("o_orderkey", "paid", "state"))


@query("cln11_category_columns", """
SELECT 'o_orderstatus' AS "column", count(*) AS n, count(DISTINCT o_orderstatus) AS n_distinct, TRUE AS is_category FROM orders
UNION ALL SELECT 'o_orderpriority', count(*), count(DISTINCT o_orderpriority), TRUE FROM orders
UNION ALL SELECT 'key', count(*), count(DISTINCT o_orderkey), FALSE FROM orders""")
def category_columns(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string").alias("key")
    )
    return clean.category_columns(df)


@query("cln11_normalize_categories", """
SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' x' ELSE '' END AS note,
  ' ' || o_orderkey || ' ' AS code FROM orders""")
def normalize_categories(spark, d):
    df = dirty_orders(spark, d).select(
        "o_orderkey", "note", F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("code")
    )
    return clean.normalize_categories(df, ["note", "code"])


@query("cln12_change_report", """
SELECT 'note' AS "column", count(*) AS changed_cells FROM orders
UNION ALL SELECT 'paid', count(*) FILTER (WHERE o_orderkey % 5 = 1) FROM orders
UNION ALL SELECT 'state', 0""")
def change_report(spark, d):
    return clean.change_counts(
        dirty_orders(spark, d), {c: text.squash(c) for c in ("note", "paid", "state")}
    )


@query("cln12_recipe_report", """
SELECT 'Trim whitespace' AS operation, count(*) + count(*) FILTER (WHERE o_orderkey % 5 = 1) + count(*) FILTER (WHERE o_orderkey % 10 = 5) AS changed_cells, 0::BIGINT AS conversion_failures FROM orders
UNION ALL SELECT 'Normalize missing tokens', count(*) FILTER (WHERE o_orderkey % 6 NOT IN (2, 5)) + count(*) FILTER (WHERE o_orderkey % 10 IN (3, 8)), 0 FROM orders
UNION ALL SELECT 'Numeric conversion', count(*) FILTER (WHERE o_orderkey % 10 NOT IN (3, 4, 8)) + count(*), count(*) FILTER (WHERE o_orderkey % 10 = 4) FROM orders
UNION ALL SELECT 'Parse dates', count(*), count(*) FILTER (WHERE o_orderkey % 8 = 5) FROM orders
UNION ALL SELECT 'Normalize booleans', count(*), 0 FROM orders""")
def recipe_report(spark, d):
    df = dirty_orders(spark, d)
    plan = R.Recipe(
        numeric_conversion=True, parse_percentages=True, parse_dates=True, normalize_booleans=True,
        numeric_columns=["price", "share"], date_columns=["ordered"],
    )
    done = R.apply_recipe(df, plan, "o_orderkey")
    return R.report_frame(df, done).select("operation", "changed_cells", "conversion_failures")


@query("cln12_recipe_rows", f"""
SELECT o_orderkey, {PRICE} AS price, (o_orderkey % 100) / 100.0::DOUBLE AS share, o_orderkey % 5 IN (0, 2, 4) AS paid,
  CASE o_orderkey % 6 WHEN 2 THEN 'F' WHEN 5 THEN 'ok' END AS state FROM orders""")
def recipe_rows(spark, d):
    plan = R.Recipe(
        numeric_conversion=True, parse_percentages=True, parse_dates=True, normalize_booleans=True,
        numeric_columns=["price", "share"], date_columns=["ordered"],
    )
    plan = R.Recipe.from_json(plan.to_json())
    done = R.apply_recipe(dirty_orders(spark, d), plan, "o_orderkey")
    return done.frame.select("o_orderkey", "price", "share", "paid", "state")


@query("cln15_redact", r"""
SELECT doc_id, regexp_replace(text,
  '(?i)\b((?:api[_-]?key|access[_-]?token|token|secret|password|signature)\s*[:=]\s*["'']?)[^\s"''&,;*]+',
  '\1***redacted***', 'g') AS safe_text FROM documents""")
def redact(spark, d):
    return table(spark, d, "documents").select("doc_id", text.redact("text").alias("safe_text"))


@query("cln15_redact_headers_and_urls", """
SELECT p_partkey, '***redacted***' AS auth, 'text/html' AS accept,
  'https://***redacted***@h.example/p?page=' || p_partkey || '&api_key=***redacted***' AS url FROM part""")
def redact_headers(spark, d):
    key = F.col("p_partkey").cast("string")
    headers = F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer t"), key), F.lit("Accept"), F.lit("text/html"))
    url = F.concat(F.lit("https://bob:pw@h.example/p?page="), key, F.lit("&api_key=s"), key)
    df = table(spark, d, "part").select(
        "p_partkey", text.redact_map(headers).alias("h"), text.redact_url(url).alias("url")
    )
    return df.select(
        "p_partkey", F.col("h")["Authorization"].alias("auth"), F.col("h")["Accept"].alias("accept"), "url"
    )


@query("cln17_numeric_forms", """
SELECT p_partkey, p_size || '.5%' AS written,
  list_sort(list_distinct([p_size || '.5', p_size || '5', p_size || ',5',
    CAST(p_size * 100 + 50 AS VARCHAR),
    rtrim(printf('%.3f', (p_size + 0.5) / 100), '0'),
    replace(rtrim(printf('%.3f', (p_size + 0.5) / 100), '0'), '.', ',')])) AS forms FROM part""")
def numeric_forms(spark, d):
    df = table(spark, d, "part")
    written = F.concat(F.col("p_size").cast("string"), F.lit(".5%"))
    return df.select(
        "p_partkey", written.alias("written"), F.array_sort(text.numeric_forms(written)).alias("forms")
    )


# ---- columns ------------------------------------------------------------------------


@query("prj1_standardize_columns", """
SELECT c_custkey AS customer_key, c_name AS name, c_name AS name_2, c_acctbal AS c_2024_balance, c_nationkey AS _source_page,
  c_mktsegment AS column_5 FROM customer""")
def standardize_columns(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("Customer  Key!"), F.col("c_name").alias("Name"), F.col("c_name").alias("name?"),
        F.col("c_acctbal").alias("2024 balance"), F.col("c_nationkey").alias("_source-page"),
        F.col("c_mktsegment").alias("***"),
    )
    return columns.standardize_columns(c)[0]


@query("prj2_add_provenance", """
SELECT doc_id, 'mine' AS _source_url, 'https://e.example/' || source AS origin, '2024-01-01T00:00:00' AS _retrieved_at,
  'table' AS _extraction_method FROM documents""")
def add_provenance(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("https://e.example/"), "source").alias("origin"), F.lit("mine").alias("_source_url")
    )
    return columns.add_provenance(docs, F.col("origin"), "table", "2024-01-01T00:00:00")


@query("prj3_hide_provenance", "SELECT doc_id, lang FROM documents")
def hide_provenance(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return columns.hide_provenance(columns.add_provenance(docs, "u", "m", "t"))


@query("prj4_apply_mapping", """
SELECT p_name AS name, p_retailprice AS price, p_partkey, p_size, 'u' AS _source_url FROM part""")
def apply_mapping(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", "p_name", "p_size", "p_retailprice", F.lit("u").alias("_source_url")
    )
    return columns.apply_mapping(p, {"name": "p_name", "price": "p_retailprice"})


@query("prj4_apply_mapping_strict", "SELECT p_name AS name, 'u' AS _source_url FROM part")
def apply_mapping_strict(spark, d):
    p = table(spark, d, "part").withColumn("_source_url", F.lit("u"))
    return columns.apply_mapping(p, {"name": "p_name"}, keep_extra=False)


@query("prj5_columns_chooser", "SELECT o_orderkey, o_orderstatus FROM orders")
def columns_chooser(spark, d):
    return columns.choose_columns(table(spark, d, "orders"), ["o_orderstatus", "o_orderkey", "gone"])


@query("prj6_flatten_for_export", """
SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"t":"' || event_type || '"}' AS nested,
  '["' || event_type || '","' || user_id || '"]' AS listed FROM events""")
def flatten_for_export(spark, d):
    e = table(spark, d, "events").select(
        "event_id",
        F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("t")).alias("nested"),
        F.array("event_type", F.col("user_id").cast("string")).alias("listed"),
    )
    return columns.flatten_for_export(e)


@query("set1_union_pages", """
SELECT o_orderkey AS id, o_totalprice AS total, NULL::DOUBLE AS price, NULL AS brand, 'o' AS _source_url FROM orders
UNION ALL SELECT p_partkey, NULL, p_retailprice, p_brand, NULL FROM part""")
def union_pages(spark, d):
    a = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("o").alias("_source_url"), F.col("o_totalprice").alias("total")
    )
    b = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand")
    )
    return columns.union_pages([a, b])


@query("set7_missing_and_extra", """
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'price' ELSE '' END AS missing,
  CASE WHEN n_nationkey % 2 = 0 THEN 'extra' ELSE '' END AS extra FROM nation""")
def missing_and_extra(spark, d):
    have = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("name"), F.lit("extra"))).otherwise(
        F.array(F.lit("name"), F.lit("price"))
    )
    missing, extra = columns.missing_and_extra(F.array(F.lit("name"), F.lit("price")), have)
    return table(spark, d, "nation").select(
        "n_nationkey", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra")
    )


@query("flt1_search_rows", """
SELECT doc_id, lang, source FROM documents
WHERE regexp_matches(CAST(doc_id AS VARCHAR), '(?i)SRC1[0-4]|^fr') OR regexp_matches(source, '(?i)SRC1[0-4]|^fr')
  OR regexp_matches(lang, '(?i)SRC1[0-4]|^fr')""")
def search_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return columns.search_rows(docs, "SRC1[0-4]|^fr")


@query("flt1_search_rows_literal", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE contains(lower(c_name), '00042') OR contains(lower(c_mktsegment), '00042') OR contains(CAST(c_custkey AS VARCHAR), '00042')""")
def search_rows_literal(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return columns.search_rows(c, "00042", literal=True)


# ---- duplicates ----------------------------------------------------------------------


@query("set2_drop_duplicates", """
SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang""")
def drop_duplicates(spark, d):
    return dedupe.drop_duplicates(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")


@query("set2_drop_duplicates_by_key", """
SELECT arg_min(o_orderkey, o_orderkey) AS o_orderkey, o_custkey, o_orderstatus,
  arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey, o_orderstatus""")
def drop_duplicates_by_key(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return dedupe.drop_duplicates(o, "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("set3_count_duplicates", """
SELECT count(*) AS n_rows, count(DISTINCT (lang, source)) AS distinct_rows,
  count(*) - count(DISTINCT (lang, source)) AS duplicate_rows FROM documents""")
def count_duplicates(spark, d):
    return dedupe.count_duplicates(table(spark, d, "documents"), ["lang", "source"])


@query("win6_validate_unique", """
SELECT 'text' AS "column", count(*) - count(DISTINCT text) AS repeated_values FROM documents""")
def validate_unique(spark, d):
    return dedupe.repeated_values(table(spark, d, "documents"), "text")


# ---- quality ----------------------------------------------------------------------------


def gapped_events(spark, d):
    """Events with gaps and a constant column."""
    e = table(spark, d, "events")
    return e.select(
        "event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "ts", F.lit("web").alias("channel"),
    )


GAPPED = """
e AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value, ts, 'web' AS channel FROM events)
"""


def _profile_sql(name, dtype, numeric=False, date=False):
    num = (
        f"CAST(min({name}) AS DOUBLE) AS min_value, CAST(max({name}) AS DOUBLE) AS max_value,"
        f" round_even(avg({name}), 4) AS mean_value"
        if numeric else "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS mean_value"
    )
    day = f"strftime(min({name}), '%Y-%m-%d')" if date else "NULL"
    return (
        f"SELECT '{name}' AS \"column\", '{dtype}' AS dtype, count(*) AS n_rows, count(*) - count({name}) AS missing,"
        f" round_even((count(*) - count({name})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,"
        f" count(DISTINCT {name}) AS n_unique, {num}, {day} AS first_day FROM e"
    )


PROFILE = " UNION ALL ".join(
    [
        _profile_sql("event_id", "bigint", True), _profile_sql("user_id", "bigint", True),
        _profile_sql("event_type", "string"), _profile_sql("value", "double", True),
        _profile_sql("ts", "TS", False, True), _profile_sql("channel", "string"),
    ]
)


@query("agg1_profile_columns", f"WITH {GAPPED} {PROFILE}")
def profile_columns(spark, d):
    p = quality.profile_columns(gapped_events(spark, d), "event_id")
    return p.select(
        "column", F.regexp_replace("dtype", "^timestamp.*", "TS").alias("dtype"), "n_rows", "missing", "missing_pct",
        "n_unique", "min_value", "max_value", "mean_value", F.substring("first_date", 1, 10).alias("first_day"),
    )


@query("agg1_column_examples", """
SELECT 'o_orderstatus' AS "column", (SELECT o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1) AS example
UNION ALL SELECT 'o_orderpriority', (SELECT o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 1)""")
def column_examples(spark, d):
    o = table(spark, d, "orders")
    return quality.profile_columns(o, "o_orderkey", ["o_orderstatus", "o_orderpriority"]).select("column", "example")


@query("agg2_profile_frame", f"""
WITH {GAPPED}
SELECT count(*) AS n_rows, 6::BIGINT AS n_columns, count(*) FILTER (WHERE event_type IS NULL) + count(*) FILTER (WHERE value IS NULL) AS missing_cells,
  round_even((count(*) FILTER (WHERE event_type IS NULL) + count(*) FILTER (WHERE value IS NULL)) * 100.0::DOUBLE / (count(*) * 6), 2) AS missing_pct,
  'channel' AS constant_columns,
  array_to_string(list_filter([
    CASE WHEN count(DISTINCT event_id) > 20 THEN 'event_id' END,
    CASE WHEN count(DISTINCT ts) > 20 AND count(DISTINCT ts) > 0.9 * count(ts) THEN 'ts' END,
    CASE WHEN count(DISTINCT user_id) > 20 AND count(DISTINCT user_id) > 0.9 * count(user_id) THEN 'user_id' END,
    CASE WHEN count(DISTINCT value) > 20 AND count(DISTINCT value) > 0.9 * count(value) THEN 'value' END],
    lambda x: x IS NOT NULL), ',') AS high_cardinality_columns,
  count(*) - count(DISTINCT (user_id, event_type, value, ts)) AS duplicate_rows,
  'ts:2,value:3' AS failures, 5::BIGINT AS conversion_failures, 'new column' AS schema_drift,
  array_to_string(list_filter(['One value only in: channel',
    CASE WHEN count(*) > count(DISTINCT (user_id, event_type, value, ts)) THEN format('{{:,}}', count(*) - count(DISTINCT (user_id, event_type, value, ts)))
      || ' rows repeat another row; none was removed.' END,
    '5 cells were not converted and kept as text.'], lambda x: x IS NOT NULL), '|') AS warnings FROM e""")
def profile_frame(spark, d):
    p = quality.profile_frame(gapped_events(spark, d), "event_id", {"value": 3, "ts": 2}, ["new column"])
    return p.select(
        F.array_join(F.transform(F.map_entries("failures"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("failures"),
        "conversion_failures", F.array_join("schema_drift", ",").alias("schema_drift"), F.array_join("warnings", "|").alias("warnings"),
        "n_rows", "n_columns", "missing_cells", "missing_pct",
        F.array_join("constant_columns", ",").alias("constant_columns"),
        F.array_join("high_cardinality_columns", ",").alias("high_cardinality_columns"), "duplicate_rows",
    )


@query("agg3_missingness", f"""
WITH {GAPPED}
SELECT 'event_type' AS "column", round_even(count(*) FILTER (WHERE event_type IS NULL) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM e
UNION ALL SELECT 'value', round_even(count(*) FILTER (WHERE value IS NULL) * 100.0::DOUBLE / count(*), 2) FROM e
UNION ALL SELECT unnest(['event_id', 'user_id', 'ts', 'channel']), 0.0""")
def missingness(spark, d):
    return quality.missingness(gapped_events(spark, d))


DICT_FIELDS = [
    Field("value", "number", label="Amount", name_source="user", notes="in EUR"),
    Field("event_type", "string", name_source="ai"),
]


@query("agg4_data_dictionary", f"""
WITH {GAPPED}
SELECT 'value' AS variable, 'Amount' AS label, 'double' AS dtype, round_even(count(*) FILTER (WHERE value IS NULL) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
  count(DISTINCT value) AS unique_count, 'u' AS source, 'api' AS extraction_method, 'user' AS name_source, 'in EUR' AS notes,
  CAST(arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS VARCHAR) AS example FROM e
UNION ALL SELECT 'event_type', 'event_type', 'string', round_even(count(*) FILTER (WHERE event_type IS NULL) * 100.0::DOUBLE / count(*), 2),
  count(DISTINCT event_type), 'u', 'api', 'ai', 'what happened', arg_min(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) FROM e
UNION ALL SELECT 'user_id', 'User', 'bigint', 0, count(DISTINCT user_id), 'u', 'api', 'source_native', '', CAST(arg_min(user_id, event_id) AS VARCHAR) FROM e
UNION ALL SELECT '_source_url', '_source_url', 'string', 0, 1, 'u', 'api', 'source_native', 'Provenance column added by the application.',
  substr(repeat('https://e.example/', 6), 1, 80)""")
def data_dictionary(spark, d):
    e = gapped_events(spark, d).withColumn("_source_url", F.lit("https://e.example/" * 6))
    out = quality.data_dictionary(
        e, "event_id", DICT_FIELDS, "u", "api", ["value", "event_type", "user_id", "_source_url"],
        labels={"user_id": "User"}, notes={"event_type": "what happened"},
    )
    return out.withColumn("example", F.coalesce("example", F.lit("")))


@query("join4_dictionary_labels", """
SELECT 'p_name' AS variable, 'Part name' AS label, 'user' AS name_source
UNION ALL SELECT 'p_brand', 'p_brand', 'source_native'""")
def dictionary_labels(spark, d):
    out = quality.data_dictionary(
        table(spark, d, "part"), "p_partkey", [Field("p_name", label="Part name", name_source="user")],
        columns=["p_name", "p_brand"],
    )
    return out.select("variable", "label", "name_source")


@query("val1_validate", """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS status FROM orders),
v AS (
  SELECT 'status' AS "column", 'required' AS rule, count(*) FILTER (WHERE status IS NULL) AS violations FROM o
  UNION ALL SELECT 'o_totalprice', 'min', count(*) FILTER (WHERE o_totalprice < 50000) FROM o
  UNION ALL SELECT 'o_totalprice', 'max', count(*) FILTER (WHERE o_totalprice > 400000) FROM o
  UNION ALL SELECT 'o_custkey', 'unique', count(*) - count(DISTINCT o_custkey) FROM o
  UNION ALL SELECT 'gone', 'missing_field', 1
  UNION ALL SELECT 'o_orderpriority', 'dtype', count(*) FROM o)
SELECT *, '''' || "column" || '''' || CASE rule WHEN 'required' THEN ' is required and lacks a value in ' || format('{:,}', violations) || ' rows'
  WHEN 'min' THEN ' is below its lower bound in ' || format('{:,}', violations) || ' rows' WHEN 'max' THEN ' is above its upper bound in ' || format('{:,}', violations) || ' rows'
  WHEN 'unique' THEN ' repeats a value ' || format('{:,}', violations) || ' times and should not' WHEN 'missing_field' THEN ' is required and no column of the data'
  ELSE ' holds another type in ' || format('{:,}', violations) || ' rows' END AS message FROM v WHERE violations > 0""")
def validate(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")))
    rules = [
        Field("status", required=True), Field("o_totalprice", "number", min_value=50000, max_value=400000),
        Field("o_custkey", "integer", unique=True), Field("gone", required=True),
        Field("o_orderpriority", "number"),
    ]
    return quality.validate(o, rules)


@query("val2_dtype_violations", """
SELECT 'price' AS "column", 'dtype' AS rule, count(*) FILTER (WHERE o_orderkey % 10 <> 5 AND o_orderkey % 10 <> 9
   AND NOT (o_orderkey % 10 = 7 AND o_totalprice < 1000)) AS violations FROM orders
UNION ALL SELECT 'ordered', 'dtype', count(*) FILTER (WHERE o_orderkey % 8 = 5) FROM orders
UNION ALL SELECT 'whole', 'dtype', count(*) FILTER (WHERE o_totalprice <> floor(o_totalprice)) FROM orders
UNION ALL SELECT 'link', 'dtype', count(*) FILTER (WHERE o_orderkey % 3 = 0) FROM orders
UNION ALL SELECT 'paid', 'dtype', count(*) FILTER (WHERE o_orderkey % 5 <> 3) FROM orders""")
def dtype_violations(spark, d):
    df = dirty_orders(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("whole"))
    df = df.join(o, df["o_orderkey"] == o["k"]).withColumn(
        "link", F.when(F.col("k") % 3 == 0, "ftp://x").otherwise("https://x.example/")
    )
    rules = [Field("price", "number"), Field("ordered", "date"), Field("whole", "integer"),
             Field("link", "url"), Field("paid", "boolean")]
    return quality.validate(df, rules).drop("message")


# ---- charts -----------------------------------------------------------------------------


def _describe(name):
    return (
        f"SELECT '{name}' AS \"column\", count({name}) AS n, round_even(avg({name}), 4) AS mean,"
        f" round_even(stddev_samp({name}), 4) AS std, round_even(min({name})::DOUBLE, 4) AS min,"
        f" round_even(quantile_cont({name}::DOUBLE, 0.25), 4) AS p25, round_even(quantile_cont({name}::DOUBLE, 0.5), 4) AS p50,"
        f" round_even(quantile_cont({name}::DOUBLE, 0.75), 4) AS p75, round_even(max({name})::DOUBLE, 4) AS max FROM lineitem"
    )


@query("agg5_numeric_summary", " UNION ALL ".join(
    _describe(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")))
def numeric_summary(spark, d):
    return charts.numeric_summary(
        table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
    )


@query("agg6_categorical_summary", """
WITH c AS (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS v, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS r FROM c)
SELECT "column", count(*) AS n_unique, string_agg(v || ' (' || n || ')', ', ' ORDER BY r) FILTER (WHERE r <= 5) AS top_values
FROM r GROUP BY "column" """)
def categorical_summary(spark, d):
    return charts.categorical_summary(
        table(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"]
    )


@query("agg7_group_sum", """
SELECT event_type, round(sum(value), 4) AS value FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, value FROM events) GROUP BY event_type""")
def group_sum(spark, d):
    e = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    return charts.group_aggregate(e, "event_type", "value", "sum").withColumn("value", F.round("value", 4))


@query("agg7_group_mean", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY o_orderstatus")
def group_mean(spark, d):
    return charts.group_aggregate(table(spark, d, "orders"), "o_orderstatus", "o_totalprice", "mean").withColumn(
        "o_totalprice", F.round("o_totalprice", 4)
    )


@query("agg7_group_count", "SELECT l_returnflag, count(l_quantity) AS l_quantity FROM lineitem GROUP BY l_returnflag")
def group_count(spark, d):
    return charts.group_aggregate(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "count")


@query("agg7_group_median", """
SELECT event_type, quantile_cont(value, 0.5) AS value
FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, value FROM events) GROUP BY event_type""")
def group_median(spark, d):
    e = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    return charts.group_aggregate(e, "event_type", "value", "median")


@query("agg8_frequency", """
SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY user_id
ORDER BY n DESC, CAST(user_id AS VARCHAR) LIMIT 25""")
def frequency(spark, d):
    return charts.frequency(table(spark, d, "events"), "user_id")


@query("agg9_histogram", """
WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT CAST(least(39, floor((value - lo) / (hi - lo) * 40)) AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY 1""")
def histogram(spark, d):
    return charts.histogram(table(spark, d, "events"), "value")


@query("agg9_histogram_by_color", """
WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_type, CAST(least(39, floor((value - lo) / (hi - lo) * 40)) AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY ALL""")
def histogram_by_color(spark, d):
    return charts.histogram(table(spark, d, "events"), "value", color="event_type")


@query("agg10_box_stats", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY event_type),
j AS (SELECT e.event_type, q1, q2, q3, value, value BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside
  FROM events e JOIN q USING (event_type))
SELECT event_type, q1, q2, q3, min(value) FILTER (WHERE inside) AS low, max(value) FILTER (WHERE inside) AS high,
  count(*) FILTER (WHERE NOT inside) AS outliers FROM j GROUP BY ALL""")
def box_stats(spark, d):
    return charts.box_stats(table(spark, d, "events"), "value", "event_type")


@query("agg11_heatmap", """
SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS "A", count(*) FILTER (WHERE l_returnflag = 'N') AS "N", count(*) FILTER (WHERE l_returnflag = 'R') AS "R"
FROM lineitem GROUP BY l_linestatus""")
def heatmap(spark, d):
    return charts.heatmap(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["A", "N", "R"])


@query("agg11_heatmap_cells", """
SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem
WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL GROUP BY l_suppkey, l_partkey""")
def heatmap_cells(spark, d):
    return charts.heatmap_cells(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("agg12_column_roles", """
SELECT * FROM (VALUES ('o_totalprice', 'numeric', 0), ('o_orderkey', 'numeric', 1), ('o_custkey', 'numeric', 2), ('year', 'numeric', 3),
  ('o_orderdate', 'date', 0), ('year', 'date', 1), ('o_orderstatus', 'categorical', 0), ('o_orderpriority', 'categorical', 1))
AS t("column", role, position)""")
def column_roles(spark, d):
    o = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), "o_totalprice", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority",
        F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("label"),
    )
    return charts.column_roles(o, "o_orderkey")


@query("agg12_suggest_charts", """
SELECT * FROM (VALUES (0, 'line', 'value over ts', 'ts', 'value'), (1, 'bar', 'value by event_type', 'event_type', 'value'),
  (2, 'scatter', 'event_id vs value', 'value', 'event_id'), (3, 'histogram', 'Distribution of value', 'value', NULL),
  (4, 'missingness', 'Missing values by column', NULL, NULL)) AS t(rank, kind, title, x, y)""")
def suggest_charts(spark, d):
    e = gapped_events(spark, d).select("value", "event_id", "ts", "event_type")
    return charts.suggest_charts(e, "event_id").drop("reason")


@query("win1_flag_outliers", """
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)
SELECT event_id, value, coalesce(abs(value - m) / sd > 3, FALSE) AS value_outlier_flag FROM events, s""")
def flag_outliers(spark, d):
    return clean.flag_outliers(table(spark, d, "events").select("event_id", "value"), ["value"])


@query("srt1_row_cap", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 500000")
def row_cap(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return charts.row_cap(table(spark, d, "lineitem"), keys, 500000)


@query("srt2_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def preview(spark, d):
    return charts.preview(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("srt3_sort_series", "SELECT ts, value FROM events ORDER BY ts, value")
def sort_series(spark, d):
    return charts.series(table(spark, d, "events"), "ts", "value")


@query("srt4_top_k", """
SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3""")
def top_k(spark, d):
    return charts.frequency(table(spark, d, "orders"), "o_orderpriority", 3)


@query("srt6_down_sample", """
SELECT * FROM lineitem WHERE ((l_orderkey * 48271 + 7 * 40692) % 2147483647) % 5 = 0""")
def down_sample(spark, d):
    return charts.down_sample(table(spark, d, "lineitem"), "l_orderkey", 5, seed=7)


# ---- fields and claims ----------------------------------------------------------------


def catalog_columns(spark, d):
    """A catalog of datasets, one per part, whose column names vary."""
    k = F.col("p_partkey") % 6
    names = (
        F.when(k == 0, F.array(*[F.lit(x) for x in ("Country", "Price", "notes")]))
        .when(k == 1, F.array(*[F.lit(x) for x in ("Nation", "unit price", "notes")]))
        .when(k == 2, F.array(*[F.lit(x) for x in ("البلد", "prise", "Country")]))
        .when(k == 3, F.array(*[F.lit(x) for x in ("countrry", "cost", "x")]))
        .when(k == 4, F.array(*[F.lit(x) for x in ("price_eur", "country name", "price2")]))
        .otherwise(F.array(*[F.lit(x) for x in ("a", "b", "zz")]))
    )
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("dataset_id"), F.posexplode(names).alias("ordinal", "column")
    )


@query("join1_match_fields", """
SELECT p_partkey AS dataset_id, r AS requested, CASE
    WHEN r = 'country' THEN ['Country', 'Nation', 'Country', 'countrry', 'country name', NULL][p_partkey % 6 + 1]
    ELSE ['Price', 'unit price', NULL, NULL, 'price_eur', NULL][p_partkey % 6 + 1] END AS matched_column,
  CASE WHEN r = 'country' THEN ['exact', 'synonym', 'exact', 'fuzzy', 'substring', 'none'][p_partkey % 6 + 1]
    ELSE ['exact', 'substring', 'none', 'none', 'substring', 'none'][p_partkey % 6 + 1] END AS method,
  CASE WHEN r = 'country' THEN ['high', 'high', 'high', 'low', 'medium', 'low'][p_partkey % 6 + 1]
    ELSE ['high', 'medium', 'low', 'low', 'medium', 'low'][p_partkey % 6 + 1] END AS confidence,
  CASE WHEN r = 'country' THEN p_partkey % 6 IN (3, 5) ELSE p_partkey % 6 IN (2, 3, 5) END AS needs_review
FROM part, (SELECT unnest(['country', 'price']) AS r)""")
def match_fields(spark, d):
    return mapping.match_fields(catalog_columns(spark, d), ["country", "price"])


@query("val6_mapping_guard", """
SELECT p_partkey AS dataset_id, 'Country' AS "column", 'country' AS requested FROM part WHERE p_partkey % 6 IN (0, 2)""")
def mapping_guard(spark, d):
    catalog = catalog_columns(spark, d)
    proposed = table(spark, d, "part").select(
        F.col("p_partkey").alias("dataset_id"),
        F.explode(F.array(*[F.lit(x) for x in ("Country", "Invented")])).alias("column"),
        F.lit("country").alias("requested"),
    )
    return mapping.mapping_guard(proposed, catalog)


def fact_pages(spark, d):
    """One page of facts per part."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("page_id"),
        F.concat(
            F.lit("The  Part "), F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit(" costs "),
            F.format_number("p_retailprice", 2), F.lit(" EUR, size "), F.col("p_size").cast("string"),
            F.lit(", share 0.0"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(" of all."),
        ).alias("text"),
    )


def claims(spark, d):
    p = table(spark, d, "part")
    share = (F.col("p_partkey") % 9 + 1).cast("string")
    options = F.array(
        F.struct(F.lit("name").alias("field"), F.upper("p_name").alias("value")),
        F.struct(F.lit("brand").alias("field"), F.concat(F.lit("("), F.replace("p_brand", F.lit("#"), F.lit(" #")), F.lit(")")).alias("value")),
        F.struct(F.lit("price").alias("field"), F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("value")),
        F.struct(F.lit("share").alias("field"), F.concat(share, F.lit("%")).alias("value")),
        F.struct(F.lit("made_up").alias("field"), F.concat(F.lit("factory "), F.col("p_brand")).alias("value")),
        F.struct(F.lit("empty").alias("field"), F.lit("  ").alias("value")),
    )
    return p.select(F.col("p_partkey").alias("page_id"), F.explode(options).alias("o")).select("page_id", "o.*")


@query("val3_check_value", """
WITH f AS (
  SELECT p_partkey, p_brand, p_size, p_partkey % 9 + 1 AS share, p_retailprice, unnest(['name', 'brand', 'price', 'share', 'made_up', 'empty']) AS f FROM part),
t AS (SELECT *, lower(p_brand || ' costs ' || format('{:,.2f}', p_retailprice) || ' eur, size ' || p_size || ', share 0.0' || share) AS nums FROM f),
h AS (
  SELECT *, CASE f WHEN 'name' THEN 'exact' WHEN 'empty' THEN 'empty'
    WHEN 'price' THEN CASE WHEN p_retailprice < 1000 THEN 'exact' ELSE 'numeric' END
    WHEN 'share' THEN CASE WHEN contains(nums, share::VARCHAR) THEN 'normalized' ELSE 'none' END
    ELSE '?' END AS how FROM t)
SELECT p_partkey AS page_id, f AS field, how, how <> 'none' AS supported FROM h WHERE f NOT IN ('brand', 'made_up')
UNION ALL SELECT p_partkey, f, 'numeric', TRUE FROM h WHERE f IN ('brand', 'made_up')""")
def check_value(spark, d):
    out = evidence.check_values(claims(spark, d), fact_pages(spark, d))
    return out.select("page_id", "field", "how", "supported")


@query("val3_unsupported_value", "SELECT p_partkey AS page_id, 'none' AS how, FALSE AS supported FROM part")
def unsupported_value(spark, d):
    made = table(spark, d, "part").select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit("factory in "), F.col("p_type")).alias("value")
    )
    return evidence.check_values(made, fact_pages(spark, d)).select("page_id", "how", "supported")


@query("join2_evidence_join", """
SELECT p_partkey AS page_id, 'price' AS field FROM part UNION ALL SELECT p_partkey, 'share' FROM part""")
def evidence_join(spark, d):
    numeric = claims(spark, d).where("field in ('price', 'share')")
    return evidence.numeric_support(numeric, fact_pages(spark, d)).select("page_id", "field")


@query("val4_check_records", """
SELECT p_partkey AS row_id, p_name AS name, NULL::VARCHAR AS maker, 1 AS blanked_cells FROM part WHERE p_partkey % 2 = 0""")
def check_records(spark, d):
    # odd records hold only invented cells and disappear
    p = table(spark, d, "part")
    even = F.col("p_partkey") % 2 == 0
    records = p.select(
        F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("page_id"),
        F.when(even, F.col("p_name")).otherwise("gadget nobody sells").alias("name"),
        F.lit("factory nowhere").alias("maker"),
    )
    return evidence.check_records(records, fact_pages(spark, d), ["name", "maker"]).drop("page_id")


@query("val5_evidence_ratio", """
SELECT p_partkey AS proposal_id, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 3 END::BIGINT AS n_values,
  CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END / 3.0::DOUBLE AS ratio,
  p_partkey % 2 = 0 AND p_partkey % 7 <> 0 AS accepted FROM part""")
def evidence_ratio(spark, d):
    p = table(spark, d, "part")
    p = p.join(fact_pages(spark, d), F.col("p_partkey") == F.col("page_id")).drop("page_id")
    proposed = F.array(
        F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("nobody"),
        # a true beginning of eighty characters does not make an invented claim true
        F.concat(F.substring(F.col("text"), 1, 90), F.lit(" invented words")), F.lit(" "),
    )
    proposed = F.transform(proposed, lambda v: F.when(F.col("p_partkey") % 7 == 0, F.lit("  ")).otherwise(v))
    made = p.select(
        F.col("p_partkey").alias("proposal_id"), F.col("p_partkey").alias("page_id"), F.explode(proposed).alias("value")
    )
    return evidence.evidence_ratio(made, fact_pages(spark, d))


@query("agg13_usage_totals", """
SELECT conv_id AS run_id, role AS purpose, count(*) AS calls, sum(length(text))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens
FROM conversations GROUP BY ALL""")
def usage_totals(spark, d):
    log = table(spark, d, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("role").alias("purpose"),
        F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"),
    )
    return evidence.usage_totals(log)
