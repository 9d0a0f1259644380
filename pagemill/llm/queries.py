"""Registered queries of the operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containment, conversations, host_suffixes, huffman, lemp, line_windows, packing, partenum, prefix_counts, quality_rules, shuffling, suffix_tree, url_lists
from .storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- 7: quality rules

SQL_MEASURED = r"""
measured AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS stratum, w AS words,
    len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    len(w) - len(list_distinct(w)) AS n_not_distinct
  FROM (SELECT *, coalesce(text, '') AS t,
          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
        FROM documents) d),
wins AS (
  SELECT doc_id, unnest(range(1, n_words - 3)) AS i,
    unnest([array_to_string(words[j:j + 4], ' ') for j in range(1, n_words - 3)]) AS w
  FROM measured WHERE n_words >= 5),
twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM wins) WHERE c > 1),
rep AS (
  SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM twice) GROUP BY doc_id),
base AS (
  SELECT m.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    (n_words < 10 OR coalesce(r.n, 0) * 100 > n_words * 20) AS base_failed
  FROM measured m LEFT JOIN rep r USING (doc_id)),
values_of AS (
  SELECT b.doc_id, b.stratum, b.base_failed, x.name, least(floor(x.a * 200.0 / greatest(x.b, 1)), 200)::INTEGER AS bin
  FROM base b, LATERAL (SELECT unnest([
    {'name': 'symbols', 'a': n_symbols, 'b': word_chars}, {'name': 'capitals', 'a': n_capitals, 'b': word_chars},
    {'name': 'duplicate_lines', 'a': n_dup_lines, 'b': n_lines},
    {'name': 'repeated_words', 'a': n_repeat_words, 'b': n_words},
    {'name': 'long_words', 'a': word_chars, 'b': n_words * 20},
    {'name': 'few_distinct', 'a': n_not_distinct, 'b': n_words}]) AS x)),
hist AS (
  SELECT stratum, name, bin, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality <> 1) AS bad
  FROM values_of JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL GROUP BY ALL),
per AS (SELECT stratum, name, sum(good) AS n_good FROM hist GROUP BY ALL),
tried AS (
  SELECT p.stratum, p.name, c.cutoff, p.n_good::BIGINT AS n, sum(h.good)::BIGINT AS k, sum(h.bad)::BIGINT AS bad
  FROM per p, (SELECT unnest(range(1, 201)) AS cutoff) c, hist h
  WHERE h.stratum = p.stratum AND h.name = p.name AND h.bin >= c.cutoff AND p.n_good > 0 GROUP BY ALL),
passed AS (
  SELECT * FROM tried WHERE bad > k AND k <= n * (0.05 / 6) AND list_sum(list_transform(range(0, k + 1),
      lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05 / 6) + (n - i) * ln(1 - 0.05 / 6))))
    <= 0.05 / (SELECT count(*) FROM per)),
best AS (SELECT stratum, name, arg_max(cutoff, (bad - k) * 1000 + cutoff) AS cutoff FROM passed GROUP BY ALL),
hits AS (SELECT DISTINCT doc_id FROM values_of v JOIN best b ON v.stratum = b.stratum AND v.name = b.name AND v.bin >= b.cutoff)
"""


@query(
    "op7_quality_rules",
    "WITH " + SQL_MEASURED + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hits) AS kept FROM base""",
)
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    # measured once; the numbers are small, the texts are not carried on
    measured = quality_rules.stored(quality_rules.measure(docs).drop("text"), "measured")
    cutoffs = quality_rules.learn(measured, table(spark, folder, "labels"), "lang")
    return quality_rules.judge(measured, cutoffs, "lang").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


# --- 3: line dedup

SQL_LINES = r"""
line_docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {docs}),
line_wins AS (
  SELECT doc_id, unnest(range(1, len(ls) - 1)) AS i,
    unnest([array_to_string(ls[j:j + 2], chr(10)) for j in range(1, len(ls) - 1)]) AS w
  FROM line_docs WHERE len(ls) >= 3),
line_later AS (
  SELECT doc_id, i FROM (
    SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM line_wins
    WHERE regexp_matches(w, '[^\x20\x09-\x0D]')) WHERE r > 1),
line_gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM line_later) GROUP BY doc_id),
line_out AS (
  SELECT d.doc_id, len(ls) AS n_lines, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(
      [x FOR x, k IN ls IF NOT list_contains(gone, k)], chr(10)), '') END AS text
  FROM line_docs d LEFT JOIN line_gone g USING (doc_id))
"""


@query(
    "op3_line_windows",
    "WITH " + SQL_LINES.replace("{docs}", "documents")
    + "SELECT doc_id, coalesce(n_lines, 0) AS n_lines, n_removed, text FROM line_out",
)
def op3_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_windows.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


# --- 8: benchmark decontamination

SQL_CONTAINED = r"""
bench_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM benchmark),
bench_sets AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS n,
    unnest([array_to_string(w[j:j + least(5, len(w)) - 1], ' ') for j in range(1, greatest(len(w) - 3, 2))]) AS s
  FROM bench_words WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM {docs}),
doc_sets AS (
  SELECT DISTINCT doc_id, n, unnest([array_to_string(w[j:j + n - 1], ' ') for j in range(1, len(w) - n + 2)]) AS s
  FROM doc_words, (SELECT DISTINCT n FROM bench_sets) WHERE len(w) >= n),
bench_pairs AS (
  SELECT d.doc_id, b.item_id, count(*) AS n_shared FROM doc_sets d JOIN bench_sets b USING (n, s) GROUP BY ALL),
contained AS (
  SELECT doc_id, item_id, q AS n_item_shingles, n_shared
  FROM bench_pairs JOIN (SELECT item_id, count(*) AS q FROM bench_sets GROUP BY 1) USING (item_id)
  WHERE n_shared * 100 >= q * 80)
"""


@query(
    "op8_benchmark_containment",
    "WITH " + SQL_CONTAINED.replace("{docs}", "documents") + "SELECT doc_id, item_id, n_item_shingles, n_shared FROM contained",
)
def op8_benchmark_containment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pairs = containment.contained_items(docs, table(spark, folder, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_item_shingles", "n_shared")


# --- 4: n-gram Jaccard join

SQL_SIMILAR = r"""
gram_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[j:j + 4], ' ') for j in range(1, len(w) - 3)] END) AS s FROM gram_words),
gram_sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
gram_links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM grams x JOIN grams y USING (s)
    WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN gram_sizes p ON p.doc_id = a JOIN gram_sizes q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
gram_reach AS (
  SELECT doc_id, doc_id AS r FROM gram_words UNION SELECT g.doc_id, l.b FROM gram_reach g JOIN gram_links l ON l.a = g.r),
gram_class AS (SELECT doc_id, min(r) AS component_id FROM gram_reach GROUP BY 1)
"""


@query(
    "op4_partenum_join",
    "WITH RECURSIVE " + SQL_SIMILAR.replace("{docs}", "documents") + """
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM gram_class LEFT JOIN gram_sizes USING (doc_id)""",
)
def op4_partenum_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = partenum.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id")


# --- 9: best-fit packing; tokenizers are beyond SQL


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = stored(packing.pieces(docs, tokenizer("byte_bpe_50k.json")), "pieces")
    return packing.pack(made)


# --- 2: Huffman-coded token ids


@query("op2_huffman_ids")
def op2_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = huffman.round_trip(docs, tokenizer("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# --- 5: sharding; the permutation is the operator's own


@query("op5_external_shuffle")
def op5_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    rows = shuffling.shuffled(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int"), F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard"),
    )


# --- 10: URL filters

SQL_URL_LISTS = r"""
cap AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919) % 43200) AS fetched_at,
    lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS path
  FROM pages),
changes AS (
  SELECT event_id AS entry_id, event_type AS list, event_type = 'signup' AS allow, event_id % 5 < 3 AS added, ts AS moment,
    CASE event_id % 3 WHEN 0 THEN host WHEN 1 THEN CASE WHEN host LIKE '%.%.%' THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END
      ELSE host || '/' || path[1] END AS key
  FROM events JOIN cap ON page_id = user_id),
latest AS (
  SELECT list, key, moment, arg_max(added, entry_id) AS added, arg_max(allow, entry_id) AS allow FROM changes GROUP BY ALL),
valid AS (
  SELECT *, lead(moment) OVER (PARTITION BY list, key ORDER BY moment) AS until FROM latest),
labelled AS (SELECT *, string_split(host, '.') AS ls FROM cap),
suffix AS (SELECT page_id, fetched_at, path, unnest([array_to_string(ls[k:], '.') for k in range(1, len(ls) + 1)]) AS s FROM labelled),
keyed AS (
  SELECT page_id, fetched_at, s || CASE WHEN k = 0 THEN '' ELSE '/' || array_to_string(path[1:k], '/') END AS key
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS k FROM suffix)),
active AS (
  SELECT k.page_id, v.* FROM keyed k JOIN valid v USING (key)
  WHERE v.added AND v.moment <= k.fetched_at AND (v.until IS NULL OR k.fetched_at < v.until)),
decided AS (
  SELECT page_id, count(*) AS n_active, arg_max({'l': list, 'k': key, 'a': allow, 's': moment}, (length(key), allow, list)) AS d
  FROM active GROUP BY 1)
SELECT c.page_id, c.url, fetched_at, coalesce(NOT d.a, FALSE) AS blocked, coalesce(n_active, 0) AS n_active,
  d.l AS decided_by, d.k AS pattern, d.s AS since
FROM cap c LEFT JOIN decided USING (page_id)
"""


@query("op10_url_lists", "WITH " + SQL_URL_LISTS)
def op10_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every page is a capture, fetched at a minute that its id gives; every event is a
    change of a list (its type) about the page whose id is the event's user."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    captures = pages.withColumn(
        "fetched_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(page_id * 7919 % 43200 as int))")
    )
    about = pages.select(
        F.col("page_id").alias("user_id"), url_lists.host("url").alias("h"),
        F.get(url_lists.segments(F.regexp_extract("url", url_lists.PATH, 1)), F.lit(0)).alias("s"),
    )
    events = table(spark, folder, "events")
    parent = F.when(F.col("h").like("%.%.%"), F.regexp_replace("h", r"^[^.]*\.", "")).otherwise(F.col("h"))
    kind = F.col("event_id") % 3
    entries = events.join(about, "user_id").select(
        F.col("event_id").alias("entry_id"), F.col("event_type").alias("list"),
        (F.col("event_type") == "signup").alias("allow"),
        F.when(kind == 0, F.col("h")).when(kind == 1, parent).otherwise(F.concat("h", F.lit("/"), "s")).alias("pattern"),
        (F.col("event_id") % 5 < 3).alias("added"), F.col("ts").cast("timestamp_ntz").alias("at"),
    )
    return url_lists.evaluate(captures, entries)


# --- 1: probabilistic suffix tree; the model is beyond SQL


@query("op1_suffix_tree")
def op1_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score(table(spark, folder, "documents").select("doc_id", "text"))


# --- 6: HTML extraction


@query(
    "op6_host_suffixes",
    r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS h FROM pages),
bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(h1|p|br)>', ' ', 'g'), '</?b>', '', 'g') AS h FROM inner_html),
plain AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(h, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
    '\s+', ' ', 'g')) AS text FROM bare)
SELECT page_id, url, text, length(text) AS n_chars FROM plain""",
)
def op6_host_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    texts = host_suffixes.extract(table(spark, folder, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


# --- 13: token counts of prefixes; tokenizers are beyond SQL


@query("op13_prefix_counts")
def op13_prefix_counts(spark: SparkSession, folder: str) -> DataFrame:
    """kept_chars: the code points of the longest prefix within the limit."""
    docs = table(spark, folder, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"), "text")
    counted = prefix_counts.prefix_counts(docs, tokenizer("word_bpe_49k.json"), budgets=[2048])
    whole = prefix_counts.n_tokens(F.col("prefix_tokens"))
    return counted.select(
        "doc_id", F.coalesce("n_bytes", F.lit(0)).cast("bigint").alias("n_bytes"), whole.alias("n_tokens"),
        (whole > 2048).alias("over_limit"), F.get("fits", F.lit(0)).alias("kept_chars"),
    )


# --- 12: conversation structure repair

SQL_REPAIR = r"""
crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256))::BIGINT AS i)),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS k
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM given WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS r,
    count(*) OVER (PARTITION BY conv_id) AS n, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged),
marked AS (
  SELECT *, CASE WHEN body = '' THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'd'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY r), 1) || left(role, 1) AS pair
  FROM placed),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
-- cheapest (cost, edits) of rows r to n, from the start, after a system row, a user row, an assistant row
best AS (
  SELECT conv_id, n + 1 AS r, {'c': 0, 'e': ''} AS v0, {'c': 10, 'e': 'II'} AS vs, {'c': 5, 'e': 'I'} AS vu, {'c': 0, 'e': ''} AS va
  FROM marked WHERE r = n
  UNION ALL
  SELECT conv_id, r,
    least(w0, {'c': wu.c + 5, 'e': 'I' || wu.e}, {'c': wa.c + 10, 'e': 'II' || wa.e}),
    least(ws, {'c': wu.c + 5, 'e': 'I' || wu.e}, {'c': wa.c + 10, 'e': 'II' || wa.e}),
    least(wu, {'c': wa.c + 5, 'e': 'I' || wa.e}), least(wa, {'c': wu.c + 5, 'e': 'I' || wu.e})
  FROM (
    SELECT m.conv_id, m.r,
      least({'c': v0.c + 2, 'e': 'D' || v0.e}, {'c': vu.c + 1 + x, 'e': 'R' || vu.e},
        {'c': CASE l WHEN 's' THEN vs.c WHEN 'u' THEN vu.c ELSE 1000000 END + x, 'e': 'K' || CASE l WHEN 's' THEN vs.e ELSE vu.e END}) AS w0,
      least({'c': vs.c + 2, 'e': 'D' || vs.e}, {'c': vu.c + 1 + x, 'e': 'R' || vu.e},
        {'c': CASE l WHEN 'u' THEN vu.c ELSE 1000000 END + x, 'e': 'K' || vu.e}) AS ws,
      least({'c': vu.c + 2, 'e': 'D' || vu.e}, {'c': va.c + 1 + x, 'e': 'R' || va.e},
        {'c': CASE l WHEN 'a' THEN va.c ELSE 1000000 END + x, 'e': 'K' || va.e}) AS wu,
      least({'c': va.c + 2, 'e': 'D' || va.e}, {'c': vu.c + 1 + x, 'e': 'R' || vu.e},
        {'c': CASE l WHEN 'u' THEN vu.c ELSE 1000000 END + x, 'e': 'K' || vu.e}) AS wa
    FROM best b JOIN (SELECT conv_id, r, left(role, 1) AS l,
        CASE WHEN fault IN ('b', 'd') THEN 1000000 WHEN fault = 't' THEN 5 ELSE 0 END AS x FROM marked) m
      ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.r = b.r - 1)),
chosen AS (SELECT conv_id, v0.c AS cost, v0.e AS audit FROM best WHERE r = 1),
edits AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM chosen),
steps AS (
  SELECT conv_id, j, substr(audit, j, 1) AS e, length(replace(left(audit, j), 'I', '')) AS r FROM edits),
stays AS (
  SELECT s.conv_id, s.j, s.e, m.role, m.text, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.j) AS p
  FROM steps s LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.r = s.r AND s.e <> 'I' WHERE s.e <> 'D'),
roles AS (
  SELECT *, count(*) FILTER (p = 1 AND e = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id) AS led FROM stays),
hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (p - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS h FROM roles GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM g.conv_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Faults put into conversations by a checksum of conversation and turn. Dropped rows
    stay as rows that are not `present`."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    made = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return made.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).drop("copies", "copy")


@query("op12_conversation_repair", "WITH RECURSIVE " + SQL_REPAIR)
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = damaged(table(spark, folder, "conversations"))
    return conversations.repair_report(rows, present="present")


# --- 11: hard negatives


@query(
    "op11_hard_negatives",
    r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    usual = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = rows.where(usual).select(
        "vec_id", moved.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector")
    )
    return lemp.hard_negatives(scaled, F.col("vec_id") % 100 == 0)
