"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Shingles are five words (A-Z lower-cased, white space as in ASCII); an item of
fewer words is one shingle of all its words. An item of q shingles is contained
if at least 80 % of them are in the document. Jaccard similarity of a short item
and a long document says nothing, so items are searched by containment: the
sketch of an item is its floor(q / 5) + 1 smallest hashes. A document that holds
80 % of the item misses at most floor(q / 5) of its shingles and so has at least
one of the sketch: the search loses nothing. Items are partitioned by size (powers
of two). Each partition has its own largest sketch hash, and a document looks up
only those of its hashes that are below the bound of the partitions that it is
large enough for. Candidates are verified by exact intersection.

Null and empty texts and texts without words contain nothing, and such items are
contained nowhere. Repeated rows are judged each. Items with equal texts are each
reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import lower_ascii, with_windows, words
from .storage import stored

SHINGLE = 5
PERCENT = 80
MAX_BROADCAST_ROWS = 1_000_000  # sketch rows of three numbers each


def _words(text: str) -> Column:
    return words(lower_ascii(F.coalesce(F.col(text), F.lit(""))))


def _hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df with `_set`, the distinct window hashes of `_w` of all the given lengths."""
    for n in lengths:
        df = with_windows(df, "_w", f"_windows{n}", n)
    made = [f"_windows{n}" for n in lengths]
    return df.withColumn("_set", F.array_distinct(F.concat(*made))).drop("_w", *made)


def item_sets(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, number of words in a shingle, distinct hashes, their number)."""
    split = items.select(F.col(key).alias("_item"), _words(text).alias("_w")).where(F.size("_w") > 0)
    parts = [
        _hashes(split.where(F.size("_w") == n if n < SHINGLE else F.size("_w") >= n), [n]).withColumn("_length", F.lit(n))
        for n in range(1, SHINGLE + 1)
    ]
    return reduce(DataFrame.unionAll, parts).select("_item", "_length", "_set", F.size("_set").alias("_q"))


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                    item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc id, item id, n_item_shingles, n_shared, text_hash): one row per pair.
    `text_hash` is xxhash64 of the document's text, for tables that repeat ids."""
    sets = stored(item_sets(items, item_key, item_text), "item-sets")
    allowed = F.floor(F.col("_q") * (100 - PERCENT) / 100).cast("int")
    sketch = sets.select(
        "_item", "_q", F.floor(F.log2("_q")).cast("int").alias("_part"),
        F.slice(F.array_sort("_set"), 1, allowed + 1).alias("_sketch"),
    )
    # at most 32 partitions, whatever the number of items
    parts = sketch.groupBy("_part").agg(
        F.min("_q").alias("q"), F.max(F.array_max("_sketch")).alias("top"), F.sum(F.size("_sketch")).alias("n")
    ).collect()
    lengths = [r[0] for r in sets.select("_length").distinct().collect()] or [SHINGLE]  # 1 to 5
    rows = sketch.select("_item", "_q", F.explode("_sketch").alias("_h"))
    if sum(r["n"] for r in parts) <= MAX_BROADCAST_ROWS:
        rows = F.broadcast(rows)
    made = _hashes(docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_t"), _words(text).alias("_w")), lengths)
    bound = F.greatest(
        F.lit(-(2**63)).cast("bigint"),
        *[F.when(F.size("_set") * 100 >= r["q"] * PERCENT, F.lit(r["top"])) for r in parts],
        F.lit(-(2**63)).cast("bigint"),
    )
    looked = made.select(
        "_id", "_t", F.size("_set").alias("_n"), bound.alias("_bound"), "_set"
    ).select("_id", "_t", "_n", F.explode(F.filter("_set", lambda h: h <= F.col("_bound"))).alias("_h"))
    met = looked.join(rows, "_h").where(F.col("_n") * 100 >= F.col("_q") * PERCENT)
    # items of one document, folded before the exchange; at most as many as its hashes
    candidates = met.groupBy("_id", "_t").agg(F.collect_set("_item").alias("_items"))
    return verified(docs, candidates, sets, lengths, key, text, item_key)


def verified(docs, candidates, sets, lengths, key, text, item_key) -> DataFrame:
    """Pairs whose intersection, counted on the whole sets, is large enough."""
    texts = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    joined = candidates.join(texts, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_h")))
    made = _hashes(joined.select("_k", "_h", "_items", _words("_text").alias("_w")), lengths).select(
        "_k", "_h", F.explode("_items").alias("_item"), F.col("_set").alias("_doc")
    )
    pairs = made.join(sets.select("_item", "_set", "_q"), "_item")
    shared = F.size(F.array_intersect("_set", "_doc"))
    return pairs.select(
        F.col("_k").alias(key), F.col("_item").alias(item_key), F.col("_q").cast("bigint").alias("n_item_shingles"),
        shared.cast("bigint").alias("n_shared"), F.col("_h").alias("text_hash"),
    ).where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * PERCENT)
