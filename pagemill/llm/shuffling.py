"""Global shuffle into shards by a two-pass external shuffle.

First pass: a seeded hash of a row's key and text scatters the rows uniformly into
buckets of about `bucket_bytes`. Second pass: every bucket is put in key order and
shuffled by Fisher-Yates (Spark's `shuffle`). The buckets, one after another, are a
permutation of the table; it is cut into `shards` consecutive stretches.

The same rows, seed and sizes give the same places, however rows arrive and whatever
the session's partitions, adaptive execution or repeated tasks: Spark draws from one
generator for each partition, bucket after bucket, so buckets lie in a number of
partitions that follows from their own number, and in each they come in order.

Law `rows`: the numbers of rows of any two shards differ by at most one. Slots count
from 0 in each shard without gaps. Null texts have size 1; a null key is a key like
any other. A source whose rows differ from one read to the next (a limit without an
order) is refused when it shows. Rows with equal key and text fall in one bucket in any order. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import shared_folder, unused

BUCKET_BYTES = 8 << 20
MAX_PARTITIONS = 20_000


def shuffle_to_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 7,
                      key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes all columns of docs with `shard` and `slot` below `path` as Parquet, in
    folders by shard, each file in slot order, and returns what was written."""
    base = docs.drop("shard", "slot")
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    total = base.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    buckets = max(shards, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(text)), F.lit(buckets)).alias("_bucket")
    # rows in each bucket, from the keys alone; one small row for each bucket
    counts = base.select(bucket).groupBy("_bucket").agg(F.count("*").alias("_n"))
    block = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocked = counts.withColumn("_block", F.floor(F.col("_bucket") / 4096))
    sums = blocked.groupBy("_block").agg(F.sum("_n").alias("_s"))
    order = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_s").over(order), F.lit(0)).alias("_before"),
                       F.sum("_s").over(Window.partitionBy()).alias("_total"))
    bases = blocked.join(sums, "_block").select(
        "_bucket", (F.col("_before") + F.coalesce(F.sum("_n").over(block), F.lit(0))).alias("_base"), "_n", "_total"
    )
    # first pass: the shuffle on the bucket; second pass: one array of one bucket's rows
    (order_of,) = unused(base.columns, "_order")
    rows = base.select(bucket, F.struct(F.xxhash64(F.col(key), F.lit(seed)).alias(order_of), *[F.col(f"`{c}`") for c in base.columns]).alias("_row"))
    # a set number of partitions, which adaptive execution leaves alone
    dealt = rows.repartition(min(-(-buckets // 2), MAX_PARTITIONS), "_bucket")
    filled = dealt.groupBy("_bucket").agg(F.collect_list("_row").alias("_rows")).join(bases, "_bucket", "left")
    # the table is read for the counts and again for the rows; they must agree
    moved = F.raise_error(F.lit("the table changed between two reads")).cast("bigint")
    filled = filled.withColumn("_base", F.when(F.size("_rows") == F.col("_n"), F.col("_base")).otherwise(moved))
    mixed = filled.sortWithinPartitions("_bucket").select("_base", "_total", F.shuffle(F.array_sort("_rows"), F.lit(seed)).alias("_rows"))
    placed = mixed.select("_base", "_total", F.posexplode("_rows").alias("_pos", "_row"))
    placed = placed.withColumn("_place", F.col("_base") + F.col("_pos")).withColumn(
        "shard", F.expr(f"cast((_place * {shards}) div _total as int)")
    )
    # the first place p of shard s is the least with p * shards >= s * total
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    out = placed.select(
        *[F.col("_row")[c].alias(c) for c in base.columns], "shard", (F.col("_place") - first).alias("slot")
    )
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def shuffled(docs: DataFrame, **options) -> DataFrame:
    return shuffle_to_shards(docs, shared_folder(docs.sparkSession, "shards"), **options)
