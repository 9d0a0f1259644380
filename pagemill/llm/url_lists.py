"""Dated URL lists applied to captures as of their fetch time.

An entry of a list is a change: from `at` on, `pattern` is on the list (`added`) or
off it. Of changes of one list and pattern the latest not after the fetch time holds;
of equal times the one with the largest entry id. A pattern is a domain, which holds
for its subdomains, or a domain and leading path segments ("example.com/en"). Among
all entries active for a capture the longest pattern decides; on equal length an
allow list before a block list, then the list name that sorts last. `blocked` is true
if a block list decides.

Changes become validity intervals, clipped to time buckets; what holds at the start of
a bucket is carried in from the last earlier change. Captures meet the intervals by
pattern and bucket, so a frequent host is spread over time and is compared only with
changes of its own bucket, and no history is gathered in one task.

Captures without a url, host or time match nothing and are not blocked. Repeated
captures are judged once and reported each. Entries without a list, pattern, time or
state are ignored. Ports, user names, letter case of the host, queries and fragments
do not matter; empty path segments are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import unused

BUCKET_SECONDS = 6 * 3600
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: str) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def normal_pattern(pattern: str) -> Column:
    """Domain in lower case, then the path segments, joined by slashes."""
    parts = segments(F.col(pattern))
    return F.array_join(F.concat(F.array(F.lower(F.get(parts, F.lit(0)))), F.slice(parts, 2, F.size(parts))), "/")


def _bucket(time: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000)).cast("bigint")


def intervals(entries: DataFrame, low: int, high: int, seconds: int) -> DataFrame:
    """(key, bucket, since, until, list, allow): times in which a pattern is on a list,
    clipped to the buckets from low to high. `since` is the change that put it there."""
    last = F.max(F.struct("entry_id", "added", "allow"))
    changes = entries.groupBy("list", "key", "at").agg(last.alias("c"))
    changes = changes.select("list", "key", "at", "c.added", "c.allow", _bucket("at", seconds).alias("bucket"))
    following = F.lead("at").over(Window.partitionBy("list", "key", "bucket").orderBy("at"))
    within = changes.where(F.col("bucket").between(low, high)).withColumn("until", following)
    # one row for each pattern and bucket with changes: its last state, and when the next change comes
    ends = changes.groupBy("list", "key", "bucket").agg(
        F.max(F.struct("at", "added", "allow")).alias("c"), F.min("at").alias("first")
    )
    own = Window.partitionBy("list", "key").orderBy("bucket")
    carried = ends.select(
        "list", "key", "c.*", "bucket", F.lead("bucket").over(own).alias("next"), F.lead("first").over(own).alias("until")
    ).where("added")
    begin = F.greatest(F.col("bucket") + 1, F.lit(low))
    end = F.least(F.coalesce("next", F.lit(high)), F.lit(high))
    carried = carried.where(begin <= end).withColumn("bucket", F.explode(F.sequence(begin, end)))
    columns = ["key", "bucket", F.col("at").alias("since"), "until", "list", "allow"]
    return within.where("added").select(*columns).union(carried.select(*columns))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", time: str = "fetched_at",
             seconds: int = BUCKET_SECONDS) -> DataFrame:
    """captures with `blocked`, `n_active`, `decided_by`, `pattern` and `since`.

    entries: (entry_id, list, allow, pattern, added, at). Columns of captures with the
    added names are replaced."""
    added = ["blocked", "n_active", "decided_by", "pattern", "since"]
    base = captures.drop(*added)
    given = entries.dropna(subset=["list", "pattern", "at", "added"]).select(
        "entry_id", "list", F.coalesce("allow", F.lit(False)).alias("allow"), "added", "at",
        normal_pattern("pattern").alias("key"),
    ).where("key <> ''")
    once = base.select(F.col(url).alias("_url"), F.col(time).alias("_time")).dropna().distinct()
    once = once.withColumn("_bucket", _bucket("_time", seconds))
    # four numbers: the time span, and how deep domains and paths of the lists go
    span = once.agg(F.min("_bucket"), F.max("_bucket")).first()
    deep = given.select(F.split("key", "/").alias("p")).agg(
        F.max(F.size(F.split(F.col("p")[0], r"\."))), F.max(F.size("p") - 1)
    ).first()
    labels, depth = deep[0] or 0, deep[1] or 0
    named = once.select("_url", "_time", "_bucket", F.split(host("_url"), r"\.").alias("_labels"),
                        segments(F.regexp_extract("_url", PATH, 1)).alias("_path"))
    count, steps = F.size("_labels"), F.least(F.size("_path"), F.lit(depth))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.least(count, F.lit(labels)), F.lit(1))),
        lambda k: F.array_join(F.slice("_labels", count - k + 1, k), "."),
    )
    prefixes = F.transform(F.sequence(F.lit(0), steps), lambda k: F.array_join(F.slice("_path", 1, k), "/"))
    keys = named.select("_url", "_time", "_bucket", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes")).select(
        "_url", "_time", "_bucket", "_suffix", F.explode("_prefixes").alias("_prefix")
    )
    keys = keys.where("_suffix <> ''").select(
        "_url", "_time", F.col("_bucket").alias("bucket"),
        F.when(F.col("_prefix") == "", F.col("_suffix")).otherwise(F.concat_ws("/", "_suffix", "_prefix")).alias("key"),
    )
    valid = intervals(given, span[0] or 0, span[1] if span[1] is not None else -1, seconds)
    met = keys.join(valid, ["key", "bucket"]).where(
        (F.col("since") <= F.col("_time")) & (F.col("until").isNull() | (F.col("_time") < F.col("until")))
    )
    first = F.max(F.struct(F.length("key").alias("n"), "allow", "list", "key", "since")).alias("d")
    judged = met.groupBy("_url", "_time").agg(F.count("*").alias("_n"), first)
    link, moment, n, d = unused(base.columns, "_url", "_time", "_n", "_d")
    judged = judged.toDF(link, moment, n, d)
    same = F.col(url).eqNullSafe(F.col(link)) & F.col(time).eqNullSafe(F.col(moment))
    return base.join(judged, same, "left").select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.coalesce(~F.col(d)["allow"], F.lit(False)).alias("blocked"),
        F.coalesce(n, F.lit(0)).cast("bigint").alias("n_active"),
        F.col(d)["list"].alias("decided_by"), F.col(d)["key"].alias("pattern"), F.col(d)["since"].alias("since"),
    )
