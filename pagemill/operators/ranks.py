"""Row numbers within groups, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.files import kept

_PART = 33  # bits of a row's place within its partition


def ranked(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """df with `out`, the number of each row in its group in that order, from 1. Rows of
    equal order are numbered in any order; nulls are a group and come first.

    Rows are dealt by ranges of (group, order) and written with their places, so a large
    group lies in many partitions. What a partition has of a group is one stretch: a row's
    number is its distance from the first row of the stretch, and the lengths of the
    group's earlier stretches.
    """
    df = kept(df, "unranked")  # ranges are sampled first, so the rows are read twice
    spread = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = kept(spread.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", _PART)
    stretches = placed.groupBy(part.alias("__part"), *group).agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    # a row for each partition that a group touches
    own = stretches.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__part", "first", "n"))).alias("s"))
    running = F.aggregate(
        "s", F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("before")),
        lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.array_append(a["before"], a["sum"]).alias("before")),
        lambda a: a["before"],
    )
    bases = own.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.explode(F.arrays_zip("s", running.alias("b"))).alias("x"))
    bases = bases.select(*[f"__g{i}" for i in range(len(group))], F.col("x.s.__part").alias("__p"), (F.col("x.b") - F.col("x.s.first")).alias("__base"))
    same = [part == F.col("__p"), *[F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]]
    joined = placed.join(bases, same)
    return joined.select(*df.columns, (F.col("__at") + F.col("__base") + 1).alias(out))
