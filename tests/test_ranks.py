"""Numbers within groups of any size."""

import random

from pyspark.sql import functions as F

from pagemill.operators import captures
from pagemill.operators.ranks import ranked


def test_numbers_with_a_large_group_and_nulls(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["big"] * 8 + ["b", None]), draw.choice([None, *range(5000)]), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(5)
    got = ranked(df, ["g"], ["o", "i"], "n")
    want, seen = {}, {}
    for g, o, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        seen[g] = want[g, o, i] = seen.get(g, 0) + 1
    assert {(r.g, r.o, r.i): r.n for r in got.collect()} == want


def test_one_group_is_dealt_over_tasks(spark):
    df = spark.range(50_000).select(F.lit(1).alias("g"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(df, ["g"], ["id"], "n")
        assert got.where("n <> id + 1").isEmpty() and got.count() == 50_000
        plan = got._jdf.queryExecution().toString()
        assert "Window" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_limits(spark):
    assert ranked(spark.createDataFrame([], "g int, o int"), ["g"], ["o"], "n").collect() == []
    rows = [(1, f"https://a.org/{i % 40}", i) for i in range(100)] + [(None, "https://a.org/x", 5)]
    df = spark.createDataFrame(rows, "run int, url string, seen int")
    whole = captures.crawl_frontier(df, "run", "url", "seen")
    assert sorted(r.position for r in whole.collect()) == sorted([1, *range(1, 41)])
    assert captures.crawl_frontier(df, "run", "url", "seen", 3).count() == 4
