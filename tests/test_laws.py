"""Laws of the table operators and of the sinks."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import captures, charts, clean, dedupe, quality
from pagemill.plans.recipe import Recipe, apply_recipe
from pagemill.sinks import files as sinks


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(i, f"  a{i % 7}  b ", "N/A" if i % 5 == 0 else f"${i},000.5", "yes" if i % 2 else "no") for i in range(200)]
    return spark.createDataFrame(rows, "id long, name string, price string, ok string")


def test_cleaning_twice_is_cleaning_once(messy):
    plan = Recipe(numeric_conversion=True, normalize_booleans=True, numeric_columns=["price"])
    once = apply_recipe(messy, plan, "id").frame
    twice = apply_recipe(once, plan, "id").frame
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)


def test_raw_frame_is_unchanged(messy):
    before = sorted(map(tuple, messy.collect()))
    apply_recipe(messy, Recipe(numeric_conversion=True, flag_outliers=True, drop_duplicates=True), "id")
    assert sorted(map(tuple, messy.collect())) == before


def test_recipe_round_trip_and_hash():
    plan = Recipe(parse_dates=True, duplicate_subset=["a"])
    assert Recipe.from_json(plan.to_json()) == plan and len(plan.hash()) == 16


def test_duplicates_add_up(spark):
    df = spark.createDataFrame([(i, i % 9 if i % 4 else None, "x") for i in range(100)], "id long, a int, b string")
    r = dedupe.count_duplicates(df, ["a", "b"]).first()
    assert r["distinct_rows"] + r["duplicate_rows"] == r["n_rows"] == 100
    kept = dedupe.drop_duplicates(df, "id", ["a", "b"])
    assert kept.count() == r["distinct_rows"]
    assert kept.agg(F.min("id")).first()[0] == 0


def test_mostly_failing_column_stays_text(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "1") for i in range(30)], "id long, c string")
    assert dict(clean.numeric_conversion(df, ["c"]).dtypes)["c"] == "string"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1001])
def test_quantiles_are_exact(spark, n):
    import numpy as np

    rng = random.Random(n)
    rows = [(g, float(rng.choice([1, 5, 5, rng.random() * 100]))) for g in ("a", None) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in charts.exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g in ("a", None):
        values = [v for k, v in rows if k == g]
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.quantile(values, p)), rel=1e-12)


def test_outliers_need_eight_values(spark):
    few = spark.createDataFrame([(float(i),) for i in [1, 1, 1, 1, 1, 1, 1000]], "v double")
    assert clean.flag_outliers(few).columns == ["v"]
    many = spark.createDataFrame([(1.0,)] * 30 + [(1000.0,), (None,)], "v double")
    flagged = clean.flag_outliers(many).where("v_outlier_flag").collect()
    assert [r["v"] for r in flagged] == [1000.0]


def test_sequence_stops_at_repeat_error_and_limit(spark):
    rows = [("r", 1, 200, "a", 3), ("r", 2, 200, "b", 3), ("r", 3, 200, "a", 3), ("r", 4, 200, "c", 3),
            ("e", 1, 200, "a", 3), ("e", 2, 500, "x", 3), ("e", 3, 200, "y", 3),
            ("z", 1, 200, "a", 0), ("l", 1, 200, "a", 4), ("l", 2, 200, "b", 4), ("l", 3, 200, "c", 4)]
    df = spark.createDataFrame(rows, "run_id string, page_no int, status int, body string, n_rows long")
    kept = captures.stop_conditions(df, max_rows=6).orderBy("run_id", "page_no").collect()
    assert [(r["run_id"], r["page_no"], r["rows_kept"]) for r in kept] == [
        ("e", 1, 3), ("l", 1, 4), ("l", 2, 2), ("r", 1, 3), ("r", 2, 3)]


def test_export_checks(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    with pytest.raises(sinks.EmptyDataset):
        sinks.write_dataset(empty, str(tmp_path / "x"), "csv")
    with pytest.raises(ValueError):
        sinks.write_dataset(empty, str(tmp_path / "x"), "xlsx")


@pytest.mark.parametrize("fmt", ["csv", "tsv", "jsonl", "parquet"])
def test_write_and_read_back(spark, tmp_path, fmt):
    from pagemill.sources.files import read_file

    df = spark.createDataFrame(
        [("A", 2020, 1.5, None), ('B, "q"', 2021, None, "n\tx"), ("C", 2022, 2.0, None)],
        "country string, year long, inflation double, note string")
    path = str(tmp_path / fmt)
    sinks.write_dataset(df, path, fmt)
    options = {} if fmt == "parquet" else {"schema": df.schema}
    back = read_file(spark, path, fmt, **options)
    key = lambda r: r[1]
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=key) == sorted(map(tuple, df.collect()), key=key)


def test_unknown_reader_is_refused(spark):
    from pagemill.sources.files import read_file

    with pytest.raises(ValueError):
        read_file(spark, "x.rds", "rds")


def test_recipe_store(spark, tmp_path):
    sinks.save_recipe(spark, str(tmp_path), "r1", Recipe().to_json())
    assert Recipe.from_json(sinks.load_recipe(spark, str(tmp_path), "r1")) == Recipe()
    assert sinks.load_recipe(spark, str(tmp_path), "none") is None


def test_empty_frame_fails_validation(spark):
    empty = spark.createDataFrame([], "a int")
    rules = quality.validate(empty, [quality.Field("a", required=True)]).collect()
    assert [(r["column"], r["rule"]) for r in rules] == [("*", "empty")]
