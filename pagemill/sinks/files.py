"""Writers and the run store. A dataset is a folder of files written in parallel."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import flatten_for_export

FORMATS = ("csv", "tsv", "jsonl", "parquet")


class EmptyDataset(ValueError):
    """An empty dataset is never exported."""


class FormatLimit(ValueError):
    """A dataset that a format cannot hold, or a format that is not known."""


def format_limit(schema: T.StructType, fmt: str) -> str | None:
    """Why a format cannot hold columns of this schema; None if it can."""
    if fmt not in FORMATS:
        return f"unknown export format '{fmt}'"
    if not schema.fields:
        return "the dataset has no columns"
    if fmt in ("csv", "tsv"):
        return None  # nested cells become JSON text
    names = [f.name.lower() for f in schema]
    if len(set(names)) < len(names):
        return f"{fmt} needs column names that differ"
    without = [f.name for f in schema if f.dataType.simpleString() == "void"]
    if fmt == "parquet" and without:
        return f"parquet needs a type for {', '.join(without)}"
    return None


def available_formats(df: DataFrame) -> DataFrame:
    """(format, ok, reason) for every format that is known."""
    rows = [(f, format_limit(df.schema, f)) for f in FORMATS]
    return df.sparkSession.createDataFrame([(f, r is None, r) for f, r in rows], "format string, ok boolean, reason string")


def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder below spark.checkpoint.dir, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read back, so that what reads
    them several times computes them once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_dataset(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    """Refuses unknown formats, datasets that the format cannot hold and empty ones;
    nothing is written then. Nested cells become JSON text in delimited files."""
    if reason := format_limit(df.schema, fmt):
        raise FormatLimit(reason)
    if df.isEmpty():
        raise EmptyDataset("the dataset is empty, nothing was exported")
    if fmt in ("csv", "tsv"):
        sep = "," if fmt == "csv" else "\t"
        flatten_for_export(df).write.mode(mode).option("header", True).option("sep", sep).option(
            "escape", '"'
        ).csv(path)
    elif fmt == "jsonl":
        # null cells are written, so a column that is empty in a file survives
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    else:
        df.write.mode(mode).parquet(path)


def json_array(df: DataFrame, row_id: str, per_block: int = 1000) -> DataFrame:
    """(block, records): JSON arrays of blocks of rows by key range, so that no
    array holds the whole dataset."""
    return df.groupBy(F.floor(F.col(row_id) / per_block).alias("block")).agg(
        F.to_json(
            F.array_sort(F.collect_list(F.struct(row_id, *[c for c in df.columns if c != row_id])))
        ).alias("records")
    )


RUN_SCHEMA = (
    "run_id string, created_at timestamp, source_url string, method string, n_rows bigint,"
    " n_columns int, title string, recipe_hash string, has_data boolean"
)


def save_run(root: str, run_id: str, clean: DataFrame, raw: DataFrame | None, manifest: dict) -> None:
    """Writes the clean (and raw) dataset below the run and appends one manifest
    row. A repeated attempt replaces only its own partition."""
    clean.write.mode("overwrite").parquet(f"{root}/dataset/run_id={run_id}")
    if raw is not None:
        raw.write.mode("overwrite").parquet(f"{root}/raw/run_id={run_id}")
    spark = clean.sparkSession
    row = {"run_id": run_id, "has_data": True, **manifest}
    names = [f.split()[0] for f in RUN_SCHEMA.split(",")]
    spark.createDataFrame([tuple(row.get(n) for n in names)], RUN_SCHEMA).write.mode("append").json(
        f"{root}/manifest"
    )


def load_run(spark: SparkSession, root: str, run_id: str, name: str = "dataset") -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/run_id={run_id}")


def list_runs(spark: SparkSession, root: str, limit: int = 50) -> DataFrame:
    """Newest runs first."""
    runs = spark.read.schema(RUN_SCHEMA).json(f"{root}/manifest")
    return newest_runs(runs, limit)


def newest_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(limit)


def save_recipe(spark: SparkSession, root: str, run_id: str, recipe_json: str) -> None:
    spark.createDataFrame([(run_id, recipe_json)], "run_id string, recipe string").write.mode(
        "append"
    ).json(f"{root}/recipes")


def load_recipe(spark: SparkSession, root: str, run_id: str) -> str | None:
    rows = spark.read.schema("run_id string, recipe string").json(f"{root}/recipes").where(
        F.col("run_id") == run_id
    )
    first = rows.head()
    return first["recipe"] if first else None
