"""From raw documents to packed token sequences, in stages.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. `run` applies them to the documents table; what a stage returns is
written as Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import containment, line_windows, packing, partenum, quality_rules
from pagemill.llm.queries import tokenizer
from pagemill.llm.storage import stored, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned rules of their language.

    Measures are written before they are judged: a filter on an expression of this size
    would be pushed down into copies of it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    whole = docs.select("doc_id", "lang", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    measured = stored(quality_rules.measure(whole).drop("text"), "measured")
    cutoffs = stored(quality_rules.learn(measured, labels, "lang"), "cutoffs")
    return quality_rules.judge(measured, cutoffs, "lang").where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of lines; those left without a word go."""
    out = line_windows.drop_repeated_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(line_windows.HAS_WORD)
    return out.where(left).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs less the (doc_id, text_hash) found."""
    key, digest = unused(docs.columns, "_id", "_hash")
    gone = stored(found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct(), "gone")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(digest))
    return docs.join(gone, same, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    found = partenum.near_duplicates(docs.select("doc_id", "text")).where("NOT is_first")
    return without(docs, found)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    found = containment.contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(stored(packing.pieces(docs, tokenizer("byte_bpe_50k.json")), "pieces"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

# tokenizers are beyond SQL; tests/llm holds a brute-force version of all stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
