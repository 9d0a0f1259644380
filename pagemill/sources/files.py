"""File readers. Each returns an ordinary lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variants
from ..functions.text import each, map_last_wins, strip


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The separator that occurs most in the first line."""
    first = spark.read.text(path).head()
    line = first[0] if first else ""
    return max([",", ";", "\t", "|"], key=line.count)


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Delimited text with a header. Give a schema to avoid a pass for inference."""
    reader = spark.read.option("header", True).option("sep", sniff_delimiter(spark, path))
    reader = reader.option("multiLine", False).option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def read_tsv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", "\t").option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct columns spread into their leaves, names joined with '.'."""

    def leaves(schema, path=()):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(
        *[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema)]
    )


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON object per line, nested objects flattened."""
    reader = spark.read.schema(schema) if schema else spark.read
    return flatten_structs(reader.json(path))


def read_json_documents(spark: SparkSession, path: str, records_path: str | None = None,
                        per_line: bool = False) -> DataFrame:
    """One JSON document per file, or per line of many files: (file, row_idx, record)
    from a list, the best record array, or the object itself."""
    docs = spark.read.option("wholetext", not per_line).text(path).select(
        F.input_file_name().alias("file"), F.try_parse_json("value").alias("doc")
    )
    return json_records(docs, "doc", records_path)


def json_records(docs: DataFrame, doc: str, records_path: str | None = None) -> DataFrame:
    """(other columns, row_idx, record) of a column of parsed documents."""
    kept = [c for c in docs.columns if c != doc]
    rows = variants.records_of(docs, doc, records_path)
    items = each(rows.select(*kept, "records"), F.col("records"), "row_idx", "__item").drop("records")
    return variants.flatten_record(items, "__item").select(*kept, "row_idx", "record")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements called row_tag as rows of the schema (attributes with a leading _).

    Files are cut at the end tag by the text reader, so a large file is read by many
    tasks, and a file may hold any number of documents, each with its own declaration and
    root. Comments are no records, if they hold one end tag at most; an element is not
    looked for inside one of its own name. Elements that are not well-formed are left out."""
    pieces = spark.read.option("lineSep", f"</{row_tag}>").text(path)
    # a comment with an end tag inside goes on in the next piece
    text = F.regexp_replace("value", r"(?s)<!--.*?(?:-->|\z)|\A[^<]*-->", "")
    # what begins with the tag; the last of them is the one that the file was cut at
    begun = F.filter(F.split(text, rf"(?=<{row_tag}[\s/>])"), lambda x: F.startswith(x, F.lit(f"<{row_tag}")))
    head = rf"""^<{row_tag}(?:[^>"']|"[^"]*"|'[^']*')*>"""
    marked = F.transform(begun, lambda x, i: F.struct(x.alias("text"), F.regexp_extract(x, head, 0).alias("head"), i.alias("i")))
    whole = F.filter(marked, lambda x: (x["head"] != "") & (F.endswith(x["head"], F.lit("/>")) | (x["i"] == F.size(begun) - 1)))
    elements = F.transform(
        whole,
        lambda x: F.when(F.endswith(x["head"], F.lit("/>")), x["head"]).otherwise(F.concat(x["text"], F.lit(f"</{row_tag}>"))),
    )
    rows = pieces.select(F.explode(elements).alias("element"))
    parsed = F.from_xml("element", f"{schema}, __broken string", {"columnNameOfCorruptRecord": "__broken"})
    return rows.select(parsed.alias("r")).where("r.__broken IS NULL").select("r.*").drop("__broken")


def read_file(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """Reader by format name; formats without a distributed reader are refused."""
    readers = {
        "csv": read_csv, "text": read_csv, "tsv": read_tsv, "jsonl": read_jsonl,
        "json": read_json_documents, "parquet": read_parquet, "xml": read_xml,
    }
    if fmt not in readers:
        raise ValueError(f"no reader for format '{fmt}'")
    return readers[fmt](spark, path, **options)


def document_records(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """Rows of extracted documents: (..., _page, _table, row_idx, record).

    pages is array<struct<number,text,tables:array<array<array<string>>>>>. A page
    without tables gives one (page, text) record; tables under two rows give none.
    """
    kept = [c for c in documents.columns if c != pages]
    one = each(documents, F.col(pages), "__p", "page").drop(pages)
    grids = each(one, F.col("page.tables"), "__t", "grid").where(F.size("grid") >= 2)

    def record(row, header):
        names = F.transform(
            row,
            lambda _, i: F.coalesce(
                F.when(F.get(header, i) != "", F.get(header, i)),
                F.concat(F.lit("column_"), i.cast("string")),
            ),
        )
        cells = F.transform(row, lambda c: F.coalesce(c, F.lit("")))
        return map_last_wins(
            F.arrays_zip(names.alias("key"), cells.alias("value"))
        )

    body = each(
        grids.select(*kept, F.col("page.number").alias("_page"), (F.col("__t") + 1).alias("_table"),
                     F.get("grid", F.lit(0)).alias("header"),
                     F.slice("grid", F.lit(2), F.size("grid")).alias("body")),
        F.col("body"), "row_idx", "row",
    )
    tables = body.select(
        *kept, "_page", "_table", "row_idx", record(F.col("row"), F.col("header")).alias("record")
    )
    plain = one.where(
        (F.coalesce(F.size("page.tables"), F.lit(0)) <= 0) & (strip("page.text") != "")
    ).select(
        *kept, F.col("page.number").alias("_page"), F.lit(None).cast("int").alias("_table"),
        F.lit(0).alias("row_idx"),
        F.create_map(
            F.lit("page"), F.col("page.number").cast("string"),
            F.lit("text"), strip("page.text"),
        ).alias("record"),
    )
    return tables.unionByName(plain)
