"""The two whole-page flows: what is on the pages, and the rows of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import each
from ..operators import candidates as C
from ..operators import captures, columns, mapping
from ..sinks import files
from ..sources import html as H


def analyze(pages: DataFrame, preset: str = "auto") -> DataFrame:
    """pages(page_id, url, html) -> ranked candidate datasets per page.

    One scan, one parse; the only exchange carries the finished candidates.
    """
    profile = C.page_profile(H.shred_html(pages))
    return C.rank_candidates(C.all_candidates(profile), preset)


def extract(runs: DataFrame, selector: str | None = None, table_index: int | None = None,
            fields: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """captures(run_id, page_no, page_id, url, status, html) -> rows of the pages
    read before each run stops, with provenance.

    Every page is read and parsed once and reduced to its extracted rows and a digest
    of its body, which are written to the shared folder. Numbers alone decide where a
    run ends; the rows meet the pages that are kept once.
    """
    listed = C.row_lists(H.shred_html(runs), selector, table_index)
    pages = listed.select(
        "run_id", "page_no", "url", "status", F.sha2("html", 256).alias("body"), "source", "rows",
        F.coalesce(F.size("rows"), F.lit(0)).cast("bigint").alias("n_rows"),
    )
    kept = captures.stop_conditions(files.kept(pages, "extracted"), max_rows=max_rows)
    whole = F.slice("rows", F.lit(1), F.col("rows_kept").cast("int"))
    rows = each(kept, whole, "row_idx", "record")
    chosen = [F.col("record")[f].alias(f) for f in fields] if fields else [F.col("record")]
    named = rows.select(
        "run_id", "row_idx", *chosen, F.col("url").alias("_source_url"),
        F.col("page_no").alias("_source_page"), F.col("source").alias("_extraction_method"),
    )
    return columns.union_pages([named])


def best_rows(pages: DataFrame, preset: str = "auto", fields: list[str] | None = None,
              retrieved_at: str | None = None) -> DataFrame:
    """pages(page_id, url, html) -> the rows of each page's best candidate, of any kind,
    as (page_id, row_idx, record, _source_url, _extraction_method, _retrieved_at).

    With `fields`, a page's columns are matched to the requested names (same name,
    synonym, part of the name, spelling), and records hold those. `retrieved_at` names a
    column of pages. The chosen pages are written once to the shared folder; every kind
    of candidate then reads only its own.
    """
    own = pages.select("page_id", "url", "html", *[c for c in ("content_type", "status") if c in pages.columns],
                       (F.col(retrieved_at) if retrieved_at else F.lit(None)).cast("timestamp").alias("_retrieved_at"))
    best = C.rank_candidates(C.all_candidates(C.page_profile(H.shred_html(own.drop("_retrieved_at")))), preset)
    best = best.where("rank = 1").select("page_id", "kind", "id")
    chosen = files.kept(own.join(best, "page_id"), "chosen")
    rows = files.kept(C.candidate_rows(chosen.select("page_id", "url", "html", "kind", "id")), "rows")
    if fields:
        names = rows.select(F.col("page_id").alias("dataset_id"), F.posexplode(F.map_keys("record")).alias("ordinal", "column"))
        catalog = names.groupBy("dataset_id", "column").agg(F.min("ordinal").alias("ordinal"))
        found = mapping.match_fields(catalog, fields).where("matched_column is not null")
        wanted = found.groupBy(F.col("dataset_id").alias("page_id")).agg(
            F.collect_list(F.struct("requested", "matched_column")).alias("__wanted"))
        record = F.map_from_entries(F.transform(
            F.coalesce("__wanted", F.array().cast("array<struct<requested:string,matched_column:string>>")),
            lambda m: F.struct(m["requested"], F.try_element_at("record", m["matched_column"]))))
        rows = rows.join(wanted, "page_id", "left").select("page_id", "row_idx", record.alias("record"))
    origin = chosen.select("page_id", F.col("url").alias("_source_url"), F.col("kind").alias("_extraction_method"), "_retrieved_at")
    return rows.join(origin, "page_id")
