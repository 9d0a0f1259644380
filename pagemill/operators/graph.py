"""Link graph of captured pages as edge and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .links import page_links

MAX_NODES = 400


def link_edges(dom_pages: DataFrame, dom: str = "dom") -> DataFrame:
    """Distinct (src, dst), self links left out."""
    links = page_links(dom_pages, dom).select(F.col("url").alias("src"), F.col("link").alias("dst"))
    return links.where(F.col("src") != F.col("dst")).distinct()


def star_edges(df: DataFrame, root: str, url: str) -> DataFrame:
    """Distinct (src, dst) from a root to every address listed under it."""
    return df.select(F.col(root).alias("src"), F.col(url).alias("dst")).where("src <> dst").distinct()


def node_degree(edges: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """(url, in_degree, out_degree, degree[, depth]). Ends are counted with a
    partial aggregate, so a hub folds before the exchange."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    )
    nodes = ends.groupBy("e.url").agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree")
    ).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    if depths is not None:
        nodes = nodes.join(depths, "url", "left").na.fill(0, ["depth"])
    return nodes


def display_graph(edges: DataFrame, limit: int = MAX_NODES * 3) -> DataFrame:
    """First edges in address order, for a drawing."""
    return edges.orderBy("src", "dst").limit(limit)


def labelled(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("label", urls.url_label("url"))
