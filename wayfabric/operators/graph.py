"""Weighted graphs as node and edge tables: building, components, subgraphs, connectivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfabric.operators.components import components


def build_graph(edges: DataFrame, a: str = "a", b: str = "b", length: str = "length") -> DataFrame:
    """Simple undirected edges (a, b, weight, healed), a < b: of parallel edges the shortest.

    Of equally short ones the flag of a traced edge wins over that of a bridge. Self-loops stay.
    """
    healed = F.coalesce(F.col("healed"), F.lit(False)) if "healed" in edges.columns else F.lit(False)
    rows = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.struct(F.col(length).alias("weight"), healed.alias("healed")).alias("m"))
    return rows.groupBy("a", "b").agg(F.min("m").alias("m")).select("a", "b", "m.weight", "m.healed")


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """Each undirected edge as two directed ones."""
    extra = list(columns)
    return edges.select("a", "b", *extra).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *extra))


def degrees(edges: DataFrame) -> DataFrame:
    """Rows (node_id, degree) over edge ends; nodes without edges are absent."""
    ends = edges.select(F.col("a").alias("node_id")).unionByName(edges.select(F.col("b").alias("node_id")))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the largest component; of equally large ones that with the smallest id."""
    labels = components(nodes, edges)
    top = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    keep = labels.join(F.broadcast(top), "component", "left_semi").select("node_id")  # one row
    return nodes.join(keep, "node_id", "left_semi")


#: Ids up to which a counted table is broadcast.
SMALL = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """The ids, to be broadcast if they are counted and few: then a large table is not shuffled to meet them."""
    return F.broadcast(ids) if ids.limit(SMALL + 1).count() <= SMALL else ids


def induced(nodes: DataFrame, edges: DataFrame, whole: bool = False) -> DataFrame:
    """Edges with both ends among ``nodes``; where these are ``whole`` components, one end tells."""
    ids = few(nodes.select("node_id"))
    if whole:
        return edges.join(ids.withColumnRenamed("node_id", "a"), "a", "left_semi")
    return edges.join(ids.withColumnRenamed("node_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("node_id", "b"), "b", "left_semi")


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes ``gone``."""
    ids = gone.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "a"), "a", "left_anti").join(ids.withColumnRenamed("node_id", "b"), "b", "left_anti")


def _shape(labels: DataFrame, tag: str) -> DataFrame:
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias(f"lcc_{tag}"),
        F.count(F.lit(1)).alias(f"num_components_{tag}"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(f"nodes_{tag}"),
    )


def connectivity_report(nodes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: sizes and component counts before and after healing, fractions of the nodes, 4 decimals."""
    first, last = _shape(components(nodes, before), "before"), _shape(components(nodes, after), "after")
    total = F.greatest(F.col("nodes_after"), F.lit(1))

    def share(c: Column) -> Column:
        return F.round(c / total, 4)

    counted = first.join(last).join(after.agg(F.count(F.lit(1)).alias("edges")))  # three single rows
    return counted.select(
        F.col("nodes_after").alias("nodes"),
        "edges",
        F.col("lcc_before").alias("lcc_before_heal"),
        F.col("lcc_after").alias("lcc_after_heal"),
        share(F.col("lcc_before")).alias("lcc_before_frac"),
        share(F.col("lcc_after")).alias("lcc_after_frac"),
        share(F.col("lcc_after") - F.col("lcc_before")).alias("connectivity_gain_frac"),
        "num_components_before",
        "num_components_after",
    )
