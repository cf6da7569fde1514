"""From fragments to a graph: ids, local edges, containment, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topolane.operators.resolve import edges_and_boundaries, resolve
from topolane.session import cut
from topolane.sources.extract import flat_nodes, flat_pending


def numbered(df: DataFrame, order: list[str], name: str = "node_id", parts: int | None = None) -> DataFrame:
    """Contiguous numbers from 0 in a global order, without one task that holds all rows.

    Rows are range-partitioned, numbered within their partition, and shifted by the sizes of the partitions before it
    (one row a partition).
    """
    spread = df.repartitionByRange(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__part", F.spark_partition_id())
    spread = cut(spread)
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    w = Window.partitionBy("__part").orderBy(*order)
    return spread.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.row_number().over(w) - 1).drop("__part", "__before")


def assemble(fragments: DataFrame, repo: str = "repo") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of fragments with a `repo` column; boundary nodes are numbered after the definitions."""
    frags = cut(fragments)  # parsed once; nodes, relations and references are read from it
    nodes = cut(numbered(flat_nodes(frags, [repo]).withColumnRenamed(repo, "repo"), ["repo", "path", "local_id"]))
    key = nodes.select("repo", "path", "local_id", "node_id", "kind")
    end = lambda name, extra=(): key.select("repo", "path", F.col("local_id").alias(name + "_local_id"), F.col("node_id").alias(name), *extra)
    local = frags.select(F.col(repo).alias("repo"), "path", F.explode("local_edges").alias("e")).select("repo", "path", "e.source_local_id", "e.target_local_id", "e.kind")
    local = local.join(end("source"), ["repo", "path", "source_local_id"]).join(end("target"), ["repo", "path", "target_local_id"])
    edges = local.select(F.col("source").alias("src"), F.col("target").alias("dst"), "kind", F.lit(None).cast("int").alias("line"))
    parent = nodes.where("parent_local_id is not null").join(end("parent"), ["repo", "path", "parent_local_id"])
    edges = edges.unionByName(parent.select(F.col("parent").alias("src"), F.col("node_id").alias("dst"), F.lit("contains").alias("kind"), F.col("start_line").alias("line")))
    pending = flat_pending(frags, [repo]).withColumnRenamed(repo, "repo").withColumnRenamed("kind", "relation")
    pending = pending.join(end("source", [F.col("kind").alias("source_kind")]), ["repo", "path", "source_local_id"])
    pending = pending.select("repo", F.col("source").alias("source_id"), "source_kind", "target_name", F.col("relation").alias("kind"), "line")
    found, boundaries = edges_and_boundaries(resolve(nodes, pending))
    where = nodes.select("node_id", F.col("path").alias("at")).withColumnRenamed("node_id", "src")
    sites = found.where("kind like 'uncertain_%'").join(where, "src").select(F.col("dst").alias("node_id"), "at").distinct()
    extra = boundaries.join(sites, "node_id").select("node_id", "repo", "kind", "label", F.lit(None).cast("string").alias("qualified_name"), F.col("at").alias("path"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    out = nodes.select("node_id", "repo", "kind", "label", "qualified_name", "path", "start_line", "end_line").unionByName(extra.distinct())
    return cut(out), cut(edges.unionByName(found))


def numbered_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`edges` with edge_id from 0: relations inside of files, then containment, then resolved ones, each by path and place."""
    where = nodes.select(F.col("node_id").alias("src"), F.col("path").alias("__path"))
    phase = F.when(F.col("kind") == "contains", 1).when(F.col("line").isNull(), 0).otherwise(2)
    placed = edges.join(where, "src", "left").withColumn("__phase", phase)
    return numbered(placed, ["__phase", "__path", "line", "src", "dst", "kind"], "edge_id").select("edge_id", *edges.columns)
