"""Traversals, degrees and checks of an edge table (src, dst, kind); parallel edges and loops are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topolane.schemas import EXECUTION_EDGES
from topolane.session import cut


def is_execution(kind: str = "kind"):
    return F.col(kind).isin(*EXECUTION_EDGES) | F.col(kind).startswith("uncertain_")


def mode_edges(edges: DataFrame, mode: str = "any") -> DataFrame:
    """Edges of a path mode; containment is never followed."""
    kept = edges.where(F.col("kind") != "contains")
    if mode == "execution":
        return kept.where(is_execution())
    return kept.where(~is_execution()) if mode == "dependency" else kept


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, n_out, n_in, degree): both ends are exploded and counted in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node_id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"), F.count(F.lit(1)).alias("degree"))


def expand(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = True, prepared: bool = False) -> DataFrame:
    """(node_id, distance) of everything within `depth` steps of the seeds, the seeds at 0.

    Level by level; each level joins only the frontier and drops what was seen by an anti-join. Edges are reduced to
    distinct pairs once, since a second parallel edge adds nothing to reachability.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = edges if prepared else cut(edges.where(F.col("kind") != "contains").select(F.col(a).alias("at"), F.col(b).alias("to")).distinct())
    seen = cut(seeds.select("node_id").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.join(steps, frontier["node_id"] == steps["at"]).select(F.col("to").alias("node_id")).distinct()
        frontier = cut(reached.join(seen.select("node_id"), "node_id", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def weighted_distances(edges: DataFrame, seeds: DataFrame, wanted: int, uncertain_weight: int = 2) -> DataFrame:
    """(node_id, distance) from the seeds over undirected edges; calls and implements weigh 1, others 2.

    Relaxation in order of distance: after the round for distance d everything within d is final, so it ends as
    soon as more than `wanted` nodes are settled.
    """
    weight = F.when(F.col("kind").isin("calls", "implements"), 1).when(F.col("kind").startswith("uncertain_"), uncertain_weight).otherwise(2)
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("at"), F.col("src").alias("to")))).alias("e"), weight.alias("w"))
    steps = cut(both.groupBy("e.at", "e.to").agg(F.min("w").alias("w")))
    known = cut(seeds.select("node_id").distinct().withColumn("distance", F.lit(0)))
    d = -1
    while True:
        d += 1
        out = known.where(F.col("distance") == d).join(steps, F.col("node_id") == F.col("at")).select(F.col("to").alias("node_id"), (F.col("distance") + F.col("w")).alias("distance"))
        known = cut(known.unionByName(out).groupBy("node_id").agg(F.min("distance").alias("distance")))
        counts = known.agg(F.count(F.when(F.col("distance") <= d + 1, 1)), F.max("distance")).first()
        if counts[0] > wanted or counts[1] <= d:
            break
    return known


def shortest_paths(edges: DataFrame, nodes: DataFrame, start: int, goal: int, max_hops: int = 8, k: int = 3) -> DataFrame:
    """Up to k shortest simple directed paths (path_no, hops, nodes, kinds); ties by target path, label and edge kind of each hop.

    The search is first confined to nodes that lie on some path within max_hops (forward and backward distances), so the
    path rows that are carried along cannot leave that neighbourhood.
    """
    spark = edges.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "node_id bigint")
    forward = expand(edges, one(start), max_hops, reverse=False).withColumnRenamed("distance", "f")
    backward = expand(edges, one(goal), max_hops, reverse=True).withColumnRenamed("distance", "b")
    inside = cut(forward.join(backward, "node_id").where(F.col("f") + F.col("b") <= max_hops))
    keys = inside.join(nodes.select("node_id", "path", "label"), "node_id")
    live = (
        edges.where(F.col("kind") != "contains").join(inside.select(F.col("node_id").alias("src")), "src", "left_semi")
        .join(keys.select(F.col("node_id").alias("dst"), "path", "label", "b"), "dst")
    )
    live = cut(live.select("src", "dst", "kind", "path", "label", "b"))
    paths = one(start).select(F.array("node_id").alias("nodes"), F.array().cast("array<string>").alias("kinds"), F.array().cast("array<string>").alias("order"))
    found: DataFrame | None = None
    n_found = 0
    for hop in range(1, max_hops + 1):
        at = F.element_at("nodes", -1)
        step = paths.join(live, at == F.col("src")).where(~F.array_contains("nodes", F.col("dst")) & (F.lit(hop) + F.col("b") <= max_hops))
        step = step.select(
            F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("kinds", F.array("kind")).alias("kinds"),
            F.concat("order", F.array("path", "label", "kind")).alias("order"),
        )
        step = cut(step)
        done = step.where(F.element_at("nodes", -1) == goal)
        found = done if found is None else found.unionByName(done)
        n_found += done.count()
        paths = step.where(F.element_at("nodes", -1) != goal)
        if n_found >= k or paths.isEmpty():
            break
    ranked = found.withColumn("hops", F.size("kinds")).orderBy("hops", "order").limit(k)
    return ranked.withColumn("path_no", F.row_number().over(Window.orderBy("hops", "order"))).select("path_no", "hops", "nodes", "kinds")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, n): repeated ids and edges without an end."""
    repeated = nodes.groupBy("node_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("repeated_id"))
    ids = nodes.select("node_id").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    missing = ends.join(ids, "node_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("missing_end"))
    return repeated.unionByName(missing).select("problem", "n")


def file_dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, path, dependent): files with an edge into another file."""
    n = nodes.select("node_id", "repo", "path")
    out = edges.where(F.col("kind") != "contains").join(n.withColumnsRenamed({"node_id": "src", "path": "dependent", "repo": "r"}), "src")
    out = out.join(n.withColumnsRenamed({"node_id": "dst"}), "dst")
    return out.where("path <> dependent").select("repo", "path", "dependent").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(node_id, outgoing, incoming): the edge ids of each node in order; `edges` has edge_id. A hub's list is as long as its
    degree, so queries join edges instead and this is for what wants lists."""
    ends = edges.select("edge_id", F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node_id"), F.lit(False).alias("out")))).alias("e"))
    pick = lambda out: F.array_sort(F.collect_list(F.when(F.col("e.out") == out, F.col("edge_id"))))
    return ends.groupBy("e.node_id").agg(pick(True).alias("outgoing"), pick(False).alias("incoming"))


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """`nodes` with new ones (no node_id) numbered after the last; no single task numbers them."""
    from topolane.operators.index import numbered

    base = nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1)) + 1).first()[0]
    order = [c for c in ("repo", "path", "start_line", "label") if c in new.columns] or new.columns
    more = numbered(new, order).withColumn("node_id", F.col("node_id") + base)
    return nodes.unionByName(more.select(*[F.col(c) if c in more.columns else F.lit(None).alias(c) for c in nodes.columns]))


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """`edges` with new ones; an edge whose source or target is no node raises an error when it is read."""
    known = nodes.select("node_id").distinct()
    ends = new.join(known.select(F.col("node_id").alias("__s")), F.col("src") == F.col("__s"), "left").join(known.select(F.col("node_id").alias("__d")), F.col("dst") == F.col("__d"), "left")
    wrong = F.col("__s").isNull() | F.col("__d").isNull()
    told = F.concat(F.lit("no such node: "), F.coalesce(F.col("src").cast("string"), F.lit("null")), F.lit(" to "), F.coalesce(F.col("dst").cast("string"), F.lit("null")))
    checked = ends.withColumn("src", F.when(wrong, F.raise_error(told).cast("bigint")).otherwise(F.col("src")))
    return edges.unionByName(checked.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in edges.columns]))


def with_attributes(table: DataFrame, attributes: DataFrame, key: str = "node_id") -> DataFrame:
    """`table` with a map of attributes from rows (key, name, value); of a name set twice the greatest value stays."""
    per = attributes.groupBy(key, "name").agg(F.max("value").alias("value")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))
    return table.join(per, key, "left")
