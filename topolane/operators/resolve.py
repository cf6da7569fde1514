"""Names to definitions: unique, ambiguous (an uncertain boundary) or unknown (dropped).

Definitions are counted per name before the join, so a pending edge meets at most one row for each way it can match: a
name with thousands of definitions and thousands of callers costs their sum, not their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolane.functions.text import ascii_lower, suffix_keys
from topolane.schemas import COMPATIBLE, DEFINITION_KINDS

BOUNDARY_BASE = 1 << 60


def _families(kind: Column) -> Column:
    """Families of relations that a definition of this kind can answer."""
    out = [F.lit("any")]
    for relation in ("calls", "binds", "renders", "types"):
        kinds = COMPATIBLE["inherits" if relation == "types" else relation]
        out.append(F.when(kind.isin(*kinds), relation))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _family(relation: Column) -> Column:
    return F.when(relation.isin("inherits", "extends", "implements"), "types").when(relation.isin("calls", "binds", "renders"), relation).otherwise("any")


def _counted(defs: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return defs.groupBy("repo", "family", *keys).agg(
        F.count(F.lit(1)).alias(f"n_{prefix}"), F.min("node_id").alias(f"id_{prefix}"), F.min("kind").alias(f"kind_{prefix}")
    )


def _none(p: DataFrame, prefix: str) -> DataFrame:
    return p.withColumns({f"n_{prefix}": F.lit(None).cast("bigint"), f"id_{prefix}": F.lit(None).cast("bigint"), f"kind_{prefix}": F.lit(None).cast("string")})


def resolve(nodes: DataFrame, pending: DataFrame, names: str = "any") -> DataFrame:
    """Pending edges with `n` (candidates that remain), `dst` (if exactly one), `edge_kind` and `outcome`.

    pending: repo, source_id, source_kind, target_name, kind, line. Case-sensitive matches win over others; a name with `::` matches
    any qualified name that ends in it. A missing name or repository matches nothing. names: "simple" if no target name has `::`,
    "qualified" if each has it; what the others would need is then not worked out.
    """
    defs = nodes.where(F.col("kind").isin(*DEFINITION_KINDS)).select("repo", "node_id", "kind", "label", "qualified_name", F.explode(_families(F.col("kind"))).alias("family"))
    p = pending.withColumns({"family": _family(F.col("kind")), "lname": ascii_lower(F.col("target_name"))})
    if names == "qualified":
        p = _none(_none(p, "loose"), "exact")
    else:
        # A name's spellings lie in its row (some few that differ in case), so definitions and pending edges move once.
        simple = defs.drop("qualified_name").withColumn("lname", ascii_lower(F.col("label"))).repartition("repo", "lname")
        by = _counted(simple, ["lname", "label"], "exact").groupBy("repo", "family", "lname").agg(
            F.sum("n_exact").alias("n_loose"), F.min("id_exact").alias("id_loose"), F.min("kind_exact").alias("kind_loose"),
            F.collect_list(F.struct("label", "n_exact", "id_exact", "kind_exact")).alias("spelled"),
        )
        p = p.join(by, ["repo", "family", "lname"], "left")
        p = p.withColumn("mine", F.get(F.filter("spelled", lambda x: x["label"] == F.col("target_name")), F.lit(0))).drop("spelled")
        p = p.withColumns({c: F.col("mine")[c] for c in ("n_exact", "id_exact", "kind_exact")}).drop("mine")
    if names == "simple":
        p = _none(p, "qualified")
    else:
        suffixed = defs.where(F.instr("qualified_name", "::") > 0).withColumn("lname", F.explode(suffix_keys(ascii_lower(F.col("qualified_name")))))
        suffixed = suffixed.where(F.instr("lname", "::") > 0)
        p = p.join(_counted(suffixed, ["lname"], "qualified"), ["repo", "family", "lname"], "left")
    deep = F.instr("target_name", "::") > 0
    n = F.coalesce(F.when(deep, F.col("n_qualified")).when(F.col("n_exact") > 0, F.col("n_exact")).otherwise(F.col("n_loose")), F.lit(0))
    dst = F.when(deep, F.col("id_qualified")).when(F.col("n_exact") > 0, F.col("id_exact")).otherwise(F.col("id_loose"))
    kind_to = F.when(deep, F.col("kind_qualified")).when(F.col("n_exact") > 0, F.col("kind_exact")).otherwise(F.col("kind_loose"))
    out = p.withColumns({"n": n, "dst": F.when(n == 1, dst), "dst_kind": F.when(n == 1, kind_to)})
    rewritten = (
        F.when(F.col("kind") != "inherits", F.col("kind")).when(F.col("source_kind") == "interface", "extends")
        .when(F.col("dst_kind").isin("interface", "trait"), "implements").otherwise("extends")
    )
    outcome = F.when(F.col("n") == 1, "edge").when(F.col("n") > 1, "boundary").otherwise("dropped")
    edge_kind = F.when(F.col("n") == 1, rewritten).when(F.col("n") > 1, F.concat(F.lit("uncertain_"), F.col("kind")))
    return out.withColumns({"edge_kind": edge_kind, "outcome": outcome}).select("repo", "source_id", "target_name", "kind", "line", "n", "dst", "edge_kind", "outcome")


def edges_and_boundaries(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, kind, line) and one boundary node for each ambiguous call site."""
    kept = resolved.where("outcome <> 'dropped'")
    site = F.lit(BOUNDARY_BASE) + F.shiftrightunsigned(F.xxhash64("source_id", "target_name", "kind", "line"), 8)
    placed = kept.withColumn("to", F.coalesce("dst", site))
    edges = placed.select(F.col("source_id").alias("src"), F.col("to").alias("dst"), F.col("edge_kind").alias("kind"), "line")
    boundaries = placed.where("outcome = 'boundary'").select(
        F.col("to").alias("node_id"), "repo", F.lit("boundary").alias("kind"), F.concat(F.lit("?"), "target_name").alias("label"), "line"
    )
    return edges, boundaries
