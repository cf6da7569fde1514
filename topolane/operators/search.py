"""Symbol search, callers and callees, overlap of changed ranges with symbols, source windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolane.functions.text import ascii_lower
from topolane.operators.graph import is_execution


def search_tier(term: str) -> Column:
    """0 label, 1 its prefix, 2 inside it, 3 inside the qualified name, 4 inside the path; null where nothing matches."""
    t = term.lower()
    low = lambda c: F.coalesce(ascii_lower(F.col(c)), F.lit(""))
    return (
        F.when(low("label") == t, 0).when(low("label").startswith(t), 1).when(low("label").contains(t), 2)
        .when(low("qualified_name").contains(t), 3).when(low("path").contains(t), 4)
    )


def search(nodes: DataFrame, term: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """Top symbols for a term, by (tier, path, id); files are no symbols. `type` means type_alias."""
    kept = nodes.where(F.col("kind") != "file")
    if kind is not None:
        kept = kept.where(F.col("kind") == ("type_alias" if kind == "type" else kind))
    return kept.withColumn("tier", search_tier(term)).where("tier is not null").orderBy("tier", "path", "node_id").limit(max(1, min(limit, 100)))


def symbol_nodes(nodes: DataFrame, symbol: str, file: str | None = None) -> DataFrame:
    """Nodes named by a symbol: label, qualified name or its `::`-suffix, any case; a file narrows only if it leaves something."""
    s = symbol.lower()
    q = F.coalesce(ascii_lower(F.col("qualified_name")), F.lit(""))
    named = nodes.where(F.col("kind") != "file").where((ascii_lower(F.col("label")) == s) | (q == s) | q.endswith("::" + s))
    if file is None:
        return named
    f = file.lower()
    hit = F.when(ascii_lower(F.col("path")).endswith(f), 1).otherwise(0)
    # One number for the few rows of a name.
    best = named.agg(F.max(hit).alias("best"))
    return named.withColumn("hit", hit).join(F.broadcast(best), F.col("hit") == F.col("best")).drop("hit", "best")


def neighbours(edges: DataFrame, nodes: DataFrame, roots: DataFrame, incoming: bool, limit: int | None = 20) -> DataFrame:
    """Callers or callees of the roots over execution edges: (node_id, label, path, start_line, kind) with the smallest edge kind."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    hit = edges.where(is_execution()).join(roots.select(F.col("node_id").alias(a)).distinct(), a, "left_semi")
    out = hit.groupBy(F.col(b).alias("node_id")).agg(F.min("kind").alias("edge_kind")).join(nodes.select("node_id", "label", "path", "start_line"), "node_id")
    out = out.orderBy("node_id")
    return out.limit(limit) if limit else out


def overlapping(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols whose span meets a changed range of their file; a null range means the whole file.

    Equi-join on (repo, path); within one file the comparison is a range test.
    """
    r = ranges.select(F.col("repo").alias("r_repo"), F.col("path").alias("r_path"), F.col("first").alias("lo"), F.col("last").alias("hi"))
    on = (F.col("repo") == F.col("r_repo")) & (F.col("path") == F.col("r_path"))
    meet = F.col("lo").isNull() | ((F.col("start_line") <= F.col("hi")) & (F.col("end_line") >= F.col("lo")))
    return nodes.where(F.col("kind") != "file").join(r, on).where(meet).drop("r_repo", "r_path", "lo", "hi").distinct()


#: What makes a path one of tests, in lower case.
TEST_FOLDERS = ("/tests/", "/__tests__/", "/spec/")
TEST_START = "tests/"
TEST_ENDINGS = ("_test.rs", "_test.go", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx")


def is_test_path(c: Column) -> Column:
    """Paths of tests by their usual places and names, in any letter case."""
    low = F.lower(c)
    hit = low.startswith(TEST_START)
    for part in TEST_FOLDERS:
        hit = hit | low.contains(part)
    for end in TEST_ENDINGS:
        hit = hit | low.endswith(end)
    return hit


def parse_hunks(c: Column) -> Column:
    """Added ranges of unified-diff headers, as an array of (first, last): `+a,b` gives a to a+b-1, b defaults to 1, 0 keeps a."""
    heads = F.regexp_extract_all(c, F.lit(r"(?m)^@@ -\S+ \+(\d+(?:,\d+)?) @@"), F.lit(1))
    def one(h: Column) -> Column:
        first = F.split_part(h, F.lit(","), F.lit(1)).cast("int")
        size = F.when(F.instr(h, ",") > 0, F.split_part(h, F.lit(","), F.lit(2)).try_cast("int")).otherwise(1)
        return F.struct(first.alias("first"), (first + F.greatest(size, F.lit(1)) - 1).alias("last"))
    return F.transform(heads, one)


def source_window(content: Column, first: Column, last: Column, max_lines: int = 220, max_chars: int = 7000, around: int = 2) -> Column:
    """Numbered lines around a span, cut to lines and characters."""
    lines = F.split(F.regexp_replace(content, "\r\n", "\n"), "\n", -1)
    lo = F.greatest(first - around, F.lit(1))
    n = F.least(last + around - lo + 1, F.lit(max_lines), F.size(lines) - lo + 1)
    part = F.when(n > 0, F.slice(lines, lo, F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    numbered = F.transform(part, lambda x, i: F.concat((i + lo).cast("string"), F.lit(" | "), x))
    return F.substring(F.array_join(numbered, "\n"), 1, max_chars)


def is_config_path(c: Column) -> Column:
    return ascii_lower(c).rlike(r"\.(ya?ml|properties)$")


def matching_files(files: DataFrame, name: str) -> DataFrame:
    """Files with that path in any case, else those that end in it."""
    n = name.lower()
    low = ascii_lower(F.col("path"))
    ranked = files.withColumn("how", F.when(low == n, 0).when(low.endswith("/" + n) | low.endswith(n), 1)).where("how is not null")
    return ranked.join(F.broadcast(ranked.agg(F.min("how").alias("best"))), F.col("how") == F.col("best")).drop("how", "best")


def ranked_tests(impact: DataFrame, nodes: DataFrame) -> DataFrame:
    """Test symbols reached by an impact, nearest first."""
    hit = impact.join(nodes, "node_id").where(is_test_path(F.col("path")) & ~F.col("kind").isin("file", "import", "boundary"))
    w = Window.partitionBy("repo", "path", "label").orderBy("distance", "node_id")
    return hit.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("repo", "distance", "path", "label")
