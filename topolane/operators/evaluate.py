"""Evaluation and batching: nearest-rank percentiles, recall, quiet-period batches, literal search, a release gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles (index ceil(n*p) - 1) of each group, exact, from counts of the distinct values.

    Values are counted before they are ranked, so a group is as large as its distinct values, not as its rows.
    """
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    ranked = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(group))})
    out = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("n") * p), F.lit(1)), F.col(value))).cast("bigint").alias(name) for name, p in shares.items()]
    return ranked.groupBy(group).agg(*out, F.max("n").alias("n"))


def recall(df: DataFrame, group: list[str], found: str) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("expected"), F.count(F.when(F.col(found), 1)).alias("found")).withColumn("recall", F.round(F.col("found") / F.col("expected"), 6))


def quiet_batches(df: DataFrame, lane: str, at: str, gap_s: int) -> DataFrame:
    """Batches of a lane that end with a pause longer than the gap: first_ts, last_ts, n."""
    o = Window.partitionBy(lane).orderBy(at)
    before = F.lag(at).over(o)
    new = F.when(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) <= gap_s * 1000000, 0).otherwise(1)
    marked = df.select(lane, at, new.alias("new")).withColumn("batch", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(lane, "batch").agg(F.min(at).alias("first_ts"), F.max(at).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def literal_search(df: DataFrame, content: str, needle: str, width: int = 200) -> DataFrame:
    """Lines that contain a fixed string, with their numbers."""
    lines = F.split(F.regexp_replace(content, "\r\n", "\n"), "\n", -1)
    rest = [c for c in df.columns if c != content]
    return df.where(F.col(content).contains(needle)).select(*rest, F.posexplode(lines).alias("at", "text")).where(F.col("text").contains(needle)).select(*rest, (F.col("at") + 1).alias("line_no"), F.substring("text", 1, width).alias("line"))


def compare_sets(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: shared, only_a, only_b of two sets of rows."""
    both = a.select(*columns).distinct().withColumn("a", F.lit(1)).join(b.select(*columns).distinct().withColumn("b", F.lit(1)), columns, "full_outer")
    return both.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))


def gate(tasks: DataFrame, least_median: float, least_p75: float) -> DataFrame:
    """Release checks of paired runs (baseline_tokens, tokens): median and p75 reduction against what is required.

    p75 is the reduction that three quarters of the tasks reach.
    """
    r = tasks.withColumn("reduction", F.round((1 - F.col("tokens") / F.col("baseline_tokens")) * 1000000).cast("bigint")).withColumn("g", F.lit(1))
    p = nearest_rank(r, "g", "reduction", {"median": 0.5, "low_quarter": 0.25})
    return p.select(
        (F.col("median") / 1000000).alias("median_reduction"), (F.col("low_quarter") / 1000000).alias("p75_reduction"),
        ((F.col("median") / 1000000 >= least_median) & (F.col("low_quarter") / 1000000 >= least_p75)).alias("passed"),
    )
