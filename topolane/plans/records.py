"""Queries over the hook records and lifecycle deliveries: schema drift (p4) and repeated messages (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolane.operators import dedup, drift
from topolane.session import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "hook_records"))


def p4_table(spark: SparkSession, sf: str) -> DataFrame:
    return drift.unified(table(spark, sf, "hook_records")).drop("raw")


def p4_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    return drift.islands(table(spark, sf, "hook_records"))


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values that go into the unified table and come out of it, by file."""
    return drift.values(table(spark, sf, "hook_records"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lifecycle_deliveries").select("delivery_id", "received_at", "source")
    return dedup.mark_copies(rows, dedup.message_key(), "received_at", ["delivery_id"]).where("is_copy").select("delivery_id")


def p5_belief(spark: SparkSession, sf: str) -> DataFrame:
    """How often the receiver's own belief (response.duplicate) agrees with the operator."""
    rows = table(spark, sf, "lifecycle_deliveries").select("delivery_id", "received_at", "source", F.col("response.duplicate").alias("believed"))
    marked = dedup.mark_copies(rows, dedup.message_key(), "received_at", ["delivery_id"])
    return marked.groupBy("believed", "is_copy").agg(F.count(F.lit(1)).alias("n"))


def p5_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries kept and dropped in each batch."""
    rows = table(spark, sf, "lifecycle_deliveries").select("delivery_id", "batch_id", "received_at", "source")
    marked = dedup.mark_copies(rows, dedup.message_key(), "received_at", ["delivery_id"])
    return marked.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_copy"), 1)).alias("n_dropped"))


QUERIES = {"p4_found": p4_found, "p4_table": p4_table, "p4_lifespans": p4_lifespans, "p4_values": p4_values, "p5_found": p5_found, "p5_belief": p5_belief, "p5_batches": p5_batches}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8239) || chr(12288) || chr(8195)"
_MARKED = f"""
WITH k AS (
  SELECT delivery_id, batch_id, response.duplicate AS believed, received_at,
         coalesce(lower(trim(source.harness, {_BLANKS})), '') AS h,
         nullif(trim(source.session_id, {_BLANKS}), '') AS s, nullif(trim(source.event_id, {_BLANKS}), '') AS e
  FROM lifecycle_deliveries),
marked AS (
  SELECT *, s IS NOT NULL AND e IS NOT NULL
            AND row_number() OVER (PARTITION BY h, s, e ORDER BY received_at NULLS LAST, delivery_id) > 1 AS is_copy FROM k)
"""

_VALUES = """
WITH r AS (SELECT feed_id, file_no, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw ELSE '{}' END AS line FROM hook_records),
v AS (SELECT feed_id, file_no, substr(t.fullkey, 3) AS field,
             CASE WHEN t.type = 'VARCHAR' THEN 'string' WHEN t.type IN ('BOOLEAN', 'ARRAY', 'OBJECT') THEN lower(t.type) ELSE 'number' END AS type
      FROM r, json_tree(r.line) t WHERE t.type <> 'NULL' AND t.fullkey NOT LIKE '%[%' AND t.fullkey <> '$')
"""

ORACLE = {
    "p4_values": _VALUES + """, n AS (SELECT feed_id, file_no, count(*) FILTER (WHERE type <> 'object') AS n FROM v GROUP BY ALL)
SELECT f.feed_id, f.file_no, coalesce(n, 0) AS n_in, coalesce(n, 0) AS n_out FROM (SELECT DISTINCT feed_id, file_no FROM r) f LEFT JOIN n USING (feed_id, file_no)""",
    "p4_lifespans": _VALUES + """, f AS (SELECT feed_id, file_no, row_number() OVER w AS nth, lead(file_no) OVER w AS next_file, min(file_no) OVER (PARTITION BY feed_id) AS first_file
             FROM (SELECT DISTINCT feed_id, file_no FROM r) WINDOW w AS (PARTITION BY feed_id ORDER BY file_no)),
p AS (SELECT feed_id, file_no, field, type, count(*) AS n_lines FROM v GROUP BY ALL),
s AS (SELECT *, CASE WHEN lag(nth) OVER w = nth - 1 THEN 0 ELSE 1 END AS starts FROM p JOIN f USING (feed_id, file_no) WINDOW w AS (PARTITION BY feed_id, field, type ORDER BY nth)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY feed_id, field, type ORDER BY nth) AS island FROM s)
SELECT feed_id, field, type, island, min(file_no) AS from_file, max(file_no) AS to_file, count(*) AS n_files, sum(n_lines) AS n_lines,
       min(first_file) AS first_file, CASE WHEN count(*) = count(next_file) THEN max(next_file) END AS next_file FROM (SELECT * FROM i) GROUP BY feed_id, field, type, island""",
    "p5_found": _MARKED + "SELECT delivery_id FROM marked WHERE is_copy",
    "p5_belief": _MARKED + "SELECT believed, is_copy, count(*) AS n FROM marked GROUP BY ALL",
    "p5_batches": _MARKED + "SELECT batch_id, count(*) AS n, count(*) FILTER (WHERE is_copy) AS n_dropped FROM marked GROUP BY ALL",
}
