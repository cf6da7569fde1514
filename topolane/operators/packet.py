"""Evidence under a token budget: packing, delivery of what is new, receipts, metrics."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolane.functions.text import class_runs, latency_bucket, tokens_from


def pack_evidence(rows: DataFrame, group: list[str], budget: int, order: list[str], text: str = "text", priority: str = "priority", offset: int = 0) -> DataFrame:
    """`rows` with rank (from 0), running_tokens and kept: the longest prefix by falling priority that fits the budget.

    Records are joined by a newline, so bytes and runs of the joined text are running sums, and its estimate is exact and
    never falls; the greedy prefix is a filter. Null texts count as empty ones.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    sized = rows.withColumns({"__bytes": F.octet_length(t), "__runs": class_runs(t)})
    w = Window.partitionBy(*group).orderBy(F.col(priority).desc(), *order)
    ranked = sized.withColumn("rank", F.row_number().over(w) - 1)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.col("rank") >= offset
    ranked = ranked.withColumns({
        "__b": F.sum(F.when(used, F.col("__bytes") + 1).otherwise(0)).over(run) - 1, "__r": F.sum(F.when(used, F.col("__runs")).otherwise(0)).over(run),
    })
    tokens = F.when(F.col("__b") <= 0, F.lit(0).cast("bigint")).otherwise(tokens_from(F.col("__b"), F.col("__r")))
    return ranked.withColumn("running_tokens", F.when(used, tokens)).withColumn("kept", used & (F.col("running_tokens") <= budget)).drop("__bytes", "__runs", "__b", "__r")


def packed_summary(packed: DataFrame, group: list[str]) -> DataFrame:
    """(group, kept, estimated_tokens, omitted, next_offset) of each packet."""
    return packed.groupBy(*group).agg(
        F.count(F.when(F.col("kept"), 1)).alias("kept"), F.coalesce(F.max(F.when(F.col("kept"), F.col("running_tokens"))), F.lit(0)).alias("estimated_tokens"),
        F.count(F.when(~F.col("kept"), 1)).alias("omitted"), F.min(F.when(~F.col("kept") & F.col("running_tokens").isNotNull(), F.col("rank").cast("bigint"))).alias("next_offset"),
    )


def shrink_window(text: str, budget: int, estimate) -> str:
    """Drop trailing lines until the text fits, keeping two at least."""
    if estimate(text) <= budget:
        return text
    lines = text.splitlines()
    while len(lines) > 2 and estimate("\n".join(lines)) > budget:
        lines.pop()
    return "\n".join(lines)


def deliver(evidence: DataFrame, receipts: DataFrame, session: str = "session_key", item: str = "evidence_id") -> DataFrame:
    """Evidence that the session has not received yet."""
    return evidence.join(receipts.select(session, item).distinct(), [session, item], "left_anti")


def trim_receipts(receipts: DataFrame, per_session: int = 256) -> DataFrame:
    """The most recent receipts of each session; older clocks, then smaller ids, are evicted first."""
    w = Window.partitionBy("session_key").orderBy(F.col("clock").desc(), F.col("evidence_id").desc())
    return receipts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_session).drop("rn")


def trim_sessions(sessions: DataFrame, most: int = 128) -> DataFrame:
    """The sessions with the latest access."""
    return sessions.orderBy(F.col("last_access").desc(), F.col("session_key").desc()).limit(most)


def metrics(samples: DataFrame, group: str, ms: str) -> DataFrame:
    """(group, calls, and a count for each latency bucket)."""
    b = latency_bucket(F.col(ms))
    return samples.groupBy(group).agg(
        F.count(F.lit(1)).alias("calls"), *[F.count(F.when(b == x, 1)).alias(x) for x in ("lt_10", "lt_100", "lt_1000", "ge_1000")]
    )


def encode_cursor(query: str, version: int, intent: str, offset: int) -> str:
    import hashlib

    body = {"query": hashlib.sha256(query.encode()).hexdigest()[:16], "index": version, "intent": intent, "offset": offset}
    return base64.urlsafe_b64encode(json.dumps(body, sort_keys=True).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, query: str, version: int, intent: str) -> int:
    """Offset of a cursor; raises ValueError (cursor_stale) if question, index or intent have changed."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("cursor_invalid") from e
    if encode_cursor(query, version, intent, body.get("offset", 0)) != cursor:
        raise ValueError("cursor_stale")
    return int(body["offset"])


def evidence_digest(c: Column, salt: str = "") -> Column:
    """Stable id of a record (32 hex digits)."""
    return F.substring(F.sha2(F.concat(F.lit(salt + "\x00"), c), 256), 1, 32)
