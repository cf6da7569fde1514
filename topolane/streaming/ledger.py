"""Streaming twins: the keyed state machine of the ledger, copies dropped on the way in, and file batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolane.operators.dedup import absorb_batch, message_key
from topolane.schemas import EVENTS, STATES, TRANSITIONS

STATE = "state string, applied long, rejected long"


def lane_states(events: DataFrame, lane: str, at: str, tie: str, event: str) -> DataFrame:
    """Stream of (lane, state, applied, rejected): the state of each lane after every micro-batch that touches it.

    Within a batch events are taken in order of (at, tie); order between batches is that of their arrival.
    """
    out_schema = f"`{lane}` {events.schema[lane].dataType.simpleString()}, {STATE}"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, applied, rejected = state.get if state.exists else ("idle", 0, 0)
        rows = pd.concat(list(batches)).sort_values([at, tie], kind="stable")
        for e in rows[event]:
            to = TRANSITIONS[e][STATES.index(now)] if e in EVENTS else None
            if to is None:
                rejected += 1
            else:
                now, applied = to, applied + 1
        state.update((now, applied, rejected))
        yield pd.DataFrame({lane: [key[0]], "state": [now], "applied": [applied], "rejected": [rejected]})

    return events.groupBy(lane).applyInPandasWithState(step, out_schema, STATE, "update", "NoTimeout")


def first_deliveries(messages: DataFrame, watermark: str = "7 days") -> DataFrame:
    """Stream without copies by name, within the watermark; rows without a complete name pass through `unnamed` instead."""
    key = message_key()
    named = messages.withColumns({"k0": key[0], "k1": key[1], "k2": key[2]}).where("k1 is not null and k2 is not null")
    return named.withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(["k0", "k1", "k2"])


def ingest(messages: DataFrame, store: str, checkpoint: str, arrival: str = "received_at", ties: list[str] | None = None):
    """Start a query that appends to a Parquet store what is new of each batch: anti-joined against the stored names."""
    spark = messages.sparkSession

    def batch(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        try:
            stored = spark.read.parquet(store).select("k0", "k1", "k2")
        except Exception:  # the first batch finds no store
            stored = spark.createDataFrame([], "k0 string, k1 string, k2 string")
        absorb_batch(df, stored, message_key(), arrival, ties or ["delivery_id"]).write.mode("append").parquet(store)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, root: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*"):
    """Reconcile the files below a directory as they change: a file stream whose batches are quiet-period groups of paths."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    relevant = stream.where(~F.col("path").rlike(r"/(\.git|\.topolane)/")).select("path", "modificationTime", "length")
    return relevant.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
