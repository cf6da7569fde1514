"""Filling containers of fixed capacity: hierarchical residual packing.

Items are spread over partitions, each packs its own by best fit in falling order of size and emits the containers that
are nearly full. The underfull ones become items of the next round, in fewer partitions, until one partition has
packed the rest. A container is an item of 16 bytes however many members it has, and a partition gets at most about
PER_TASK of them, so no task grows with the corpus; memberships are followed at the end by joins on the item's id.

Cases: an item above the capacity alone is cut: whole capacities fill containers of their own and the remainder is an
item like others (`piece` counts from 0). Items of size 0 (null or empty texts) are put into a container too. Repeated
rows are items of their own. An empty table gives no container. Other columns are carried along by the item's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topolane.session import cut

PER_TASK = 200_000
FAN_IN = 8
NEARLY_FULL = 0.99


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, fill of each container); items in falling order of size, each into the fullest that holds it."""
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(sizes), dtype=np.int64)
    fill: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by room left
    mask = 0  # bit r: some container has r left
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        left = mask >> size
        if left:
            r = size + (left & -left).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            k, r = len(fill), capacity
            fill.append(0)
        fill[k] += size
        place[i] = k
        r -= size
        room[r].append(k)
        mask |= 1 << r
    return place, np.asarray(fill, dtype=np.int64)


def _round(items: DataFrame, parts: int, number: int, capacity: int) -> DataFrame:
    """(item, bin, fill) after one round of local packing."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        got = [b for b in batches if len(b)]
        if not got:
            return
        rows = pd.concat(got, ignore_index=True).sort_values(["size", "item"], ascending=[False, True], kind="stable")
        place, fill = best_fit(rows["size"].to_numpy(np.int64), capacity)
        base = (number << 48) | (TaskContext.get().partitionId() << 28)
        yield pd.DataFrame({"item": rows["item"].to_numpy(np.int64), "bin": base + place, "fill": fill[place]})

    return items.repartition(parts, "item").mapInPandas(pack, "item long, bin long, fill long")


def pack(sized: DataFrame, capacity: int, size: str = "n_tokens", per_task: int = PER_TASK) -> DataFrame:
    """Rows of `sized` with piece, piece_size, container_id and container_fill."""
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    whole = F.floor(n / F.lit(capacity)).cast("int")
    rest = (n - whole * F.lit(capacity)).cast("bigint")
    # Pieces of an oversized item; the remainder is left out where nothing remains.
    n_pieces = whole + F.when((rest > 0) | (whole == 0), 1).otherwise(0)
    pieces = (
        sized.withColumn("piece", F.explode(F.sequence(F.lit(0), n_pieces - 1)))
        .withColumn("piece_size", F.when(F.col("piece") < whole, F.lit(capacity).cast("bigint")).otherwise(rest))
        .withColumn("__item", F.monotonically_increasing_id())
    )
    pieces = cut(pieces)  # fixes the ids
    total = pieces.count()
    if total == 0:
        return pieces.withColumns({"container_id": F.lit(None).cast("bigint"), "container_fill": F.lit(None).cast("bigint")}).drop("__item")
    items = pieces.select(F.col("__item").alias("item"), F.col("piece_size").alias("size"))
    levels: list[DataFrame] = []
    count, parts, number = total, max(1, -(-total // per_task), min(64, -(-total // 4096))), 0
    underfull = F.col("fill") < int(NEARLY_FULL * capacity)
    while True:
        number += 1
        level = cut(_round(items, parts, number, capacity))
        levels.append(level)
        under = level.where(underfull).select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
        left = 0 if parts == 1 else under.count()
        least = max(1, -(-left // per_task))
        # One partition has seen the rest; or as few as can hold it have found nothing to merge.
        if left == 0 or (left == count and parts == least):
            break
        items, count = under, left
        parts = max(min(parts // FAN_IN, -(-left // 1024)), least)
    # From the last round back: only what was underfull has moved on.
    where = levels.pop()
    while levels:
        level = levels.pop()
        moved = where.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("fill").alias("to_fill"))
        where = level.where(~underfull).unionByName(level.where(underfull).join(moved, "bin").select("item", F.col("to").alias("bin"), F.col("to_fill").alias("fill")))
    where = where.select(F.col("item").alias("__item"), F.col("bin").alias("container_id"), F.col("fill").alias("container_fill"))
    return pieces.join(where, "__item").drop("__item")


def utilisation(packed: DataFrame, capacity: int) -> DataFrame:
    """Number of containers, the least possible by volume, and the share of space used."""
    bins = packed.groupBy("container_id").agg(F.sum("piece_size").alias("used"), F.count(F.lit(1)).alias("members"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("members"), F.lit(0)).alias("members"), F.max("used").alias("fullest"),
    ).withColumns({"least": F.ceil(F.col("tokens") / capacity), "used_share": F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6)})
