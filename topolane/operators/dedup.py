"""Messages delivered at least once: keep exactly one copy of each.

Cases: a message is named by several columns, compared after the caller's normalisation. Rows of which a
part of the name is null (or blank, where `blank_is_missing` names the column) are no copies of anything and
always stay. Among copies the one with the earliest arrival stays, a null arrival counting as the latest; ties go
to the smallest tie-break values, nulls last, and between rows equal in all of these, to an arbitrary but single one.
Empty input gives empty output; other columns are carried along, and helper columns have reserved names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolane.functions.text import strip_white

SALTS = 32


def message_key(source: Column | str = "source") -> list[Column]:
    """Name of a lifecycle message: harness in lower case, session id and event id, without outer white space."""
    s = F.col(source) if isinstance(source, str) else source
    return [
        F.coalesce(F.lower(strip_white(s["harness"])), F.lit("")),
        F.nullif(strip_white(s["session_id"]), F.lit("")),
        F.nullif(strip_white(s["event_id"]), F.lit("")),
    ]


def mark_copies(df: DataFrame, key: list[Column], arrival: str, ties: list[str], salts: int = SALTS) -> DataFrame:
    """Add `is_copy`: true for every delivery to be dropped.

    Rank within (key, salt), then rank the salt winners within the key. A key that holds a third of all rows is spread
    over `salts` tasks, and its second round has at most `salts` rows; losers of the first round leave for groups of
    their own, so no task ever sees an unbounded group.
    """
    names = [f"__k{i}" for i in range(len(key))]
    order = [F.col(arrival).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    out = df.withColumns(dict(zip(names, key)))
    named = F.lit(True)
    for n in names:
        named = named & F.col(n).isNotNull()
    spread = F.xxhash64(*ties, F.col(arrival))
    out = out.withColumns({"__named": named, "__salt": F.pmod(spread, F.lit(salts)), "__spread": spread})
    first = Window.partitionBy(*names, "__salt").orderBy(*order)
    # Unnamed rows would share null groups; they are spread by row and never ranked against each other.
    out = out.withColumn("__salt", F.when(F.col("__named"), F.col("__salt")).otherwise(F.col("__spread")))
    out = out.withColumn("__r1", F.row_number().over(first))
    out = out.withColumn("__own", F.when(F.col("__named") & (F.col("__r1") == 1), F.lit(0)).otherwise(F.col("__spread")))
    out = out.withColumn("__lost", F.when(F.col("__named") & (F.col("__r1") == 1), F.lit(0)).otherwise(F.lit(1)))
    second = Window.partitionBy(*names, "__lost", "__own").orderBy(*order)
    out = out.withColumn("__r2", F.row_number().over(second))
    out = out.withColumn("is_copy", F.col("__named") & ((F.col("__r1") > 1) | (F.col("__r2") > 1)))
    return out.drop(*names, "__named", "__salt", "__spread", "__r1", "__own", "__lost", "__r2")


def keep_first(df: DataFrame, key: list[Column], arrival: str, ties: list[str]) -> DataFrame:
    return mark_copies(df, key, arrival, ties).where(~F.col("is_copy")).drop("is_copy")


def absorb_batch(batch: DataFrame, stored: DataFrame, key: list[Column], arrival: str, ties: list[str]) -> DataFrame:
    """Rows of a new batch that are neither copies inside it nor known already.

    `stored` holds the names taken so far in columns k0, k1, …; it is anti-joined, never collected. Rows without a
    complete name pass. The returned rows carry k0, k1, … so that the caller can append them to the store.
    """
    names = [f"k{i}" for i in range(len(key))]
    fresh = keep_first(batch, key, arrival, ties).withColumns(dict(zip(names, key)))
    return fresh.join(stored.select(*names).distinct(), names, "left_anti")
