"""Change data to current state, ordered by a trusted sequence and not by commit time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import order_status


def without_repeats(events: DataFrame, keys: Sequence[str] = ("order_id", "__seq")) -> DataFrame:
    """One row for each key; copies are expected to agree."""
    return events.dropDuplicates(list(keys))


def latest_state(events: DataFrame, key: str = "order_id", sequence: str = "__seq") -> DataFrame:
    """The event of the highest sequence for each key, with is_refunded and order_status.

    is_refunded follows the verb alone (null verb: null). The highest event is
    taken by an aggregate, which is combined before the shuffle: one row per key
    and task moves, however many events a key has. Events without a sequence are
    older than any with one; null keys are one key. Of events that share a
    sequence the greatest by the other columns counts, so that reruns agree.
    """
    rest = [c for c in events.columns if c not in (key, sequence)]
    top = events.groupBy(key).agg(F.max(F.struct(F.col(sequence), *rest)).alias("_row"))
    return top.select(*(F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in events.columns)).withColumn("is_refunded", F.col("__op") == "D").withColumn("order_status", order_status(F.col("event_type")))


def active(state: DataFrame) -> DataFrame:
    """Orders that are not refunded; those of unknown state are left out."""
    return state.where(~F.col("is_refunded"))


def transitions(events: DataFrame, key: str = "order_id", sequence: str = "__seq") -> DataFrame:
    """Each event beside the one before it in its key: previous_event, and hours_since by commit time."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(sequence)
    seconds = F.unix_timestamp(F.col("__commit_ts").cast("timestamp"))
    return events.withColumn("previous_event", F.lag("event_type").over(order)).withColumn("hours_since", (seconds - F.lag(seconds).over(order)) / 3600)
