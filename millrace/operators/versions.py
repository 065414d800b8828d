"""Type 2 slowly changing dimensions and joins as of a date.

A version is valid on [__effective_from, __effective_to); the open one ends on
HIGH_DATE and is current.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import signature

HIGH_DATE = "9999-12-31"
VALIDITY = ("__effective_from", "__effective_to", "__is_current")


def _version(rows: DataFrame, since: Column, until: Column, is_current: bool) -> DataFrame:
    return rows.withColumns({"__effective_from": since.cast("date"), "__effective_to": until.cast("date"), "__is_current": F.lit(is_current)})


def merge(current: DataFrame | None, incoming: DataFrame, keys: Sequence[str], tracked: Sequence[str], since: str, high_date: str = HIGH_DATE) -> DataFrame:
    """The dimension after a snapshot.

    New keys open a version on the snapshot's date (column `since`, which is not
    carried). A change of a tracked column closes the open version on that date
    and opens another; on the day the open version began it replaces it, and a
    snapshot dated before that day changes nothing of it. Other changes are
    dropped with the row that brings them, keys missing from the snapshot stay
    open, closed versions pass through, and a snapshot applied again changes
    nothing. Of a key twice in a snapshot the greatest row counts (by date, then
    column by column). A null key is a key. None stands for no dimension yet.

    One full join of the open versions with the snapshot on the keys, and one
    pass that emits one or two versions for each: no second scan and no action.
    """
    keys = list(keys)
    payload = [c for c in incoming.columns if c != since]
    once = incoming.withColumn("_since", F.to_date(since)).groupBy(*keys).agg(F.max(F.struct("_since", *(c for c in payload if c not in keys))).alias("_row"))
    fresh = once.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in payload), "_row._since")
    fresh = fresh.select(F.struct(*payload).alias("_new"), "_since", *(F.col(k).alias(f"_n_{k}") for k in keys), signature(tracked).alias("_n_sign"))
    if current is None:
        return _version(fresh.select("_new.*", "_since"), F.col("_since"), F.lit(high_date), True).drop("_since")
    closed, open_ = current.where(~F.col("__is_current")), current.where("__is_current")
    old = open_.select(F.struct(*payload, *VALIDITY).alias("_old"), *(F.col(k).alias(f"_o_{k}") for k in keys), signature(tracked).alias("_o_sign"))
    on = [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys]
    both = old.join(fresh, on, "full")
    kept = F.struct(*(F.col(f"_old.{c}") for c in (*payload, *VALIDITY)))
    ended = F.struct(*(F.col(f"_old.{c}") for c in payload), F.col("_old.__effective_from").alias("__effective_from"), F.col("_since").alias("__effective_to"), F.lit(False).alias("__is_current"))
    begun = F.struct(*(F.col(f"_new.{c}") for c in payload), F.col("_since").alias("__effective_from"), F.lit(high_date).cast("date").alias("__effective_to"), F.lit(True).alias("__is_current"))
    began = F.col("_old.__effective_from")
    rows = (
        F.when(F.col("_n_sign").isNull() | (F.col("_o_sign") == F.col("_n_sign")) | (F.col("_since") < began), F.array(kept))
        .when(F.col("_o_sign").isNull() | (F.col("_since") == began), F.array(begun))
        .otherwise(F.array(ended, begun))
    )
    return closed.select(*payload, *VALIDITY).unionByName(both.select(F.explode(rows).alias("_row")).select("_row.*"))


def fold(snapshots: Sequence[DataFrame], keys: Sequence[str], tracked: Sequence[str], since: str) -> DataFrame:
    """The dimension after snapshots in their order."""
    dimension = None
    for snapshot in snapshots:
        dimension = merge(dimension, snapshot, keys, tracked, since)
    if dimension is None:
        raise ValueError("no snapshots")
    return dimension


def advance(stored: DataFrame | None, delivered: DataFrame, keys: Sequence[str], tracked: Sequence[str], since: str, high_date: str = HIGH_DATE) -> DataFrame:
    """The dimension after any number of deliveries at once: what merge() gives for them in the order of their dates.

    The open versions and the deliveries of a key are lined up by date. A row
    opens a version where its tracked columns differ from the row before it, and
    the version ends where the next one opens. Two windows over one sort, whatever
    the number of deliveries; closed versions pass through, so what is computed
    grows with the open versions and what is new.
    """
    keys = list(keys)
    payload = [c for c in delivered.columns if c != since]
    once = delivered.withColumn("_since", F.to_date(since)).groupBy(*keys, "_since").agg(F.max(F.struct(*(c for c in payload if c not in keys))).alias("_row"))
    line = once.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in payload), "_since", F.lit(1).alias("_kind"))
    if stored is not None:
        line = line.unionByName(stored.where("__is_current").select(*payload, F.col("__effective_from").alias("_since"), F.lit(0).alias("_kind")))
    by_key = Window.partitionBy(*keys)
    order = by_key.orderBy("_since", "_kind")
    # A delivery dated before the open version began changes nothing of it.
    begun = F.min(F.when(F.col("_kind") == 0, F.col("_since"))).over(by_key)
    told = line.withColumn("_sign", signature(tracked)).withColumn("_begun", begun).where(F.col("_begun").isNull() | (F.col("_since") >= F.col("_begun")))
    opens = told.withColumn("_last", F.lag("_sign").over(order)).where(F.col("_last").isNull() | (F.col("_last") != F.col("_sign")))
    ended = opens.withColumn("_until", F.lead("_since").over(order)).where(F.col("_until").isNull() | (F.col("_until") > F.col("_since")))
    until = F.coalesce("_until", F.lit(high_date).cast("date"))
    rows = ended.select(*payload, F.col("_since").alias("__effective_from"), until.alias("__effective_to"), F.col("_until").isNull().alias("__is_current"))
    if stored is None:
        return rows
    return stored.where(~F.col("__is_current")).select(*payload, *VALIDITY).unionByName(rows)


def split_moves(rows: DataFrame, column: str, moved_to: str, moved_on: str, since: str, high_date: str = HIGH_DATE) -> DataFrame:
    """A dimension from rows that carry their own move: two versions where moved_to is given, one elsewhere.

    One pass: each row explodes into its versions; both move columns are dropped.
    """
    base = [c for c in rows.columns if c not in (column, moved_to, moved_on)]
    version = lambda value, a, b, now: F.struct(value.alias(column), a.cast("date").alias("__effective_from"), b.cast("date").alias("__effective_to"), F.lit(now).alias("__is_current"))
    start, end, move = F.lit(since), F.lit(high_date), F.to_date(moved_on)
    moved = F.array(version(F.col(column), start, move, False), version(F.col(moved_to), move, end, True))
    out = rows.withColumn("_v", F.explode(F.when(F.col(moved_to).isNotNull(), moved).otherwise(F.array(version(F.col(column), start, end, True)))))
    return out.select(*(F.col(f"_v.{column}").alias(column) if c == column else F.col(c) for c in rows.columns if c == column or c in base), *(F.col(f"_v.{c}").alias(c) for c in VALIDITY))


def current(dimension: DataFrame) -> DataFrame:
    """The open versions."""
    return dimension.where("__is_current")


def as_of(rows: DataFrame, dimension: DataFrame, key: str, on_date: Column, take: dict[str, str]) -> DataFrame:
    """rows with columns of the version that was valid on a date: take maps dimension columns to new names.

    Left join on the key with the validity as residual: rows without a version
    stay, with nulls. Versions of a key that overlap would repeat rows; see
    `overlaps`. The dimension is broadcast only where its measured size allows.
    """
    side = dimension.select(F.col(key).alias("_key"), F.col("__effective_from").alias("_from"), F.col("__effective_to").alias("_to"), *(F.col(c).alias(n) for c, n in take.items()))
    at = F.to_date(on_date)
    return rows.join(side, (F.col(key) == F.col("_key")) & (at >= F.col("_from")) & (at < F.col("_to")), "left").drop("_key", "_from", "_to")


def as_of_sorted(rows: DataFrame, versions: DataFrame, key: str, at: str, begins: str, take: dict[str, str], block: str = "day") -> DataFrame:
    """rows with columns of their key's last version that began at or before them: take maps version columns to new names.

    For keys with very many versions (prices, rates), where a join would meet
    each row with all of them. Rows and versions are sorted together and the last
    version is carried forward, a block of time of a key at a time: what a block
    begins with comes from one row for each block that has some, so a key with a
    third of all rows is many groups. Rows before their key's first version, or
    without key or time, stay, with nulls; of versions that begin together the
    greatest by their columns counts. Versions without key or time count for nothing.
    """
    span = lambda c: F.date_trunc(block, F.col(c))
    told = F.struct(*(F.col(c).alias(n) for c, n in take.items()))
    since = versions.where(F.col(key).isNotNull() & F.col(begins).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(begins).alias("_at")).agg(F.max(told).alias("_told"))
    since = since.withColumn("_block", span("_at"))
    mine = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_at")).withColumn("_block", span("_at"))
    last = since.groupBy("_key", "_block").agg(F.max_by("_told", "_at").alias("_last"))
    blocks = last.unionByName(mine.where("_key IS NOT NULL AND _at IS NOT NULL").select("_key", "_block").distinct(), allowMissingColumns=True)
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opening = blocks.groupBy("_key", "_block").agg(F.max("_last").alias("_last")).withColumn("_told", F.last("_last", ignorenulls=True).over(before))
    # In a block come what it begins with, then versions and rows by time, versions first.
    line = (
        opening.where("_told IS NOT NULL").select("_key", "_block", F.lit(0).alias("_kind"), F.col("_block").alias("_at"), "_told")
        .unionByName(since.withColumn("_kind", F.lit(1)))
        .unionByName(mine.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
    )
    order = Window.partitionBy("_key", "_block").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = line.withColumn("_told", F.last("_told", ignorenulls=True).over(order)).where("_kind = 2")
    known = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    return carried.select("_row.*", *(F.when(known, F.col(f"_told.{n}")).alias(n) for n in take.values()))


def overlaps(dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Versions that begin before the one before them in their key has ended; none in a sound dimension."""
    before = Window.partitionBy(*keys).orderBy("__effective_from", "__effective_to")
    return dimension.withColumn("_until", F.lag("__effective_to").over(before)).where(F.col("__effective_from") < F.col("_until")).drop("_until")


def resolve_windows(rows: DataFrame, keys: Sequence[str], begins: str, ends: str) -> DataFrame:
    """Windows cut short where the next one of their key begins."""
    after = F.lead(begins).over(Window.partitionBy(*keys).orderBy(begins, ends))
    return rows.withColumn(ends, F.least(F.col(ends), after))
