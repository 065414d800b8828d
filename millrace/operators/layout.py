"""Files laid out along a space-filling curve, so that filters on any of several columns read few of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of each column's rank: 2 ** BITS ranges of about as many rows each.
BITS = 6


def rank(column: Column, cuts: Sequence) -> Column:
    """How many of the sorted cuts a value reaches, by halving: 0 for null."""
    listed = F.array(*(F.lit(c) for c in cuts))

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(column < F.element_at(listed, mid + 1), halve(low, mid)).otherwise(halve(mid + 1, high))

    return F.when(column.isNull(), F.lit(0)).otherwise(halve(0, len(cuts)))


def interleaved(ranks: Sequence[Column], bits: int = BITS) -> Column:
    """The ranks' bits in turn, the highest first: neighbours on the curve are near in every column."""
    n = len(ranks)
    if n * bits > 62:
        raise ValueError(f"{n} columns of {bits} bits are more than a long holds")
    placed = [F.shiftleft(F.shiftright(r, b).bitwiseAND(F.lit(1)).cast("long"), b * n + n - 1 - k) for k, r in enumerate(ranks) for b in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), placed)


def curve(rows: DataFrame, keys: Sequence[str], bits: int = BITS) -> DataFrame:
    """rows with _curve, their place on the curve through the keys' ranks.

    The cuts between ranks come from one pass of approximate quantiles, so skewed
    and unlike columns weigh alike; at most 2 ** bits - 1 of each come to the
    driver. Only numeric and date columns have quantiles here: others are refused.
    """
    kinds = dict(rows.dtypes)
    number = {}
    for k in keys:
        if kinds[k] in ("date", "timestamp", "timestamp_ntz"):
            number[k] = F.unix_micros(F.col(k).cast("timestamp")).cast("double")
        elif kinds[k] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[k].startswith("decimal"):
            number[k] = F.col(k).cast("double")
        else:
            raise ValueError(f"{k} is {kinds[k]}: neither a number nor a date")
    of = [i / 2**bits for i in range(1, 2**bits)]
    found = rows.agg(*(F.percentile_approx(v, of, 10_000).alias(f"c{i}") for i, v in enumerate(number.values()))).first()
    cuts = [sorted(set(found[f"c{i}"] or [])) for i in range(len(keys))]
    ranks = [rank(v, c) for v, c in zip(number.values(), cuts, strict=True)]
    return rows.withColumn("_curve", interleaved(ranks, bits))


def write_curved(rows: DataFrame, path: str, keys: Sequence[str], files: int, bits: int = BITS) -> None:
    """Write rows in so many files, each a stretch of the curve, sorted within."""
    curve(rows, keys, bits).repartitionByRange(files, "_curve").sortWithinPartitions("_curve").drop("_curve").write.mode("overwrite").parquet(path)


def extents(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """file, and the least and greatest value of each key in it: what a reader's footers say."""
    ends = [f(F.col(k)).alias(f"{n}_{k}") for k in keys for f, n in ((F.min, "least"), (F.max, "most"))]
    return stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(*ends)


def read_for(stored: DataFrame, column: str, low, high) -> int:
    """Files that may hold rows with low <= column <= high."""
    return extents(stored, [column]).where((F.col(f"most_{column}") >= F.lit(low)) & (F.col(f"least_{column}") <= F.lit(high))).count()
