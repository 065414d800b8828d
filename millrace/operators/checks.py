"""Expectations of three severities, gates, reconciliation and masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A threshold that stops a run was passed."""


def violations(df: DataFrame, expectations: Mapping[str, str]) -> DataFrame:
    """(expectation, failed, total): rows for which each predicate is not true. All in one scan."""
    failed = {name: F.sum(F.when(F.expr(p), 0).otherwise(1)).cast("long") for name, p in expectations.items()}
    totals = df.agg(F.count(F.lit(1)).alias("_total"), *(f.alias(n) for n, f in failed.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("expectation"), F.coalesce(F.col(n), F.lit(0)).alias("failed")) for n in expectations))
    return totals.select(F.explode(pairs).alias("_p"), "_total").select("_p.expectation", "_p.failed", F.col("_total").alias("total"))


def keep(df: DataFrame, expectations: Mapping[str, str]) -> DataFrame:
    """Rows for which every predicate is true."""
    for predicate in expectations.values():
        df = df.where(F.coalesce(F.expr(predicate), F.lit(False)))
    return df


def require(df: DataFrame, expectations: Mapping[str, str]) -> DataFrame:
    """df that raises when it is computed and a predicate is not true for a row.

    The check is a filter whose other branch raises, so no projection can prune it.
    """
    for name, predicate in expectations.items():
        df = df.where(F.when(F.expr(predicate), True).otherwise(F.raise_error(F.lit(f"expectation {name} failed")).cast("boolean")))
    return df


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(rows, distinct_keys, repeated): repeated counts rows beyond the first of their key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"), F.count(F.lit(1)).alias("distinct_keys")).withColumn("repeated", F.col("rows") - F.col("distinct_keys"))


def reconcile(total: DataFrame, accepted: DataFrame, refused: DataFrame) -> DataFrame:
    """(landed, accepted, refused, lost): lost must be 0."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = count(total, "landed").crossJoin(count(accepted, "accepted")).crossJoin(count(refused, "refused"))  # one row each
    return one.withColumn("lost", F.col("landed") - F.col("accepted") - F.col("refused"))


def reasons(refused: DataFrame, column: str = "_quarantine_reason") -> DataFrame:
    """Refused rows by reason, most first."""
    return refused.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), column)


def gate(accepted: int, refused: int, null_keys: int, warn: float, fail: float, least: int = 1, null_fail: float = 0.0) -> str:
    """"ok" or "warn"; raises GateError beyond the failing thresholds (percent of all rows)."""
    total = accepted + refused
    if total < least:
        raise GateError(f"{total} rows, at least {least} expected")
    share = 100.0 * refused / total if total else 0.0
    if share > fail:
        raise GateError(f"{share:.2f} % refused, more than {fail} %")
    if total and 100.0 * null_keys / total > null_fail:
        raise GateError(f"{null_keys} rows without a key")
    return "warn" if share > warn else "ok"


def reconcile_split(rows: DataFrame, contract, arrived: str | None = None) -> DataFrame:
    """What reconcile() says of a contract's split, from one scan: the flag counts for both sides."""
    flag = contract.valid(arrived, set(rows.columns))
    good, bad = F.count_if(flag), F.count_if(~flag)
    return rows.agg(F.count(F.lit(1)).alias("landed"), good.alias("accepted"), bad.alias("refused"), (F.count(F.lit(1)) - good - bad).alias("lost"))


def members(column: str, *allowed: str) -> str:
    """An expectation: a column's value is among those allowed."""
    listed = ", ".join("'" + a.replace("'", "''") + "'" for a in allowed)
    return f"{column} IN ({listed})"


def protected(df: DataFrame, contract, salt: str, born: str = "birth_date", on: str | None = None, adult: int = 18) -> DataFrame:
    """df as analysts may see it: personal columns of the contract masked, a year for the day of birth, and no minors.

    Minors, on the day given (today, if None), are left out, as are rows whose
    day of birth is not known, and a table without the column is refused:
    access is denied rather than granted.
    """
    if born not in df.columns:
        raise ValueError(f"{contract.name}: no column {born}, by which minors are left out")
    day = F.lit(on).cast("date") if on else F.current_date()
    df = df.where(F.coalesce(F.add_months(F.col(born).cast("date"), 12 * adult) <= day, F.lit(False))).withColumn(born, F.year(F.col(born).cast("date")).cast("string"))
    return masked(df, [c for c in contract.personal if c in df.columns and c != born], salt)


def masked(df: DataFrame, personal: Sequence[str], salt: str) -> DataFrame:
    """df with personal columns as salted digests; null stays null."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256)) for c in personal})


def stale(df: DataFrame, arrived: str, now, most_minutes: int) -> DataFrame:
    """(latest, minutes, is_stale) against a given time."""
    minutes = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("latest")) / 60
    return df.agg(F.max(F.col(arrived).cast("timestamp")).alias("latest")).withColumn("minutes", minutes).withColumn("is_stale", F.coalesce(F.col("minutes") > most_minutes, F.lit(True)))
