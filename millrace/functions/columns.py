"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def signature(columns: Sequence[str]) -> Column:
    """A digest of the columns' values that tells null from any text and cannot be fooled by separators."""
    kept = F.struct(*(F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(columns)))
    return F.sha2(F.to_json(kept, {"ignoreNullFields": "false"}), 256)


def all_present(columns: Sequence[str]) -> Column:
    """Whether none of the columns is null; never null itself."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns), F.lit(True))


def first_reason(reasons: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(otherwise)
    for condition, name in reversed(reasons):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def order_status(event_type: Column) -> Column:
    """State of an order after its latest event; an unknown or null event leaves it active."""
    return F.when(event_type == "REFUND", "REFUNDED").when(event_type == "TRANSFER", "TRANSFERRED").when(event_type == "RESALE", "RESOLD").otherwise("ACTIVE")


def signed_revenue(event_type: Column, paid: Column) -> Column:
    """What an event adds to revenue: sales add, refunds take away, others neither."""
    return F.when(event_type == "SALE", paid).when(event_type == "REFUND", -paid).otherwise(0.0)
