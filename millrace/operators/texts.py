"""Texts of agreements and complaints: clauses, categories and personal data, by expressions alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of what is taken out of complaints, and what stands for it.
PERSONAL = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]"), (r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[PHONE]"))

#: A number and what it counts, to the end of the sentence.
CLAUSE = r"([0-9]+) ([a-z]+[^.]*)\."


def clauses(agreements: DataFrame, text: str = "contract_text", key: str = "contract_id") -> DataFrame:
    """key, amount and obligation of every clause that promises a number of something, one row each."""
    found = F.regexp_extract_all(F.col(text), F.lit(CLAUSE), F.lit(0))
    rows = agreements.select(key, F.explode(found).alias("_clause"))
    return rows.select(key, F.regexp_extract("_clause", CLAUSE, 1).cast("int").alias("amount"), F.regexp_extract("_clause", CLAUSE, 2).alias("obligation"))


def redacted(text: Column) -> Column:
    """A text without addresses and telephone numbers."""
    for pattern, mark in PERSONAL:
        text = F.regexp_replace(text, pattern, mark)
    return text


def category(text: Column, words: Mapping[str, Sequence[str]], otherwise: str = "OTHER") -> Column:
    """The category with the most of its words in a text, the first of equals; `otherwise` if there are none."""
    low = F.lower(text)
    scores = [F.struct(sum((low.contains(w).cast("int") for w in listed), F.lit(0)).alias("n"), F.lit(-place).alias("first"), F.lit(name).alias("name")) for place, (name, listed) in enumerate(words.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"]).otherwise(otherwise)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays' angle; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda total, v: total + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
