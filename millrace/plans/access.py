"""Access as catalogue objects: SQL functions bound by column tags to roles, behind views.

Columns of a table are tagged (person, birth, ...). A role says which SQL function
masks a tag, and which rows it may see. `grant` makes one view for each role,
whose text calls the functions; the table itself is not to be read by them. What
no rule speaks of is refused: a tag without a mask for a role gives null.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

_NAME = re.compile(r"[A-Za-z_]\w*\Z")
OPEN = "open"


@dataclass(frozen=True)
class Role:
    """What a role sees: mask functions by tag (OPEN for the value itself), and a row filter's function with its columns."""

    name: str
    masks: Mapping[str, str] = field(default_factory=dict)
    rows: tuple[str, tuple[str, ...]] | None = None


def _plain(*names: str) -> None:
    for name in names:
        if not _NAME.match(name):
            raise ValueError(f"{name!r} is no plain name")


def define(spark: SparkSession, name: str, parameters: str, returns: str, body: str, temporary: bool = True) -> None:
    """A SQL function: an expression over its parameters that the optimizer sees through."""
    _plain(name)
    spark.sql(f"CREATE OR REPLACE {'TEMPORARY ' if temporary else ''}FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def standard(spark: SparkSession, salt: str, on: str | None = None, temporary: bool = True) -> None:
    """The functions that the stock roles use: digest, initial, year_of, is_adult."""
    text = salt.replace("\\", "\\\\").replace("'", "\\'")
    day = f"date'{on}'" if on else "current_date()"
    if on and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", on):
        raise ValueError(f"{on!r} is no date")
    define(spark, "digest", "x STRING", "STRING", f"CASE WHEN x IS NOT NULL THEN sha2(concat('{text}', x), 256) END", temporary)
    define(spark, "initial", "x STRING", "STRING", "concat(left(x, 1), '.')", temporary)
    define(spark, "year_of", "x STRING", "STRING", "CAST(year(CAST(x AS DATE)) AS STRING)", temporary)
    define(spark, "is_adult", "born STRING", "BOOLEAN", f"coalesce(add_months(CAST(born AS DATE), 216) <= {day}, false)", temporary)


#: Roles over the tags person and birth.
ROLES = (
    Role("analyst", {"person": "digest", "birth": "year_of"}, ("is_adult", ("birth",))),
    Role("support", {"person": "initial", "birth": "year_of"}),
    Role("steward", {"person": OPEN, "birth": OPEN}),
    Role("visitor", {}, ("is_adult", ("birth",))),
)


def query(columns: Mapping[str, str], tags: Mapping[str, str], role: Role, table: str) -> str:
    """The SELECT of a role over a table: columns by name and type, tags by column.

    A row filter takes columns by tag, unmasked; where the table has no column of
    the tag, a role with a filter is refused rather than given all rows.
    """
    _plain(*columns, *tags.values(), *(m for m in role.masks.values()))
    if unknown := set(tags) - set(columns):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    seen = []
    for c, kind in columns.items():
        tag = tags.get(c)
        mask = OPEN if tag is None else role.masks.get(tag)
        if mask == OPEN:
            seen.append(f"`{c}`")
        elif mask is None:
            seen.append(f"CAST(NULL AS {kind}) AS `{c}`")
        else:
            seen.append(f"{mask}(CAST(`{c}` AS STRING)) AS `{c}`")
    where = ""
    if role.rows:
        function, wanted = role.rows
        _plain(function)
        of = {t: c for c, t in tags.items()}
        if absent := [t for t in wanted if t not in of]:
            raise ValueError(f"{role.name}: rows are filtered by {', '.join(absent)}, which no column has")
        where = f" WHERE {function}({', '.join(f'CAST(`{of[t]}` AS STRING)' for t in wanted)})"
    return f"SELECT {', '.join(seen)} FROM {table}{where}"


def grant(spark: SparkSession, table: str, tags: Mapping[str, str], roles=ROLES, temporary: bool = False) -> dict[str, str]:
    """A view <table>_for_<role> for each role; their names by role."""
    columns = {f.name: f.dataType.simpleString() for f in spark.table(table).schema}
    made = {}
    for role in roles:
        _plain(role.name)
        made[role.name] = f"{table}_for_{role.name}"
        spark.sql(f"CREATE OR REPLACE {'TEMPORARY ' if temporary else ''}VIEW {made[role.name]} AS {query(columns, tags, role, table)}")
    return made
