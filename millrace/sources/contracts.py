"""Data contracts: a versioned schema, keys, personal columns and what to do about new columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.columns import all_present, first_reason


class Policy(str, Enum):
    """What ingestion does with a column that the contract lacks."""

    RESCUE = "rescue"
    ADD = "addNewColumns"
    FAIL = "failOnNewColumns"
    IGNORE = "none"


class ContractError(ValueError):
    """A contract that contradicts itself."""


_VERSION = re.compile(r"\d+\.\d+\.\d+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")
_TYPE = re.compile(r"(STRING|INT|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP|DECIMAL|BINARY)(\(.*\))?|(ARRAY|STRUCT|MAP)<.*>", re.S)


@dataclass(frozen=True)
class Contract:
    """columns: DDL of one column a line; ! marks a column that must be present, * a personal one."""

    name: str
    version: str
    key: tuple[str, ...]
    policy: Policy
    columns: str
    event_time: str | None = None
    #: Hours that an event may arrive late; None for any.
    lateness: int | None = None
    #: Names of refusals, by column; the key comes first.
    refusals: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        names = self.names
        if not names or len(set(names)) < len(names):
            raise ContractError(f"{self.name}: columns are missing or repeated")
        for line in self._lines():
            name, kind = line.split(None, 1)
            if not _NAME.fullmatch(name.rstrip("!*")) or not _TYPE.fullmatch(kind):
                raise ContractError(f"{self.name}: {line!r} is no column")
        if not self.key or not set(self.key) <= set(names):
            raise ContractError(f"{self.name}: key {self.key} is not among the columns")
        if self.event_time and self.event_time not in names:
            raise ContractError(f"{self.name}: event time {self.event_time} is not among the columns")
        if not _VERSION.fullmatch(self.version):
            raise ContractError(f"{self.name}: version {self.version!r} is not of the form 1.2.3")

    def _lines(self) -> list[str]:
        return [line.strip() for line in self.columns.strip().splitlines() if line.strip()]

    @property
    def names(self) -> list[str]:
        return [line.split()[0].rstrip("!*") for line in self._lines()]

    def ddl(self) -> str:
        parts = ((line.split(None, 1)) for line in self._lines())
        return ", ".join(f"{n.rstrip('!*')} {t}{' NOT NULL' if '!' in n else ''}" for n, t in parts)

    def schema(self) -> StructType:
        """Spark's schema; file readers make every column nullable, so presence is checked by `valid`."""
        return StructType.fromDDL(self.ddl())

    @property
    def required(self) -> list[str]:
        """Columns that must be present; the key, if none is marked."""
        return [n.rstrip("!*") for n in (line.split()[0] for line in self._lines()) if "!" in n] or list(self.key)

    @property
    def personal(self) -> list[str]:
        return [n.rstrip("!*") for n in (line.split()[0] for line in self._lines()) if "*" in n]

    def comment(self, name: str) -> str:
        """What a column is, for a table's definition."""
        told = [w for w, names in (("key", self.key), ("must be present", self.required), ("personal", self.personal), ("time of the event", (self.event_time,))) if name in names]
        return ", ".join(told) or "as delivered"

    def valid(self, arrived: str | None = None, present: set[str] | None = None) -> Column:
        """Whether a row keeps the contract; never null. arrived: the column with the time of arrival.

        present: the columns there are. A row without a column that must be
        present keeps no contract.
        """
        if present is not None and not set(self.required) <= present:
            return F.lit(False)
        ok = all_present(self.required)
        if self.lateness is not None and self.event_time and arrived:
            late = F.col(self.event_time) >= F.col(arrived) - F.expr(f"INTERVAL {self.lateness} HOURS")
            ok = ok & F.coalesce(late, F.lit(False))
        return ok

    def reason(self, present: set[str] | None = None) -> Column:
        """Why a refused row was refused: the first of the named refusals that holds."""
        absent = [c for c in self.required if present is not None and c not in present]
        if absent:
            return F.lit(f"ABSENT_COLUMN_{absent[0].upper()}")
        named = [(F.col(c).isNull(), why) for c, why in self.refusals]
        return first_reason(named, "LATENESS_BEYOND_CONTRACT" if self.lateness is not None else "CONTRACT_VIOLATION")


# Schemas of the landing files as their producers deliver them.
_ALL = (
    Contract(
        "gate_scans",
        "1.1.0",
        ("scan_id",),
        Policy.RESCUE,
        """
        scan_id! STRING
        game_id! STRING
        order_id STRING
        seat_id STRING
        gate! STRING
        scan_ts! TIMESTAMP
        device_id STRING
        device_type STRING
        scan_result STRING
        ticket_medium STRING
        scan_device_os STRING
        """,
        event_time="scan_ts",
        lateness=72,
        refusals=(("scan_id", "NULL_PRIMARY_KEY"), ("game_id", "NULL_GAME_ID"), ("gate", "NULL_GATE"), ("scan_ts", "NULL_EVENT_TIME")),
    ),
    Contract(
        "ticketing_cdc",
        "1.0.0",
        ("order_id", "__seq"),
        Policy.FAIL,
        """
        order_id! STRING
        game_id! STRING
        seat_id! STRING
        account_id! STRING
        seat_class STRING
        channel STRING
        face_price_usd DOUBLE
        paid_price_usd DOUBLE
        purchased_ts TIMESTAMP
        transferred_ts TIMESTAMP
        resold_ts TIMESTAMP
        refunded_ts TIMESTAMP
        is_comp BOOLEAN
        event_type! STRING
        __op! STRING
        __seq! BIGINT
        __commit_ts! TIMESTAMP
        """,
        event_time="__commit_ts",
    ),
    Contract(
        "pos",
        "1.0.0",
        ("txn_line_id",),
        Policy.RESCUE,
        """
        txn_line_id! STRING
        txn_id! STRING
        game_id! STRING
        terminal_id! STRING
        stand_location STRING
        sku! STRING
        item_name STRING
        category STRING
        unit_price_usd DOUBLE
        quantity INT
        gross_amount_usd DOUBLE
        tax_rate DOUBLE
        tax_amount_usd DOUBLE
        tender_type STRING
        txn_ts! TIMESTAMP
        """,
        event_time="txn_ts",
        refusals=(("txn_line_id", "NULL_PRIMARY_KEY"), ("txn_id", "NULL_BASKET_ID"), ("sku", "NULL_SKU"), ("txn_ts", "NULL_EVENT_TIME")),
    ),
    Contract(
        "crm_accounts",
        "1.0.0",
        ("account_id",),
        Policy.ADD,
        """
        account_id! STRING
        first_name* STRING
        last_name* STRING
        email* STRING
        phone* STRING
        street_address* STRING
        postal_code* STRING
        origin_state STRING
        birth_date* DATE
        cohort STRING
        payment_token_last4* STRING
        acquisition_channel STRING
        created_ts TIMESTAMP
        is_active BOOLEAN
        """,
    ),
    Contract(
        "seat_manifest",
        "1.0.0",
        ("seat_id",),
        Policy.ADD,
        """
        seat_id! STRING
        section! INT
        row_label STRING
        seat_number INT
        seat_class! STRING
        face_price_usd DOUBLE
        per_cap_multiplier DOUBLE
        is_ada BOOLEAN
        is_shaded_day BOOLEAN
        renumbered_to_section INT
        renumber_effective_date DATE
        """,
    ),
    Contract(
        "pricing",
        "1.0.0",
        ("price_point_id",),
        Policy.ADD,
        """
        price_point_id! STRING
        game_id! STRING
        seat_class! STRING
        face_price_usd DOUBLE
        listed_price_usd! DOUBLE
        valid_from_ts! TIMESTAMP
        valid_to_ts! TIMESTAMP
        pricing_rule STRING
        """,
        refusals=(("price_point_id", "NULL_PRIMARY_KEY"), ("game_id", "NULL_GAME_ID"), ("valid_from_ts", "NULL_WINDOW"), ("valid_to_ts", "NULL_WINDOW")),
    ),
    Contract(
        "deposits",
        "1.0.0",
        ("deposit_id",),
        Policy.ADD,
        """
        deposit_id! STRING
        account_id! STRING
        deposit_amount_usd DOUBLE
        placed_ts TIMESTAMP
        priority_rank BIGINT
        selection_wave STRING
        selection_event_ts TIMESTAMP
        converted_to_plan BOOLEAN
        plan_type STRING
        seats_selected INT
        deposit_forfeited BOOLEAN
        refunded_ts TIMESTAMP
        """,
    ),
    Contract(
        "schedule",
        "1.0.0",
        ("game_id",),
        Policy.ADD,
        """
        game_id! STRING
        game_date! DATE
        first_pitch_ts! TIMESTAMP
        opponent STRING
        opponent_draw_factor DOUBLE
        day_of_week STRING
        is_weekend BOOLEAN
        is_night_game BOOLEAN
        promotion STRING
        promotion_lift DOUBLE
        outside_temp_f DOUBLE
        roof_closed BOOLEAN
        home_game_number INT
        novelty_index DOUBLE
        entering_win_pct DOUBLE
        result STRING
        """,
    ),
    Contract(
        "sponsorship",
        "1.0.0",
        ("contract_id",),
        Policy.RESCUE,
        """
        contract_id! STRING
        sponsor_name STRING
        tier STRING
        annual_value_usd BIGINT
        term_start DATE
        term_end DATE
        contract_text STRING
        """,
    ),
    Contract(
        "guest_services",
        "1.0.0",
        ("guest_ticket_id",),
        Policy.ADD,
        """
        guest_ticket_id! STRING
        account_id STRING
        game_id STRING
        reported_date DATE
        issue_category_actual STRING
        issue_text* STRING
        channel STRING
        resolution_status STRING
        compensation_usd DOUBLE
        """,
    ),
)
CONTRACTS = {c.name: c for c in _ALL}


def get(name: str) -> Contract:
    """The contract of a source; KeyError names those there are."""
    if name not in CONTRACTS:
        raise KeyError(f"no contract for {name!r}; there are {', '.join(sorted(CONTRACTS))}")
    return CONTRACTS[name]
