"""All queries of the lakehouse operators, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import signed_revenue
from millrace.operators import changes, checks, star, versions
from millrace.plans import domain
from millrace.sources import contracts, landing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


_LATEST = f"SELECT *, __op = 'D' AS is_refunded, CASE event_type WHEN 'REFUND' THEN 'REFUNDED' WHEN 'TRANSFER' THEN 'TRANSFERRED' WHEN 'RESALE' THEN 'RESOLD' ELSE 'ACTIVE' END AS order_status FROM ({domain.CHANGES_SQL}) QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY __seq DESC) = 1"
_STATE = "order_id, __seq, event_type, paid_price_usd, is_refunded, order_status"


def _state(spark, sf_dir):
    return changes.latest_state(changes.without_repeats(domain.changes(spark, sf_dir)))


@_query(f"SELECT {_STATE} FROM ({_LATEST})")
def cdc_latest_state(spark, sf_dir):
    return _state(spark, sf_dir).select(*_STATE.split(", "))


@_query(f"SELECT {_STATE} FROM ({_LATEST}) WHERE NOT is_refunded")
def cdc_active_orders(spark, sf_dir):
    return changes.active(_state(spark, sf_dir)).select(*_STATE.split(", "))


@_query(f"SELECT order_status, count(*) AS orders FROM ({_LATEST}) GROUP BY order_status")
def cdc_status_counts(spark, sf_dir):
    return _state(spark, sf_dir).groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))


@_query(
    f"""WITH c AS ({domain.CHANGES_SQL}), s AS (SELECT order_id, __seq FROM c QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY __seq DESC) = 1),
    t AS (SELECT order_id, __seq FROM c QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY __commit_ts DESC, __seq DESC) = 1)
    SELECT s.order_id, s.__seq AS by_sequence, t.__seq AS by_commit_time FROM s JOIN t USING (order_id) WHERE s.__seq <> t.__seq"""
)
def cdc_commit_time_misleads(spark, sf_dir):
    """Orders for which ordering by commit time gives another event than the sequence."""
    events = changes.without_repeats(domain.changes(spark, sf_dir))
    top = events.groupBy("order_id").agg(F.max("__seq").alias("by_sequence"), F.max_by("__seq", F.struct("__commit_ts", "__seq")).alias("by_commit_time"))
    return top.where("by_sequence <> by_commit_time")


@_query(
    f"""SELECT order_id, __seq, event_type, lag(event_type) OVER w AS previous_event,
    (floor(epoch(__commit_ts)) - lag(floor(epoch(__commit_ts))) OVER w)::DOUBLE / 3600 AS hours_since FROM ({domain.CHANGES_SQL}) WINDOW w AS (PARTITION BY order_id ORDER BY __seq)"""
)
def cdc_transitions(spark, sf_dir):
    return changes.transitions(changes.without_repeats(domain.changes(spark, sf_dir))).select("order_id", "__seq", "event_type", "previous_event", "hours_since")


_VERSIONS = "since AS __effective_from, until_ AS __effective_to, cur AS __is_current"


def _seats(spark, sf_dir):
    return versions.split_moves(domain.manifest(spark, sf_dir), "section", "moved_to", "moved_on", domain.SEASON_START)


def _accounts(spark, sf_dir):
    return versions.fold([domain.snapshot(spark, sf_dir, k) for k in (0, 1)], ["account_id"], ["cohort", "origin_state"], "snapshot_date")


def _fact(spark, sf_dir):
    return star.order_fact(domain.orders(spark, sf_dir), _seats(spark, sf_dir), _accounts(spark, sf_dir))


@_query(f"SELECT seat_id, section, seat_class, {_VERSIONS} FROM ({domain.SEATS_SQL})")
def dim_seat(spark, sf_dir):
    return _seats(spark, sf_dir)


@_query(f"SELECT account_id, cohort, origin_state, balance, {_VERSIONS} FROM ({domain.ACCOUNTS_SQL})")
def dim_account(spark, sf_dir):
    return _accounts(spark, sf_dir)


@_query(f"SELECT cur AS __is_current, count(*) AS versions FROM ({domain.ACCOUNTS_SQL}) GROUP BY cur")
def dim_account_reapplied(spark, sf_dir):
    """The second snapshot applied twice: as many versions as once."""
    again = versions.merge(_accounts(spark, sf_dir), domain.snapshot(spark, sf_dir, 1), ["account_id"], ["cohort", "origin_state"], "snapshot_date")
    return again.groupBy("__is_current").agg(F.count(F.lit(1)).alias("versions"))


@_query(domain.FACT_SQL)
def fact_ticket_order(spark, sf_dir):
    return _fact(spark, sf_dir)


@_query(
    f"""SELECT game_id, sum(CASE WHEN is_refunded THEN 0 ELSE 1 END)::BIGINT AS tickets_sold, round(sum(collected_revenue_usd), 2) AS collected_revenue_usd,
    round(sum(CASE WHEN is_refunded THEN paid_price_usd ELSE 0.0 END), 2) AS refunded_usd, round(sum(face_price_usd), 2) AS total_face_usd, count(*) AS order_rows
    FROM ({domain.FACT_SQL}) GROUP BY game_id"""
)
def game_pnl(spark, sf_dir):
    out = star.game_pnl(_fact(spark, sf_dir))
    return out.withColumns({c: F.round(c, 2) for c in ("collected_revenue_usd", "refunded_usd", "total_face_usd")})


_REVENUE_SQL = f"SELECT game_id, seat_class, round(sum(collected_revenue_usd), 2) AS collected_revenue_usd, sum(CASE WHEN NOT is_refunded THEN 1 ELSE 0 END)::BIGINT AS tickets_sold FROM ({domain.FACT_SQL}) GROUP BY game_id, seat_class"


@_query(_REVENUE_SQL)
def mart_revenue_by_seat_class(spark, sf_dir):
    return star.revenue_by_class(_fact(spark, sf_dir)).withColumn("collected_revenue_usd", F.round("collected_revenue_usd", 2))


@_query(_REVENUE_SQL)
def mart_revenue_sql_form(spark, sf_dir):
    return spark.sql(
        "SELECT game_id, seat_class, round(sum(collected_revenue_usd), 2) AS collected_revenue_usd, sum(CASE WHEN NOT is_refunded THEN 1 ELSE 0 END) AS tickets_sold FROM {fact} GROUP BY game_id, seat_class",
        fact=_fact(spark, sf_dir),
    )


@_query(
    """SELECT d::DATE AS date, strftime(d, '%Y%m%d')::INTEGER AS date_key, year(d)::INTEGER AS year, month(d)::INTEGER AS month, day(d)::INTEGER AS day,
    (dayofweek(d) + 1)::INTEGER AS day_of_week, dayname(d) AS day_name, dayofweek(d) IN (0, 6) AS is_weekend
    FROM (SELECT unnest(range(min(o_orderdate)::DATE, max(o_orderdate)::DATE + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM orders)"""
)
def dim_date(spark, sf_dir):
    """The calendar of all days from the first order to the last."""
    return star.date_dimension(star.dates_of(domain.table(spark, sf_dir, "orders"), "o_orderdate"))


@_query(
    f"""WITH c AS ({domain.CHANGES_SQL}) SELECT order_id % 10 AS game_id, time_bucket(INTERVAL 1 HOUR, __commit_ts) AS window_start,
    round(sum(CASE event_type WHEN 'SALE' THEN paid_price_usd WHEN 'REFUND' THEN -paid_price_usd ELSE 0.0 END), 2) AS running_revenue_usd FROM c GROUP BY ALL"""
)
def mart_revenue_hourly(spark, sf_dir):
    """The batch answer that the watermarked stream converges to."""
    events = changes.without_repeats(domain.changes(spark, sf_dir))
    hourly = events.groupBy((F.col("order_id") % 10).alias("game_id"), F.window("__commit_ts", "1 hour").alias("w"))
    out = hourly.agg(F.round(F.sum(signed_revenue(F.col("event_type"), F.col("paid_price_usd"))), 2).alias("running_revenue_usd"))
    return out.select("game_id", F.col("w.start").alias("window_start"), "running_revenue_usd")


_REASON_SQL = f"""SELECT *, scan_id IS NOT NULL AND game_id IS NOT NULL AND gate IS NOT NULL AND scan_ts IS NOT NULL AND scan_ts >= arrived_ts - INTERVAL 72 HOURS AS ok,
  CASE WHEN scan_id IS NULL THEN 'NULL_PRIMARY_KEY' WHEN game_id IS NULL THEN 'NULL_GAME_ID' WHEN gate IS NULL THEN 'NULL_GATE' WHEN scan_ts IS NULL THEN 'NULL_EVENT_TIME' ELSE 'LATENESS_BEYOND_CONTRACT' END AS reason
  FROM ({domain.SCANS.format(events='events')})"""


def _scans(spark, sf_dir):
    return landing.split(domain.scans(spark, sf_dir), contracts.get("gate_scans"), arrived="arrived_ts")


@_query(f"SELECT scan_id, game_id, gate, scan_ts FROM ({_REASON_SQL}) WHERE ok")
def scans_accepted(spark, sf_dir):
    return _scans(spark, sf_dir)[0].select("scan_id", "game_id", "gate", "scan_ts")


@_query(f"SELECT reason AS _quarantine_reason, count(*) AS rows FROM ({_REASON_SQL}) WHERE NOT coalesce(ok, false) GROUP BY reason")
def scans_quarantined(spark, sf_dir):
    return checks.reasons(_scans(spark, sf_dir)[1])


@_query(f"SELECT count(*) AS landed, count(*) FILTER (coalesce(ok, false)) AS accepted, count(*) FILTER (NOT coalesce(ok, false)) AS refused, 0::BIGINT AS lost FROM ({_REASON_SQL})")
def scans_reconciled(spark, sf_dir):
    return checks.reconcile_split(domain.scans(spark, sf_dir), contracts.get("gate_scans"), "arrived_ts")


_LINE_KEYS = "SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber"


@_query(f"SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_keys, (sum(n) - count(*))::BIGINT AS repeated FROM ({_LINE_KEYS})")
def line_key_uniqueness(spark, sf_dir):
    return checks.uniqueness(domain.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_LINES_SQL = domain.LINES.format(lineitem="lineitem")


@_query(
    f"""SELECT 'positive_quantity' AS expectation, count(*) FILTER (NOT coalesce(quantity > 0, false)) AS failed, count(*) AS total FROM ({_LINES_SQL})
    UNION ALL SELECT 'taxed', count(*) FILTER (NOT coalesce(tax_rate > 0, false)), count(*) FROM ({_LINES_SQL})"""
)
def line_expectations(spark, sf_dir):
    return checks.violations(domain.lines(spark, sf_dir), {"positive_quantity": "quantity > 0", "taxed": "tax_rate > 0"})


@_query(
    f"""SELECT game_id, txn_id, count(*) AS lines, sum(quantity)::BIGINT AS units, round(sum(gross_amount_usd), 2) AS gross_usd, round(sum(tax_amount_usd), 4) AS tax_usd
    FROM (SELECT DISTINCT ON (txn_line_id) * FROM (SELECT game_id, txn_id, txn_line_id, min(quantity) AS quantity, min(gross_amount_usd) AS gross_amount_usd, min(tax_amount_usd) AS tax_amount_usd FROM ({_LINES_SQL}) GROUP BY ALL)) GROUP BY game_id, txn_id"""
)
def sale_baskets(spark, sf_dir):
    lines = domain.lines(spark, sf_dir).groupBy("game_id", "txn_id", "txn_line_id").agg(*(F.min(c).alias(c) for c in ("quantity", "gross_amount_usd", "tax_amount_usd")))
    return star.baskets(lines, repeated=False).withColumns({"gross_usd": F.round("gross_usd", 2), "tax_usd": F.round("tax_usd", 4)})


@_query(
    """SELECT o_orderpriority AS plan_type, count(*) AS deposits, sum((o_orderstatus = 'O')::INTEGER)::BIGINT AS converted, sum((o_orderstatus = 'O')::INTEGER)::BIGINT::DOUBLE / count(*) AS conversion_rate
    FROM orders GROUP BY o_orderpriority"""
)
def deposit_funnel(spark, sf_dir):
    rows = domain.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("plan_type"), (F.col("o_orderstatus") == "O").alias("converted_to_plan"))
    return star.deposit_funnel(rows)


_WINDOWS = "SELECT o_custkey AS account_id, o_orderkey AS price_point_id, o_orderdate AS valid_from, o_orderdate + INTERVAL 60 DAYS AS valid_to FROM {orders}"


@_query(
    f"SELECT account_id, price_point_id, valid_from, least(valid_to, lead(valid_from) OVER (PARTITION BY account_id ORDER BY valid_from, price_point_id)) AS valid_to FROM ({_WINDOWS.format(orders='(SELECT DISTINCT ON (o_custkey, o_orderdate) * FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey)')})"
)
def price_windows(spark, sf_dir):
    """Windows cut where the next of their key begins; of windows that begin together the first id stays."""
    orders = domain.table(spark, sf_dir, "orders")
    first = orders.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey"))
    return versions.resolve_windows(spark.sql(_WINDOWS, orders=first), ["account_id"], "valid_from", "valid_to")


@_query("SELECT c_custkey AS account_id, sha256('pepper' || c_name) AS name, c_mktsegment AS cohort FROM customer")
def accounts_masked(spark, sf_dir):
    rows = domain.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("cohort"))
    return checks.masked(rows, ["name"], "pepper")


@_query(
    f"""SELECT game_id, round(sum(collected_revenue_usd) / nullif(sum(CASE WHEN is_refunded THEN 0 ELSE 1 END), 0), 4) AS per_ticket_usd,
    round(sum(CASE WHEN is_refunded THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS refund_rate, sum(is_orphan_seat::INTEGER)::BIGINT AS orphans FROM ({domain.FACT_SQL}) GROUP BY game_id"""
)
def game_ratios(spark, sf_dir):
    sold = F.sum((~F.col("is_refunded")).cast("int"))
    return _fact(spark, sf_dir).groupBy("game_id").agg(
        F.round(F.try_divide(F.sum("collected_revenue_usd"), sold), 4).alias("per_ticket_usd"),
        F.round(F.sum(F.col("is_refunded").cast("int")) / F.count(F.lit(1)), 6).alias("refund_rate"),
        F.sum(F.col("is_orphan_seat").cast("int")).alias("orphans"),
    )
