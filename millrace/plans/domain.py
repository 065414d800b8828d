"""The domain's tables, derived from the generic test tables; each beside the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEASON_START = "1995-06-01"
MOVED_ON = "1998-06-01"
SNAPSHOTS = ("1996-01-01", "1997-01-01")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHANGES = """
SELECT user_id AS order_id, event_id AS __seq,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'I' WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS __op,
  CASE event_type WHEN 'click' THEN 'TRANSFER' WHEN 'view' THEN 'RESALE' WHEN 'error' THEN 'REFUND' ELSE 'SALE' END AS event_type,
  value AS paid_price_usd,
  CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN ts - INTERVAL 72 HOURS ELSE ts END AS __commit_ts
FROM {events}
"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order changes: refunds of every seventh id are backdated by 72 hours, every 331st event comes twice."""
    events = table(spark, sf_dir, "events")
    rows = spark.sql(CHANGES.format(events="{events}"), events=events)
    return rows.unionByName(rows.where("__seq % 331 = 0"))


CHANGES_SQL = CHANGES.format(events="events")

SEATS_SQL = f"""
SELECT p_partkey AS seat_id, p_brand AS seat_class, p_size AS section, DATE '{SEASON_START}' AS since, DATE '9999-12-31' AS until_, true AS cur FROM part WHERE p_size NOT BETWEEN 18 AND 24
UNION ALL SELECT p_partkey, p_brand, p_size, DATE '{SEASON_START}', DATE '{MOVED_ON}', false FROM part WHERE p_size BETWEEN 18 AND 24
UNION ALL SELECT p_partkey, p_brand, p_size + 100, DATE '{MOVED_ON}', DATE '9999-12-31', true FROM part WHERE p_size BETWEEN 18 AND 24
"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats with their move: sections 18 to 24 gain 100 on MOVED_ON."""
    moved = F.col("p_size").between(18, 24)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seat_id"),
        F.col("p_size").alias("section"),
        F.col("p_brand").alias("seat_class"),
        F.when(moved, F.col("p_size") + 100).alias("moved_to"),
        F.when(moved, F.lit(MOVED_ON)).alias("moved_on"),
    )


def snapshot(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """The first or second delivery of accounts."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("cohort"), F.col("c_nationkey").cast("string").alias("origin_state"), F.col("c_acctbal").alias("balance"))
    if number == 1:
        new = rows.where("account_id <= 10").withColumn("account_id", F.col("account_id") + 1_000_000)
        rows = (
            rows.where("account_id % 11 <> 0")
            .withColumn("cohort", F.when(F.col("account_id") % 5 == 0, "MOVED").otherwise(F.col("cohort")))
            .withColumn("balance", F.when(F.col("account_id") % 7 == 0, F.col("balance") + 1).otherwise(F.col("balance")))
            .unionByName(new)
        )
    return rows.withColumn("snapshot_date", F.lit(SNAPSHOTS[number]))


ACCOUNTS_SQL = f"""
WITH one AS (
  SELECT c_custkey AS account_id, c_mktsegment AS cohort, c_nationkey::VARCHAR AS origin_state, c_acctbal AS balance FROM customer
), two AS (
  SELECT account_id, CASE WHEN account_id % 5 = 0 THEN 'MOVED' ELSE cohort END AS cohort, origin_state, CASE WHEN account_id % 7 = 0 THEN balance + 1 ELSE balance END AS balance
  FROM one WHERE account_id % 11 <> 0
  UNION ALL SELECT account_id + 1000000, cohort, origin_state, balance FROM one WHERE account_id <= 10
), both_ AS (
  SELECT one.*, two.account_id IS NOT NULL AND (two.cohort <> one.cohort OR two.origin_state <> one.origin_state) AS changed FROM one LEFT JOIN two USING (account_id)
)
SELECT account_id, cohort, origin_state, balance, DATE '{SNAPSHOTS[0]}' AS since, CASE WHEN changed THEN DATE '{SNAPSHOTS[1]}' ELSE DATE '9999-12-31' END AS until_, NOT changed AS cur FROM both_
UNION ALL
SELECT two.account_id, two.cohort, two.origin_state, two.balance, DATE '{SNAPSHOTS[1]}', DATE '9999-12-31', true
FROM two LEFT JOIN both_ USING (account_id) WHERE both_.account_id IS NULL OR changed
"""

ORDERS = """
SELECT o_orderkey AS order_id, o_orderkey % 81 AS game_id, o_orderkey % 2100 AS seat_id, o_custkey AS account_id, 'C' || (o_orderkey % 6) AS seat_class,
  o_totalprice AS face_price_usd, CAST(floor(o_totalprice * 0.9) AS DOUBLE) AS paid_price_usd, o_orderdate AS purchased_ts, o_orderstatus = 'F' AS is_refunded,
  CASE o_orderstatus WHEN 'F' THEN 'REFUNDED' WHEN 'P' THEN 'TRANSFERRED' ELSE 'ACTIVE' END AS order_status
FROM {orders}
"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in their current state; seats beyond the manifest are orphans."""
    return spark.sql(ORDERS, orders=table(spark, sf_dir, "orders"))


FACT_SQL = f"""
WITH o AS ({ORDERS.format(orders="orders")}), s AS ({SEATS_SQL}), a AS ({ACCOUNTS_SQL})
SELECT o.order_id, o.game_id, o.seat_id, s.section AS section_at_purchase, o.account_id, a.cohort AS account_cohort, a.origin_state AS account_origin_state, o.seat_class,
  o.face_price_usd, o.paid_price_usd, CASE WHEN o.is_refunded THEN 0.0::DOUBLE ELSE o.paid_price_usd END AS collected_revenue_usd, o.is_refunded, o.order_status, o.purchased_ts,
  s.section IS NULL AS is_orphan_seat
FROM o LEFT JOIN s ON o.seat_id = s.seat_id AND o.purchased_ts::DATE >= s.since AND o.purchased_ts::DATE < s.until_
LEFT JOIN a ON o.account_id = a.account_id AND a.cur
"""

SCANS = """
SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id END AS scan_id, CASE WHEN event_id % 89 = 0 THEN NULL ELSE user_id END AS game_id,
  CASE WHEN event_id % 83 = 0 THEN NULL ELSE event_type END AS gate, CASE WHEN event_id % 79 = 0 THEN NULL ELSE ts END AS scan_ts,
  CASE WHEN event_id % 73 = 0 THEN ts + INTERVAL 73 HOURS ELSE ts + INTERVAL 1 HOURS END AS arrived_ts
FROM {events}
"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate scans with nulls and lateness planted by id."""
    return spark.sql(SCANS, events=table(spark, sf_dir, "events"))


LINES = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS txn_line_id, l_orderkey AS txn_id, l_orderkey % 81 AS game_id, l_quantity AS quantity,
  l_extendedprice AS gross_amount_usd, l_extendedprice * l_tax AS tax_amount_usd, l_tax AS tax_rate
FROM {lineitem}
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale lines."""
    return spark.sql(LINES, lineitem=table(spark, sf_dir, "lineitem"))


POS = """
SELECT CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey END AS txn_line_id, CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE '' || l_orderkey END AS txn_id,
  CASE WHEN l_partkey % 83 = 0 THEN NULL ELSE '' || (l_orderkey % 81) END AS game_id, 'POS-' || (l_suppkey % 40) AS terminal_id, CASE WHEN l_partkey % 79 = 0 THEN NULL ELSE '' || l_partkey END AS sku,
  CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS gross_amount_usd, CASE WHEN l_partkey % 73 = 0 THEN NULL ELSE l_shipdate END AS txn_ts
FROM {lineitem}
"""


def pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale lines as they are landed, with nulls planted by product."""
    return spark.sql(POS.format(lineitem="{lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
