"""Queries over streams, increments, sorted merges, observed writes, access and layouts, each beside its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark import pipelines as dp
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import changes, layout, observed, versions
from millrace.plans import access, declared, domain
from millrace.plans.registry import _VERSIONS, _query
from millrace.sources import files, landed
from millrace.streaming import tables

_CHANGES = f"SELECT *, order_id % 10 AS game_id, 'C' || (order_id % 6) AS seat_class FROM ({domain.CHANGES_SQL})"
#: Hours that the watermark has passed when all input was taken; the others are still open.
_STREAMED = f"""WITH c AS ({_CHANGES}) SELECT * FROM (SELECT game_id, seat_class, time_bucket(INTERVAL 1 HOUR, __commit_ts) AS window_start,
    round(sum(CASE event_type WHEN 'SALE' THEN paid_price_usd WHEN 'REFUND' THEN -paid_price_usd ELSE 0.0 END), 2) AS running_revenue_usd FROM c
    GROUP BY 1, 2, 3) WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(__commit_ts)) - INTERVAL 48 HOURS FROM c)"""


@_query(_STREAMED)
def stream_revenue_hourly(spark, sf_dir):
    """The watermarked mart as a stream gives it out: files, state store, append."""
    return tables.drained(tables.revenue(tables.change_stream(spark, sf_dir)), "revenue")


@_query(_STREAMED)
def stream_revenue_sql(spark, sf_dir):
    """The same from SQL text: STREAM(...) with a watermark clause."""
    return tables.drained(tables.revenue_sql(tables.change_stream(spark, sf_dir)), "revenue_sql")


def _stored(df, name):
    path = files.shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@_query(f"SELECT account_id, cohort, origin_state, balance, {_VERSIONS} FROM ({domain.ACCOUNTS_SQL})")
def dim_account_incremental(spark, sf_dir):
    """The account dimension kept up by increments: one delivery is stored, the next is merged into it."""
    first = versions.advance(None, domain.snapshot(spark, sf_dir, 0), ["account_id"], ["cohort", "origin_state"], "snapshot_date")
    return versions.advance(_stored(first, "dim_account"), domain.snapshot(spark, sf_dir, 1), ["account_id"], ["cohort", "origin_state"], "snapshot_date")


@_query(
    """WITH d AS (SELECT o_custkey AS account_id, o_orderdate::DATE AS day, max({'p': o_orderpriority, 's': o_orderstatus}) AS r FROM orders GROUP BY ALL),
    l AS (SELECT account_id, day, r.p AS priority, r.s AS status, lag(r.p) OVER (PARTITION BY account_id ORDER BY day) AS before FROM d),
    o AS (SELECT * FROM l WHERE before IS NULL OR before <> priority)
    SELECT account_id, priority, status, day AS __effective_from, coalesce(lead(day) OVER w, DATE '9999-12-31') AS __effective_to, lead(day) OVER w IS NULL AS __is_current FROM o WINDOW w AS (PARTITION BY account_id ORDER BY day)"""
)
def dim_priority_deliveries(spark, sf_dir):
    """A Type 2 dimension from thousands of dated deliveries in three increments: the plan is one of three steps, not one for each date."""
    orders = domain.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("day"))
    made = None
    for since, until in (("0001-01-01", "1994-01-01"), ("1994-01-01", "1996-07-01"), ("1996-07-01", "9999-01-01")):
        part = orders.where((F.col("day") >= F.lit(since).cast("date")) & (F.col("day") < F.lit(until).cast("date")))
        made = _stored(versions.advance(made, part, ["account_id"], ["priority"], "day"), "dim_priority")
    return made


@_query(
    """WITH v AS (SELECT user_id, ts, max({'p': value, 'e': event_id}) AS r FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT e.event_id, e.user_id, v.r.p AS last_price_usd, v.r.e AS priced_by FROM (SELECT * FROM events WHERE event_type <> 'purchase') AS e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts"""
)
def events_priced_as_of(spark, sf_dir):
    """Every other event with its user's last purchase before it, by a sorted merge: no range condition meets all versions."""
    events = domain.table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'")
    rows = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return versions.as_of_sorted(rows, bought, "user_id", "ts", "ts", {"value": "last_price_usd", "event_id": "priced_by"}).drop("ts")


_LINES_SQL = domain.LINES.format(lineitem="lineitem")


@_query(
    f"""SELECT 'positive_quantity' AS expectation, count(*) FILTER (NOT coalesce(quantity > 0, false)) AS failed, count(*) AS total FROM ({_LINES_SQL})
    UNION ALL SELECT 'taxed', count(*) FILTER (NOT coalesce(tax_rate > 0, false)), count(*) FROM ({_LINES_SQL})"""
)
def line_expectations_observed(spark, sf_dir):
    """line_expectations, counted in the pass that writes the lines."""
    path = files.shared(spark, "lines")
    return observed.violations(domain.lines(spark, sf_dir), {"positive_quantity": "quantity > 0", "taxed": "tax_rate > 0"}, lambda rows: rows.write.parquet(path))


_BORN = "SELECT c_custkey AS account_id, c_name AS first_name, c_mktsegment AS cohort, DATE '2027-01-01' - (c_custkey % 60 * 365)::INTEGER AS birth_date FROM customer"


@_query(
    f"""WITH c AS (SELECT account_id, first_name, cohort, birth_date, birth_date + INTERVAL 216 MONTHS <= DATE '2027-01-01' AS adult FROM ({_BORN}))
    SELECT 'analyst' AS role, account_id, sha256('pepper' || first_name) AS first_name, cohort, '' || year(birth_date) AS birth_date FROM c WHERE adult
    UNION ALL SELECT 'support', account_id, left(first_name, 1) || '.', cohort, '' || year(birth_date) FROM c
    UNION ALL SELECT 'steward', account_id, first_name, cohort, birth_date::VARCHAR FROM c
    UNION ALL SELECT 'visitor', account_id, NULL, cohort, NULL FROM c WHERE adult"""
)
def accounts_by_role(spark, sf_dir):
    """One table as each role sees it: masks and row filters are SQL functions, bound by tags."""
    rows = domain.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    view = f"accounts_{uuid.uuid4().hex}"
    rows.selectExpr("c_custkey AS account_id", "c_name AS first_name", "c_mktsegment AS cohort", "date_sub(date'2027-01-01', CAST(c_custkey % 60 * 365 AS INT)) AS birth_date").createOrReplaceTempView(view)
    access.standard(spark, "pepper", "2027-01-01")
    made = access.grant(spark, view, {"first_name": "person", "birth_date": "birth"}, temporary=True)
    seen = [spark.table(v).withColumn("birth_date", F.col("birth_date").cast("string")).select(F.lit(r).alias("role"), "account_id", "first_name", "cohort", "birth_date") for r, v in made.items()]
    return reduce(DataFrame.unionByName, seen)


_FILTERS = {"l_partkey": (10, 60), "l_suppkey": (3, 5), "l_quantity": (7, 7)}


@_query(" UNION ALL ".join(f"SELECT '{c}' AS filter, count(*) AS rows, round(sum(l_extendedprice), 2) AS price_usd FROM lineitem WHERE {c} BETWEEN {a} AND {b}" for c, (a, b) in _FILTERS.items()))
def lines_on_a_curve(spark, sf_dir):
    """Sale lines stored along a curve through three columns, then read by a filter on each."""
    path = files.shared(spark, "curve")
    layout.write_curved(domain.table(spark, sf_dir, "lineitem"), path, list(_FILTERS), 16)
    stored = spark.read.parquet(path)
    return reduce(DataFrame.unionByName, [stored.where(F.col(c).between(a, b)).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("price_usd")).select(F.lit(c).alias("filter"), "rows", "price_usd") for c, (a, b) in _FILTERS.items()])


_EVENT = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE"
_EVENTS_SQL = "SELECT event_type, count(*) AS events, sum(event_id)::BIGINT AS ids, round(sum(value), 2) AS value_usd, max(ts) AS latest FROM events GROUP BY event_type"


def _landed(spark, sf_dir, kind, name):
    """The events as files of a kind, as another system would land them."""
    path = files.shared(spark, name)
    rows = domain.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp"), "user_id", "event_type", "value").repartition(4, "event_id")
    (rows.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")).format(kind).save(path)
    landed.register(spark)
    return path


def _by_type(rows):
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 2).alias("value_usd"), F.max("ts").cast("timestamp_ntz").alias("latest"))


@_query(_EVENTS_SQL)
def events_landed_json(spark, sf_dir):
    """Events from JSON files by the data source, without a table."""
    return _by_type(spark.read.format("landed").option("kind", "json").schema(_EVENT).load(_landed(spark, sf_dir, "json", "landed")))


@_query(_EVENTS_SQL)
def events_landed_stream(spark, sf_dir):
    """The same as CSV files and as a stream: each is taken once."""
    path = _landed(spark, sf_dir, "csv", "landed")
    return _by_type(tables.drained(spark.readStream.format("landed").option("kind", "csv").schema(_EVENT).load(path), "landed"))


def medallion_graph(spark, sf_dir) -> declared.Graph:
    """Changes landed as a stream, split by an expectation into two sibling streams, then states and counts as materialized views."""
    graph = declared.Graph()
    with graph:

        @dp.materialized_view
        def mart_status():
            bad = spark.table("q_change").agg(F.lit("QUARANTINED").alias("order_status"), F.count(F.lit(1)).alias("orders"))
            return spark.table("sv_order").groupBy("order_status").agg(F.count(F.lit(1)).alias("orders")).unionByName(bad)

        @dp.materialized_view
        def sv_order():
            return changes.latest_state(changes.without_repeats(spark.table("br_change")))

        @dp.table
        def change_raw():
            return tables.change_stream(spark, sf_dir)

        @dp.table
        def br_change():
            return spark.readStream.table("change_raw").where("paid_price_usd >= 5")

        @dp.table
        def q_change():
            return spark.readStream.table("change_raw").where("NOT coalesce(paid_price_usd >= 5, false)")

    return graph


@_query(
    f"""WITH c AS ({domain.CHANGES_SQL}), l AS (SELECT * FROM c WHERE paid_price_usd >= 5 QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY __seq DESC) = 1)
    SELECT CASE event_type WHEN 'REFUND' THEN 'REFUNDED' WHEN 'TRANSFER' THEN 'TRANSFERRED' WHEN 'RESALE' THEN 'RESOLD' ELSE 'ACTIVE' END AS order_status, count(*) AS orders FROM l GROUP BY ALL
    UNION ALL SELECT 'QUARANTINED', count(*) FILTER (NOT coalesce(paid_price_usd >= 5, false)) FROM c"""
)
def declared_marts(spark, sf_dir):
    """A pipeline of streaming tables and materialized views by declaration, run over the given tables."""
    database = f"declared_{uuid.uuid4().hex}"
    medallion_graph(spark, sf_dir).run(spark, files.shared(spark, "declared"), database)
    return spark.table(f"{database}.mart_status")
