"""Queries over the sale lines, dimensions, ratios and texts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import changes, checks, star, texts, versions
from millrace.plans import domain
from millrace.plans.registry import _fact, _query, _seats
from millrace.sources import contracts, landing

# --- sale lines routed by their contract -------------------------------------------------

_POS_SQL = domain.POS.format(lineitem="lineitem")
_POS_REASON = f"""SELECT *, CASE WHEN txn_line_id IS NULL THEN 'NULL_PRIMARY_KEY' WHEN txn_id IS NULL THEN 'NULL_BASKET_ID' WHEN sku IS NULL THEN 'NULL_SKU' WHEN txn_ts IS NULL THEN 'NULL_EVENT_TIME'
  WHEN game_id IS NULL OR terminal_id IS NULL THEN 'CONTRACT_VIOLATION' END AS reason FROM ({_POS_SQL})"""


@_query(f"SELECT txn_line_id, txn_id, sku, terminal_id, quantity, gross_amount_usd FROM ({_POS_REASON}) WHERE reason IS NULL")
def pos_accepted(spark, sf_dir):
    good = landing.split(domain.pos(spark, sf_dir), contracts.get("pos"))[0]
    return good.select("txn_line_id", "txn_id", "sku", "terminal_id", "quantity", "gross_amount_usd")


@_query(f"SELECT reason AS _quarantine_reason, count(*) AS rows FROM ({_POS_REASON}) WHERE reason IS NOT NULL GROUP BY reason")
def pos_quarantined(spark, sf_dir):
    return checks.reasons(landing.split(domain.pos(spark, sf_dir), contracts.get("pos"))[1])


@_query(f"SELECT count(*) AS landed, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS refused, 0::BIGINT AS lost FROM ({_POS_REASON})")
def pos_reconciled(spark, sf_dir):
    return checks.reconcile_split(domain.pos(spark, sf_dir), contracts.get("pos"))


@_query("SELECT 'known_verb' AS expectation, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS failed, count(*) AS total FROM events")
def event_members(spark, sf_dir):
    return checks.violations(domain.table(spark, sf_dir, "events"), {"known_verb": checks.members("event_type", "click", "view", "purchase")})


# --- dimensions --------------------------------------------------------------------------


@_query(
    """SELECT o_orderkey % 81 AS game_id, o_orderdate, o_orderkey, o_orderstatus, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderkey % 81 ORDER BY o_orderdate DESC, o_orderkey DESC, o_orderstatus DESC, o_orderpriority DESC) = 1"""
)
def dim_game(spark, sf_dir):
    """A Type 1 dimension: of each game the latest delivery."""
    rows = domain.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 81).alias("game_id"), "o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return star.latest_by_key(rows, ["game_id"], "o_orderdate")


@_query(
    """WITH p AS (SELECT p_partkey AS sku, p_name AS item_name, p_retailprice AS unit_price_usd, p_partkey % 5 = 0 AS dearer FROM part)
    SELECT sku, item_name, unit_price_usd, DATE '2027-04-01' AS __effective_from, CASE WHEN dearer THEN DATE '2027-06-01' ELSE DATE '9999-12-31' END AS __effective_to, NOT dearer AS __is_current FROM p
    UNION ALL SELECT sku, item_name, unit_price_usd + 1, DATE '2027-06-01', DATE '9999-12-31', true FROM p WHERE dearer"""
)
def dim_product(spark, sf_dir):
    """A Type 2 dimension that tracks the price; every fifth product is dearer from June."""
    first = domain.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("item_name"), F.col("p_retailprice").alias("unit_price_usd"), F.lit("2027-04-01").alias("on"))
    second = first.withColumn("on", F.lit("2027-06-01")).withColumn("unit_price_usd", F.when(F.col("sku") % 5 == 0, F.col("unit_price_usd") + 1).otherwise(F.col("unit_price_usd")))
    return versions.fold([first, second], ["sku"], ["unit_price_usd"], "on")


@_query("SELECT p_brand AS promotion, max(p_partkey) AS price_point_id, arg_max(p_type, p_partkey) AS kind FROM part GROUP BY p_brand")
def dim_promo(spark, sf_dir):
    rows = domain.table(spark, sf_dir, "part").select(F.col("p_brand").alias("promotion"), F.col("p_partkey").alias("price_point_id"), F.col("p_type").alias("kind"))
    return star.latest_by_key(rows, ["promotion"], "price_point_id")


# --- ratios ------------------------------------------------------------------------------

_ADMITTED = "SELECT o_orderkey AS order_id, o_orderkey % 81 AS game_id FROM orders WHERE o_orderkey % 7 <> 0"


def _admitted(spark, sf_dir):
    return spark.sql(_ADMITTED.replace("FROM orders", "FROM {orders}"), orders=domain.table(spark, sf_dir, "orders"))


@_query(
    f"""WITH f AS ({domain.FACT_SQL}), s AS (SELECT 'C' || (seat_id % 6) AS seat_class, count(*) AS seats FROM ({domain.SEATS_SQL}) WHERE cur GROUP BY 1)
    SELECT game_id, seat_class, sold, seats, sold::DOUBLE / seats AS sell_through FROM (SELECT game_id, seat_class, count(DISTINCT seat_id) AS sold FROM f WHERE NOT is_refunded GROUP BY ALL) JOIN s USING (seat_class)"""
)
def metric_sell_through(spark, sf_dir):
    seats = _seats(spark, sf_dir).withColumn("seat_class", F.concat(F.lit("C"), (F.col("seat_id") % 6).cast("string")))
    return star.sell_through(_fact(spark, sf_dir), seats)


@_query(
    f"""SELECT account_cohort, count(*) AS tickets, count(*) FILTER (a.order_id IS NULL) AS missed, (count(*) FILTER (a.order_id IS NULL))::DOUBLE / count(*) AS no_show_rate
    FROM ({domain.FACT_SQL}) AS f LEFT JOIN ({_ADMITTED}) AS a ON a.order_id = f.order_id WHERE NOT is_refunded GROUP BY account_cohort"""
)
def metric_no_show(spark, sf_dir):
    return star.no_show(_fact(spark, sf_dir), _admitted(spark, sf_dir))


@_query(
    f"""WITH h AS (SELECT game_id, count(DISTINCT order_id) AS admissions FROM ({_ADMITTED}) GROUP BY game_id), g AS (SELECT l_orderkey % 81 AS game_id, sum(l_extendedprice) AS gross_usd FROM lineitem GROUP BY 1)
    SELECT game_id, admissions, round(gross_usd, 2) AS gross_usd, round(coalesce(gross_usd, 0) / admissions, 4) AS per_cap_usd FROM h LEFT JOIN g USING (game_id)"""
)
def metric_per_cap(spark, sf_dir):
    return star.per_cap(domain.lines(spark, sf_dir), _admitted(spark, sf_dir)).withColumns({"gross_usd": F.round("gross_usd", 2), "per_cap_usd": F.round("per_cap_usd", 4)})


@_query(f"SELECT game_id, seat_class, round(sum(paid_price_usd) / nullif(sum(face_price_usd), 0), 6) AS price_realization FROM ({domain.FACT_SQL}) WHERE NOT is_refunded GROUP BY ALL")
def metric_price_realization(spark, sf_dir):
    return star.price_realization(_fact(spark, sf_dir)).withColumn("price_realization", F.round("price_realization", 6))


@_query(
    f"""WITH g AS (SELECT game_id, sum((NOT is_refunded)::INTEGER)::BIGINT AS tickets_sold, round(0.62 * exp(-3.1 * game_id / 80.0) + 0.55, 4) AS novelty_index FROM ({domain.FACT_SQL}) GROUP BY game_id)
    SELECT game_id, tickets_sold, round(tickets_sold - (SELECT regr_intercept(tickets_sold, novelty_index) FROM g) - (SELECT regr_slope(tickets_sold, novelty_index) FROM g) * novelty_index, 4) AS residual FROM g"""
)
def metric_novelty(spark, sf_dir):
    games = star.mart(_fact(spark, sf_dir), ["game_id"], ["tickets_sold"]).withColumn("novelty_index", F.expr("round(0.62D * exp(-3.1D * game_id / 80.0D) + 0.55D, 4)"))
    return star.novelty(games).withColumn("residual", F.round("residual", 4))


@_query(
    f"""WITH f AS ({domain.FACT_SQL}) SELECT account_id, count(*) AS orders, sum(is_refunded::INTEGER)::BIGINT AS refunds, round(sum(collected_revenue_usd), 2) AS revenue_usd,
    (date_diff('day', max(purchased_ts::DATE), (SELECT max(purchased_ts::DATE) FROM f)))::INTEGER AS days_since FROM f GROUP BY account_id"""
)
def metric_account_health(spark, sf_dir):
    return star.account_health(_fact(spark, sf_dir)).withColumn("revenue_usd", F.round("revenue_usd", 2))


@_query(
    f"""SELECT s.scan_id, s.gate, o_orderkey IS NOT NULL AS has_order FROM (SELECT scan_id, min(gate) AS gate FROM ({domain.SCANS.format(events='events')}) WHERE scan_id IS NOT NULL GROUP BY scan_id) AS s
    LEFT JOIN orders ON o_orderkey = s.scan_id * 2"""
)
def admissions(spark, sf_dir):
    """Each scan once, with whether its ticket's order exists."""
    once = domain.scans(spark, sf_dir).where("scan_id IS NOT NULL").groupBy("scan_id").agg(F.min("gate").alias("gate"))
    known = domain.table(spark, sf_dir, "orders").select((F.col("o_orderkey")).alias("order_id"), F.lit(True).alias("has_order"))
    told = once.join(known, F.col("scan_id") * 2 == F.col("order_id"), "left")
    return told.select("scan_id", "gate", F.coalesce("has_order", F.lit(False)).alias("has_order"))


# --- orders, texts, access ---------------------------------------------------------------


@_query("SELECT o_orderkey AS deposit_id, o_orderdate AS placed_ts, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS priority_rank FROM (SELECT DISTINCT ON (o_orderkey) * FROM orders)")
def deposit_priority(spark, sf_dir):
    rows = domain.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deposit_id"), F.col("o_orderdate").alias("placed_ts"))
    return star.priority_ranks(rows.dropDuplicates(["deposit_id"]))


@_query("SELECT p_brand AS seat_class, median(p_retailprice) AS median_usd, avg(p_size)::DOUBLE AS mean_size FROM part GROUP BY p_brand")
def price_medians(spark, sf_dir):
    return domain.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("seat_class")).agg(F.median("p_retailprice").alias("median_usd"), F.avg("p_size").alias("mean_size"))


@_query("SELECT p_partkey, concat_ws('-', p_brand, p_size::VARCHAR, p_type) AS label FROM part WHERE p_name LIKE '%a%' AND regexp_matches(p_brand, '[13]$') ORDER BY p_partkey LIMIT 20")
def parts_matching(spark, sf_dir):
    """The first twenty parts that match a pattern, with a label of their attributes."""
    rows = domain.table(spark, sf_dir, "part").where("p_name LIKE '%a%' AND p_brand RLIKE '[13]$'")
    return rows.select("p_partkey", F.concat_ws("-", "p_brand", F.col("p_size").cast("string"), "p_type").alias("label")).orderBy("p_partkey").limit(20)


@_query(
    """SELECT c_custkey::VARCHAR AS account_id, sha256('pepper' || c_name) AS first_name, c_mktsegment AS cohort, '' || year(born) AS birth_date
    FROM (SELECT *, (DATE '2027-01-01' - (c_custkey % 60 * 365)::INTEGER) AS born FROM customer) WHERE born + INTERVAL 18 YEARS <= DATE '2027-01-01'"""
)
def accounts_protected(spark, sf_dir):
    """Accounts as analysts see them: personal columns of the contract masked, no minors."""
    rows = domain.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("account_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("cohort"), F.expr("date_sub(date'2027-01-01', cast(c_custkey % 60 * 365 AS int))").alias("birth_date")
    )
    return checks.protected(rows, contracts.get("crm_accounts"), "pepper", on="2027-01-01")


@_query("SELECT max(ts) AS latest, epoch(TIMESTAMP '2030-01-01' - date_trunc('second', max(ts))) / 60 AS minutes, true AS is_stale FROM events")
def freshness(spark, sf_dir):
    return checks.stale(domain.table(spark, sf_dir, "events"), "ts", "2030-01-01 00:00:00", 120)


@_query(
    f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '{texts.PERSONAL[0][0]}', '[EMAIL]', 'g'), '{texts.PERSONAL[1][0]}', '[PHONE]', 'g')) AS redacted_sha256 FROM documents"""
)
def documents_redacted(spark, sf_dir):
    """Every text without addresses and telephone numbers, as a digest."""
    rows = domain.table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.sha2(texts.redacted(F.coalesce("text", F.lit(""))), 256).alias("redacted_sha256"))


@_query(f"SELECT order_id, event_type, __seq FROM ({domain.CHANGES_SQL}) ORDER BY __commit_ts, __seq LIMIT 100")
def cdc_first_commits(spark, sf_dir):
    """The hundred changes committed first, as files are split by commit time."""
    rows = changes.without_repeats(domain.changes(spark, sf_dir))
    return rows.orderBy("__commit_ts", "__seq").limit(100).select("order_id", "event_type", "__seq")


@_query(
    """SELECT o_orderkey % 81 AS game_id, count(*) AS orders, count(DISTINCT o_custkey) AS accounts, count(*) FILTER (c_mktsegment = 'BUILDING') AS by_cohort
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
)
def cohort_lookups(spark, sf_dir):
    """Orders looked up in their accounts, whose side is broadcast where its size allows."""
    orders = domain.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 81).alias("game_id"), "o_custkey")
    people = domain.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return orders.join(people, "o_custkey").groupBy("game_id").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("accounts"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("by_cohort"))
