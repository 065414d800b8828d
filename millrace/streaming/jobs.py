"""Ingestion streams and the watermarked revenue mart."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.columns import signed_revenue
from millrace.operators import observed
from millrace.sources import files, landing
from millrace.sources.contracts import Contract


def json_lines(spark: SparkSession, path: str, contract: Contract, environment: str, max_files: int | None = None) -> DataFrame:
    """A stream of the contract's rows from JSON-lines files, with rescued fields and audit columns."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return landing.rescued(landing.audited(reader.text(path), contract, environment), contract)


def parquet_files(spark: SparkSession, path: str, contract: Contract, environment: str) -> DataFrame:
    """A stream of the contract's rows from Parquet files, with audit columns; see `ingest` for new columns."""
    return landing.audited(spark.readStream.schema(contract.schema()).parquet(path), contract, environment)


def ingest(rows: DataFrame, contract: Contract, table: str, quarantine: str, checkpoint: str, alerts: observed.Alerts | None = None) -> StreamingQuery:
    """Write a stream's valid rows to one Parquet folder and the others to another, once per file.

    Both come from one batch, so they cannot diverge, and a batch that is run
    again after a failure overwrites its own folder: each row is written once.
    Folders are named by the checkpoint and the batch (column batch), so another
    ledger that writes to the same table, or a new one, overwrites nothing.
    Files with columns that a failing policy refuses stop the batch before
    anything is committed. The run ends when all files there are were read.

    Rows are counted while they are written; `told` has the sums. alerts: hears
    of every batch of the stream, as rows under the name it watches.
    """
    keys = {"null_keys": " AND ".join(f"`{k}` IS NOT NULL" for k in contract.key)}
    if alerts:
        arrived = "_source_file_modified_ts" if "_source_file_modified_ts" in rows.columns else None
        rows = rows.observe(alerts.name, *observed.counters({"keeps_contract": contract.valid(arrived, set(rows.columns))}))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if contract.policy is landing.Policy.FAIL:
                new = [r[0] for r in batch.select("_source_file").distinct().toLocalIterator()]
                landing.forbid_new_columns(batch.sparkSession, new, contract)
            good, bad = landing.split(batch, contract)
            (good, accepted), (bad, refused) = observed.watched(good, keys), observed.watched(bad, {})
            folder = f"batch={landing.ledger_id(batch.sparkSession, checkpoint)}-{number}"
            good.write.mode("overwrite").parquet(f"{table}/{folder}")
            bad.write.mode("overwrite").parquet(f"{quarantine}/{folder}")
            counts = {"accepted": accepted()[observed.TOTAL], "refused": refused()[observed.TOTAL], "null_keys": accepted()["null_keys"]}
            files.remove(batch.sparkSession, f"{table}_told/{folder}.json")
            files.write_new(batch.sparkSession, f"{table}_told/{folder}.json", json.dumps(counts))
        finally:
            batch.unpersist()

    if alerts:
        rows.sparkSession.streams.addListener(alerts)
    try:
        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if alerts:
            rows.sparkSession.streams.removeListener(alerts)
    return query


def told(spark: SparkSession, table: str) -> dict[str, int]:
    """{accepted, refused, null_keys} of all that ingest() has written to a table: one small file for each batch, no scan of the rows."""
    names = ("accepted", "refused", "null_keys")
    if not files.names(spark, f"{table}_told"):
        return dict.fromkeys(names, 0)
    rows = spark.read.schema(", ".join(f"{n} long" for n in names)).json(f"{table}_told")
    return {n: int(v or 0) for n, v in rows.agg(*(F.sum(n).alias(n) for n in names)).first().asDict().items()}


def hourly_revenue(events: DataFrame, delay: str = "48 hours") -> DataFrame:
    """Signed revenue by game, seat class and hour of commit, from a stream of changes.

    Repeated changes within the delay count once. Rows later than the delay are
    dropped by the watermark, and hours still open are not given out: the batch
    query over all events is what this converges to. Only changes can be summed
    this way: a table of states, whose rows are replaced, is refused.
    """
    if "__seq" not in events.columns or "is_refunded" in events.columns:
        raise ValueError("changes with their sequence are needed, not orders in their current state")
    timed = events.withColumn("__commit_ts", F.col("__commit_ts").cast("timestamp")).withWatermark("__commit_ts", delay)
    once = timed.dropDuplicatesWithinWatermark(["order_id", "__seq"])
    hourly = once.groupBy("game_id", "seat_class", F.window("__commit_ts", "1 hour").alias("commit_window"))
    return hourly.agg(F.sum(signed_revenue(F.col("event_type"), F.col("paid_price_usd"))).alias("running_revenue_usd"))


def admissions(scans: DataFrame, orders: DataFrame, delay: str = "48 hours") -> DataFrame:
    """Scans of a stream, each ticket once within the delay, with whether their order exists (a static table)."""
    once = scans.withWatermark("scan_ts", delay).dropDuplicatesWithinWatermark(["scan_id"])
    known = orders.select(F.col("order_id"), F.lit(True).alias("has_order")).distinct()
    return once.join(known, "order_id", "left").withColumn("has_order", F.coalesce("has_order", F.lit(False)))


def matched(scans: DataFrame, sales: DataFrame, delay: str = "48 hours", within: str = "2 hours") -> DataFrame:
    """Scans of one stream beside the sales of another at the same game, up to `within` after the scan.

    Both streams are watermarked, so state older than that is let go. Columns:
    scan_id, game_id, scan_ts, txn_line_id, txn_ts.
    """
    left = scans.select("scan_id", "game_id", "scan_ts").withWatermark("scan_ts", delay)
    right = sales.select("txn_line_id", F.col("game_id").alias("_game"), "txn_ts").withWatermark("txn_ts", delay)
    near = (F.col("game_id") == F.col("_game")) & (F.col("txn_ts") >= F.col("scan_ts")) & (F.col("txn_ts") <= F.col("scan_ts") + F.expr(f"INTERVAL {within}"))
    return left.join(right, near).drop("_game")
