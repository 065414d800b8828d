"""Streams whose rows are a query's result: from a table's files through a state store to a stored table.

A run takes all files that are there (available now), under a checkpoint of its
own in the shared folder; its rows are read back from the sink, whose log of
commits tells which files count. Nothing is gathered on the driver, and a run
that was cut off goes on from its checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import signed_revenue
from millrace.plans import domain
from millrace.sources import files


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream of rows."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A pattern: the source takes a single file only by one.
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def drained(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """What a stream has given out when all its input was taken, as a stored table.

    path: a folder of an earlier run, to go on from; its table then has the rows
    of both. Rows of a batch that was cut off are not in the sink's log, and are
    not read.
    """
    spark = rows.sparkSession
    path = path or files.shared(spark, name)
    query = rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def change_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """Order changes as they are appended, with the game and class that the marts group by."""
    rows = spark.sql(domain.CHANGES, events=table_stream(spark, sf_dir, "events", max_files))
    return rows.select("*", (F.col("order_id") % 10).alias("game_id"), F.concat(F.lit("C"), (F.col("order_id") % 6).cast("string")).alias("seat_class")).withColumn("__commit_ts", F.col("__commit_ts").cast("timestamp"))


#: The mart as SQL over a stream: the watermark is a clause of the relation.
REVENUE = """
SELECT game_id, seat_class, window.start AS window_start, round(running_revenue_usd, 2) AS running_revenue_usd FROM (
  SELECT game_id, seat_class, window(__commit_ts, '1 hour') AS window,
    sum(CASE event_type WHEN 'SALE' THEN paid_price_usd WHEN 'REFUND' THEN -paid_price_usd ELSE 0.0D END) AS running_revenue_usd
  FROM STREAM({changes}) WATERMARK __commit_ts DELAY OF INTERVAL {hours} HOURS
  GROUP BY game_id, seat_class, window(__commit_ts, '1 hour'))
"""


def revenue_sql(changes: DataFrame, hours: int = 48) -> DataFrame:
    """Signed revenue by game, class and hour from a stream, planned from text: STREAM(...) under a watermark."""
    view = f"changes_{uuid.uuid4().hex}"
    changes.createOrReplaceTempView(view)
    try:
        return changes.sparkSession.sql(REVENUE.format(changes=view, hours=int(hours)))
    finally:
        changes.sparkSession.catalog.dropTempView(view)  # the plan holds what it needs


def revenue(changes: DataFrame, hours: int = 48) -> DataFrame:
    """The same by DataFrame functions."""
    timed = changes.withWatermark("__commit_ts", f"{hours} hours")
    hourly = timed.groupBy("game_id", "seat_class", F.window("__commit_ts", "1 hour").alias("w"))
    summed = hourly.agg(F.round(F.sum(signed_revenue(F.col("event_type"), F.col("paid_price_usd"))), 2).alias("running_revenue_usd"))
    return summed.select("game_id", "seat_class", F.col("w.start").alias("window_start"), "running_revenue_usd")
