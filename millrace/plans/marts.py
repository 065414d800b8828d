"""One mart four ways: table, view, refreshable view, and (in millrace.streaming) watermarked stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import star
from millrace.plans.versioned import Versioned


def databases(spark: SparkSession, layers=("bronze", "silver", "gold", "quarantine", "ops")) -> list[str]:
    """Make the layers' databases; those there are, for a smoke test."""
    for layer in layers:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer} COMMENT 'layer {layer}'")
    return sorted(d.name for d in spark.catalog.listDatabases())


def as_table(fact: DataFrame, name: str) -> None:
    """The mart as of now, stored."""
    star.revenue_by_class(fact).write.mode("overwrite").saveAsTable(name)


def as_view(spark: SparkSession, fact_table: str, name: str) -> None:
    """The mart as a query, computed at each read."""
    spark.sql(
        f"""CREATE OR REPLACE VIEW {name} AS SELECT game_id, seat_class, sum(collected_revenue_usd) AS collected_revenue_usd,
        sum(CASE WHEN NOT is_refunded THEN 1 ELSE 0 END) AS tickets_sold FROM {fact_table} GROUP BY game_id, seat_class"""
    )


class Refreshable:
    """A stored mart that is brought up to date when told, in whole or by the games that changed.

    Every refresh makes a new version and then points the view at it, so readers
    and a refresh that reads the old rows never meet a half-written table; the
    pointer outlives the process. A game's rows depend on its orders alone, so
    refreshing the changed games from their current orders equals a full refresh.
    Versions that stopped being the mart an hour ago are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.table = Versioned(spark, folder, name)

    def refresh(self, fact: DataFrame) -> None:
        self.table.write(star.revenue_by_class(fact), "REFRESH")
        self.table.vacuum(keep_hours=1.0)

    def refresh_games(self, fact: DataFrame, games: DataFrame) -> None:
        """Recompute the games named in games (game_id) and keep the others' rows."""
        if not self.table.exists():
            return self.refresh(fact)
        changed = games.select("game_id").where("game_id IS NOT NULL").distinct()
        others = self.table.read().join(changed, "game_id", "left_anti")
        self.table.write(others.unionByName(star.revenue_by_class(fact.join(changed, "game_id", "left_semi"))), "REFRESH GAMES")
        self.table.vacuum(keep_hours=1.0)
        return None


def record_deploy(spark: SparkSession, table: str, environment: str, revision: str, run_id: str) -> int:
    """Add a row to the deploy log and count the run's rows in it."""
    row = spark.createDataFrame([(run_id, environment, revision)], "run_id string, environment string, git_sha string")
    row.withColumn("deployed_at", F.current_timestamp()).write.mode("append").saveAsTable(table)
    return spark.table(table).where(F.col("run_id") == run_id).count()


def clustered(rows: DataFrame, path: str, keys: Sequence[str], files: int) -> None:
    """Write rows so that a filter on the keys reads few of the files: ranges of the keys, sorted within each."""
    rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def bucketed(rows: DataFrame, name: str, keys: Sequence[str], buckets: int) -> None:
    """Store rows as a table in buckets of the keys: tables bucketed alike join and group on them without a shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
