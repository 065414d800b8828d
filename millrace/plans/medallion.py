"""Landing files to bronze, silver and gold: the job, its gates and its log.

Bronze takes what is new since the last run, into folders that are added to;
refused rows go to quarantine, and all are counted while they are written. The
account dimension takes up the deliveries that are new since its last version;
the rest of silver and gold is computed anew from bronze. Tables are shown as new
versions at once (see versioned), so a run that is cut off leaves the tables of
the run before, and a run that is repeated changes nothing.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import changes, checks, observed, star, versions
from millrace.plans import runlog, statements
from millrace.plans.versioned import Versioned
from millrace.sources import contracts, landing, schemas
from millrace.sources.settings import Settings
from millrace.streaming import jobs

# Fixed value: the day on which seats' first versions begin.
SEASON_START = "2027-01-01"


@dataclass(frozen=True)
class Step:
    """One task of a job: its name, what must have ended before, and what it does (rows by table)."""

    name: str
    needs: tuple[str, ...]
    run: Callable[[], dict[str, int]]


def run_steps(steps: Sequence[Step], logger=None) -> dict:
    """Run steps in the order that their needs ask for, one at a time; {status, steps: {name: rows by table}}.

    A step that fails stops the job: what needs it does not run, and the error is raised.
    """
    logger = logger or runlog.configure()
    done: dict[str, dict[str, int]] = {}
    left = list(steps)
    while left:
        step = next((s for s in left if set(s.needs) <= set(done)), None)
        if step is None:
            raise ValueError(f"steps that wait for one another or for nothing there is: {', '.join(s.name for s in left)}")
        left.remove(step)
        with runlog.stage(logger, step.name) as metrics:
            done[step.name] = step.run()
            metrics.update(done[step.name])
    return {"status": "ok", "run_id": runlog.run_id(), "steps": done}


class Medallion:
    """The job of one environment."""

    # Tables of bronze and quarantine by source.
    STREAMS = {"gate_scans": ("br_gate_scan", "q_gate_scan"), "ticketing_cdc": ("br_ticketing_cdc", "q_ticketing_cdc"), "pos": ("br_pos_line", "q_pos_line")}
    COPIES = {"seat_manifest": "br_seat_manifest", "pricing": "br_price_point", "crm_accounts": "br_account", "deposits": "br_deposit", "schedule": "br_schedule"}

    def __init__(self, spark: SparkSession, settings: Settings, warehouse: str | None = None):
        self.spark, self.settings = spark, settings
        self.root = (warehouse or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")

    def folder(self, layer: str, name: str) -> str:
        return f"{self.root}/{self.settings.database(layer)}.db/{name}"

    def read(self, layer: str, name: str) -> DataFrame:
        """A table as it is now."""
        return self.spark.table(self.settings.table(layer, name))

    def stream(self, name: str) -> DataFrame:
        """A bronze table as a stream: rows that were there, then those that are added."""
        folder = self.folder("bronze", name)
        return self.spark.readStream.schema(self.spark.read.parquet(folder).schema).parquet(folder)

    def publish(self, layer: str, name: str, rows: DataFrame) -> int:
        """Make rows the table's next version; how many there are."""
        table = Versioned(self.spark, self.folder(layer, name), self.settings.table(layer, name))
        table.write(rows, "REFRESH")
        return table.entries()[-1]["rows"]

    def _show(self, layer: str, name: str) -> None:
        """Show a bronze folder to SQL."""
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.settings.table(layer, name)} AS SELECT * FROM parquet.`{self.folder(layer, name)}`")

    def _gate(self, source: str, accepted: int, refused: int, null_keys: int = 0) -> str:
        q = self.settings.quality
        return checks.gate(accepted, refused, null_keys, q.warn_percent, q.fail_percent, q.least_rows, q.null_key_percent)

    def bronze_stream(self, source: str) -> dict[str, int]:
        """Take a source's new files; the gate is held against all that has been taken."""
        told, contract = self.settings.source(source), contracts.get(source)
        good, bad = self.STREAMS[source]
        path, environment = self.settings.landing_path(source), self.settings.environment
        schemas.remember(self.spark, self.settings.schema_path(good), contract)
        if told.format == "json":
            rows = jobs.json_lines(self.spark, path, contract, environment, told.max_files)
        else:
            rows = jobs.parquet_files(self.spark, path, contract, environment)
        jobs.ingest(rows, contract, self.folder("bronze", good), self.folder("quarantine", bad), self.settings.checkpoint_path(good), self.alerts(source))
        self._show("bronze", good)
        self._show("quarantine", bad)
        counts = jobs.told(self.spark, self.folder("bronze", good))
        self._gate(source, counts["accepted"], counts["refused"], counts["null_keys"])
        return {good: counts["accepted"], bad: counts["refused"]}

    def alerts(self, source: str) -> observed.Alerts:
        """What logs each batch of a source with more refused rows than the thresholds allow."""
        q = self.settings.quality
        level = {"warn": logging.WARNING, "fail": logging.ERROR}
        return observed.Alerts(source, q.warn_percent, q.fail_percent, lambda kind, text, figures: logging.getLogger("millrace").log(level[kind], text, extra={"stage": f"bronze {source}", **figures}))

    def bronze_copy(self, source: str) -> dict[str, int]:
        """Load a source's new CSV or JSON files once; rows that break the contract are refused."""
        name, contract = self.COPIES[source], contracts.get(source)
        raw, ledger = f"{self.folder('bronze', name)}_raw", self.settings.checkpoint_path(name)
        schemas.remember(self.spark, self.settings.schema_path(name), contract)
        if self.settings.source(source).format == "json":
            landed = jobs.json_lines(self.spark, self.settings.landing_path(source), contract, self.settings.environment)
            jobs.ingest(landed, contract, raw, f"{raw}_refused", ledger)
        else:
            landing.copy_csv(self.spark, self.settings.landing_path(source), raw, contract, ledger)
        rows = self.spark.read.option("mergeSchema", True).parquet(raw).drop("batch")
        good, bad = landing.split(rows, contract)
        out = {name: self.publish("bronze", name, good), f"q_{name[3:]}": self.publish("quarantine", f"q_{name[3:]}", bad)}
        self._gate(source, *out.values())
        return out

    def silver(self) -> dict[str, int]:
        """Orders in their current state, seats and accounts as versions, admissions, baskets and price windows."""
        audit = (*landing.AUDIT, "batch", "_rescued_data")
        events = checks.require(self.read("bronze", "br_ticketing_cdc"), {"a change has a sequence": "__seq IS NOT NULL"}).drop(*audit)
        orders = checks.keep(changes.latest_state(events), {"an order has an id": "order_id IS NOT NULL"})
        manifest = star.latest_by_key(self.read("bronze", "br_seat_manifest"), ["seat_id"], "_ingest_ts").drop(*audit)
        seats = versions.split_moves(manifest, "section", "renumbered_to_section", "renumber_effective_date", SEASON_START)
        out = {"sv_ticket_order": self.publish("silver", "sv_ticket_order", orders)}
        out["dim_seat"] = self.publish("silver", "dim_seat", checks.keep(seats, {"a seat has an id": "seat_id IS NOT NULL"}))
        out["dim_account"] = self.accounts(audit)
        scans = self.read("bronze", "br_gate_scan").drop(*audit).dropDuplicates(["scan_id"])
        known = self.read("silver", "sv_ticket_order").select("order_id", F.lit(True).alias("_known"))
        told = scans.join(known, "order_id", "left")
        out["sv_admission"] = self.publish("silver", "sv_admission", told.where("_known").drop("_known"))
        out["q_admission"] = self.publish("quarantine", "q_admission", told.where("_known IS NULL").drop("_known").withColumn("_quarantine_reason", F.lit("UNKNOWN_ORDER")))
        out["sv_pos_basket"] = self.publish("silver", "sv_pos_basket", star.baskets(self.read("bronze", "br_pos_line")))
        points = star.latest_by_key(self.read("bronze", "br_price_point"), ["price_point_id"], "_ingest_ts").drop(*audit)
        out["sv_price_point"] = self.publish("silver", "sv_price_point", versions.resolve_windows(points, ["game_id", "seat_class"], "valid_from_ts", "valid_to_ts"))
        return out

    def accounts(self, audit: Sequence[str]) -> int:
        """Bring the account dimension up to what was delivered since its last version; its rows.

        The mark, the latest arrival that the dimension has taken up, is written
        after it: a run that was cut off between them applies deliveries again,
        which changes nothing. Deliveries without a date are in no version.
        """
        name, seen = "dim_account", Versioned(self.spark, self.folder("ops", "dim_account_mark"))
        delivered = self.read("bronze", "br_account").where("snapshot_date IS NOT NULL AND account_id IS NOT NULL")
        if seen.exists():
            delivered = delivered.where(F.col("_ingest_ts") > F.lit(seen.read().first()["taken"]))
        stored = self.read("silver", name) if Versioned(self.spark, self.folder("silver", name)).exists() else None
        mark = delivered.agg(F.max("_ingest_ts").alias("taken")).first()["taken"]
        if stored is not None and mark is None:
            return Versioned(self.spark, self.folder("silver", name)).entries()[-1]["rows"]
        once = star.latest_by_key(delivered, ["account_id", "snapshot_date"], "_ingest_ts").drop(*audit)
        rows = self.publish("silver", name, versions.advance(stored, once, ["account_id"], ["cohort", "origin_state", "is_active"], "snapshot_date"))
        if mark is not None:
            seen.write(self.spark.createDataFrame([(mark,)], "taken timestamp"), "MARK")
        return rows

    def gold(self) -> dict[str, int]:
        """The order fact, marts, dimensions and the season's ratios."""
        now = lambda name: self.read("silver", name)
        out = {"fact_ticket_order": self.publish("gold", "fact_ticket_order", star.order_fact(now("sv_ticket_order"), now("dim_seat"), now("dim_account")))}
        fact, admitted = self.read("gold", "fact_ticket_order"), now("sv_admission")
        if fact.count() != now("sv_ticket_order").count():
            raise checks.GateError("the order fact has not one row for each order")
        games = star.latest_by_key(self.read("bronze", "br_schedule").drop("batch", "_rescued_data"), ["game_id"], "_ingest_ts").drop(*landing.AUDIT)
        lines = star.latest_by_key(self.read("bronze", "br_pos_line").drop("batch", "_rescued_data"), ["txn_line_id"], "_ingest_ts")
        pnl = star.game_pnl(fact)
        made = {
            "fact_game_pnl": pnl,
            "mart_revenue_by_seat_class": star.revenue_by_class(fact),
            "dim_date": star.date_dimension(star.dates_between(self.spark, "2026-01-01", "2027-12-31")),
            "dim_game": games,
            "dim_product": versions.advance(None, lines.where("sku IS NOT NULL AND txn_ts IS NOT NULL").select("sku", "item_name", "category", "unit_price_usd", "txn_ts"), ["sku"], ["item_name", "category", "unit_price_usd"], "txn_ts"),
            "dim_promo": games.groupBy("promotion").agg(F.max("promotion_lift").alias("promotion_lift"), F.count(F.lit(1)).alias("games")),
            "fact_admission": admitted,
            "fact_pos_transaction": now("sv_pos_basket"),
            "fact_ticket_event": changes.transitions(changes.without_repeats(self.read("bronze", "br_ticketing_cdc"))).select("order_id", "__seq", "event_type", "previous_event", "hours_since"),
            "fact_price_point": now("sv_price_point"),
            "fact_deposit_conversion": star.deposit_funnel(self.read("bronze", "br_deposit")),
            "metric_sell_through": star.sell_through(fact, now("dim_seat")),
            "metric_no_show": star.no_show(fact, admitted),
            "metric_per_cap": star.per_cap(lines, admitted),
            "metric_price_realization": star.price_realization(fact),
            "metric_novelty": star.novelty(pnl.join(games.select("game_id", "novelty_index"), "game_id")),
            "metric_account_health": star.account_health(fact),
        }
        return out | {name: self.publish("gold", name, rows) for name, rows in made.items()}

    def steps(self) -> list[Step]:
        """The job's tasks: databases, each source, silver, gold."""
        first = [Step("databases", (), lambda: {"databases": len(statements.databases(self.spark, self.settings))})]
        take = [Step(f"bronze {s}", ("databases",), lambda s=s: self.bronze_stream(s)) for s in self.STREAMS]
        take += [Step(f"bronze {s}", ("databases",), lambda s=s: self.bronze_copy(s)) for s in self.COPIES]
        return [*first, *take, Step("silver", tuple(s.name for s in take), self.silver), Step("gold", ("silver",), self.gold)]

    def run(self, logger=None) -> dict:
        """All tasks in order; see run_steps."""
        return run_steps(self.steps(), logger)
