import io
import json
import logging
from pathlib import Path

import pytest

from millrace.operators import checks
from millrace.plans import medallion, runlog
from millrace.sources import contracts, settings
from season import Defects, Season, land

CONF = Path(__file__).resolve().parent.parent / "conf"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("season")
    made = Season("tiny", 7, Defects(scan_malformed=0.01, scan_without_ticket=0.03, pos_malformed=0.02, pos_batch_twice=0.1, account_minor=0.1, window_overlap=0.3, cdc_duplicate=0.05, cdc_backdated=0.2))
    told = land(spark, str(top / "landing"), made)
    conf = settings.load("dev", CONF, {"landing": str(top / "landing"), "checkpoints": str(top / "checkpoints"), "catalog": "tiny_dev"}, {})
    job = medallion.Medallion(spark, conf, str(top / "warehouse"))
    out = io.StringIO()
    found = job.run(runlog.configure(stream=out))
    logging.getLogger("millrace").handlers.clear()
    return job, told, found, out.getvalue()


def test_files_to_marts_twice(spark, world):
    job, told, found, log = world
    rows = {k: v for step in found["steps"].values() for k, v in step.items()}
    assert found["status"] == "ok" and rows["fact_ticket_order"] == rows["sv_ticket_order"] > 300 and rows["dim_date"] == 730
    assert [json.loads(x)["message"] for x in log.splitlines()].count("finished") == len(job.steps())
    tables = ("fact_ticket_order", "fact_game_pnl", "mart_revenue_by_seat_class", "metric_no_show", "dim_game", "fact_admission")
    before = {t: sorted(map(str, job.read("gold", t).collect())) for t in tables}
    again = job.run(logging.getLogger("quiet"))
    assert {k: v for step in again["steps"].values() for k, v in step.items()} == rows
    assert {t: sorted(map(str, job.read("gold", t).collect())) for t in tables} == before
    assert json.loads(Path(job.settings.landing, "_manifest.json").read_text()) == told


def test_planted_defects_are_found(spark, world):
    job, told, found, _ = world
    rows, planted, landed = {k: v for step in found["steps"].values() for k, v in step.items()}, told["planted"], told["row_counts"]
    assert all(n > 0 for n in planted.values()), planted
    assert rows["br_gate_scan"] + rows["q_gate_scan"] == landed["gate_scans"] and rows["q_gate_scan"] == planted["malformed scans"]
    assert rows["br_pos_line"] + rows["q_pos_line"] == landed["pos"]
    twice = job.read("bronze", "br_pos_line").groupBy("txn_line_id").count()
    assert twice.where("count > 1").count() == planted["lines sent twice"]
    assert job.read("bronze", "br_pos_line").dropDuplicates(["txn_line_id"]).where("tax_rate = 0").count() == planted["untaxed lines"]
    events = job.read("bronze", "br_ticketing_cdc")
    assert checks.uniqueness(events, ["order_id", "__seq"]).first()["repeated"] == planted["repeated changes"]
    backdated = events.dropDuplicates(["order_id", "__seq"]).where("event_type IN ('REFUND', 'TRANSFER') AND __commit_ts < purchased_ts").count()
    assert backdated == planted["backdated changes"]
    refunded = events.where("__op = 'D'").select("order_id").distinct().count()
    assert job.read("silver", "sv_ticket_order").where("is_refunded").count() == refunded > 0
    assert job.read("silver", "dim_seat").where("NOT __is_current").count() == planted["renumbered seats"]
    assert rows["q_admission"] == planted["scans without a ticket"]
    minors = job.read("bronze", "br_account").where("add_months(birth_date, 216) > date'2027-01-01'").count()
    assert minors == planted["minor accounts"]
    assert checks.protected(job.read("bronze", "br_account"), contracts.get("crm_accounts"), "s", on="2027-01-01").count() == rows["br_account"] - minors
    assert job.read("bronze", "br_account").where("email IS NULL").count() == planted["accounts without contact"]
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    after = F.lead("valid_from_ts").over(Window.partitionBy("game_id", "seat_class").orderBy("valid_from_ts"))
    assert job.read("bronze", "br_price_point").withColumn("next", after).where("valid_to_ts > next").count() == planted["overlapping price windows"]
    assert job.read("gold", "fact_price_point").withColumn("next", after).where("valid_to_ts > next").count() == 0
    texts = spark.read.parquet(f"{job.settings.landing}/guest_services")
    assert texts.where("issue_text RLIKE '[a-z0-9]+@example.com'").count() == planted["personal data in guest texts"]
    assert job.read("bronze", "br_gate_scan").where("scan_device_os IS NOT NULL").select("game_id").distinct().count() == 2


def test_a_gate_stops_the_job(spark, world):
    job = world[0]
    strict = medallion.Medallion(spark, settings.load("prd", CONF, {"landing": job.settings.landing, "checkpoints": job.settings.checkpoints, "catalog": "tiny_dev", "quality": {"warn_percent": 0.0, "fail_percent": 0.0}}, {}), job.root)
    with pytest.raises(checks.GateError):
        strict._gate("pos", 99, 1)
    ran = []
    steps = [medallion.Step("b", ("a",), lambda: ran.append("b") or {}), medallion.Step("a", (), lambda: ran.append("a") or {})]
    assert medallion.run_steps(steps, logging.getLogger("quiet"))["status"] == "ok" and ran == ["a", "b"]
    with pytest.raises(ValueError, match="wait"):
        medallion.run_steps([medallion.Step("a", ("b",), dict)], logging.getLogger("quiet"))


def test_bronze_is_a_stream_too(spark, world, tmp_path):
    job = world[0]
    rows = job.stream("br_ticketing_cdc").select("order_id", "__seq")
    query = rows.writeStream.format("memory").queryName("of_bronze").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("of_bronze").count() == job.read("bronze", "br_ticketing_cdc").count()
