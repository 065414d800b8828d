import datetime as dt
import io
import json
import logging
from pathlib import Path

import pytest

from millrace.operators import star
from millrace.plans import marts, runlog
from millrace.sources import contracts, landing, settings
from millrace.sources.contracts import Contract, Policy
from millrace.streaming import jobs

CONF = Path(__file__).resolve().parent.parent / "conf"


def test_settings_layers():
    dev, prd = settings.load("dev", CONF, variables={}), settings.load("prd", CONF, variables={})
    assert dev.quality.fail_percent == 25.0 and prd.quality.fail_percent == 5.0 and dev.quality.least_rows == 1
    assert len(dev.sources) == 10 and dev.checkpoint_path("x") != prd.checkpoint_path("x")
    for name, contract in contracts.CONTRACTS.items():
        assert dev.source(name).policy == contract.policy.value and dev.source(name).contract == contract.version
    other = settings.load(None, CONF, {"quality": {"warn_percent": 2.0}}, {"MILLRACE_CATALOG": "c2", "MILLRACE_CONTINUOUS": "Yes"})
    assert other.environment == "dev" and other.catalog == "c2" and other.continuous and other.quality.warn_percent == 2.0
    assert settings.layered({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    for bad in ({"nope": 1}, {"quality": {"warn_percent": 9, "fail_percent": 1}}, {"catalog": "a; drop"}, {"sources": {"pos": {"format": "avro"}}}):
        with pytest.raises(settings.SettingsError):
            settings.load("prd", CONF, bad, {})
    with pytest.raises(settings.SettingsError):
        settings.load("test", CONF, variables={})
    with pytest.raises(settings.SettingsError, match="gate_scans"):
        dev.source("nothing")


def test_run_log():
    out = io.StringIO()
    runlog.configure(stream=io.StringIO())
    logger = runlog.configure(stream=out)
    with runlog.stage(logger, "load", source="pos") as metrics:
        metrics["rows"] = 3
    with pytest.raises(ZeroDivisionError), runlog.stage(logger, "bad"):
        1 / 0
    rows = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["message"] for r in rows] == ["started", "finished", "started", "failed"]
    assert rows[1]["rows"] == 3 and rows[1]["source"] == "pos" and rows[1]["run_id"] == runlog.run_id() and "seconds" in rows[3]
    logging.getLogger("millrace").handlers.clear()


def fact(spark, rows):
    return spark.createDataFrame(rows, "game_id long, seat_class string, collected_revenue_usd double, is_refunded boolean")


def test_mart_four_ways(spark, tmp_path):
    databases = marts.databases(spark)
    assert {"bronze", "silver", "gold", "quarantine", "ops"} <= set(databases)
    rows = [(1, "A", 10.0, False), (1, "A", 0.0, True), (2, "B", 5.0, False)]
    first = fact(spark, rows)
    first.write.mode("overwrite").saveAsTable("gold.fact")
    marts.as_table(spark.table("gold.fact"), "gold.mart")
    marts.as_view(spark, "gold.fact", "gold.mart_view")
    held = marts.Refreshable(spark, str(tmp_path / "mart"), "mart_held")
    held.refresh(first)
    same = lambda name: sorted(map(tuple, spark.table(name).select("game_id", "seat_class", "collected_revenue_usd", "tickets_sold").collect()))
    assert same("gold.mart") == same("gold.mart_view") == same("mart_held") == [(1, "A", 10.0, 1), (2, "B", 5.0, 1)]
    second = fact(spark, [*rows, (2, "C", 7.0, False)])
    held.refresh_games(second, spark.createDataFrame([(2,)], "game_id long"))
    assert same("mart_held") == sorted(map(tuple, star.revenue_by_class(second).collect()))
    assert same("gold.mart") == [(1, "A", 10.0, 1), (2, "B", 5.0, 1)]
    assert marts.record_deploy(spark, "ops.deploy", "dev", "abc", "r1") == 1


def test_stream_routes_every_line_once(spark, tmp_path):
    contract = Contract("t", "1.0.0", ("a",), Policy.RESCUE, "a! STRING\nn INT", refusals=(("a", "NULL_PRIMARY_KEY"),))
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"a":"x","n":1}\n{"n":2}\nbroken\n')
    table, bad, ledger = (str(tmp_path / p) for p in ("table", "bad", "ledger"))
    for name in (None, "2.json", None):
        if name:
            (source / name).write_text('{"a":"y","new":1}\n')
        jobs.ingest(jobs.json_lines(spark, str(source), contract, "dev", 1), contract, table, bad, ledger)
    good = spark.read.parquet(table)
    assert sorted(r["a"] for r in good.collect()) == ["x", "y"] and good.where("_rescued_data IS NOT NULL").count() == 1
    assert set(landing.AUDIT) <= set(good.columns)
    assert [r["_quarantine_reason"] for r in spark.read.parquet(bad).collect()] == ["NULL_PRIMARY_KEY"] * 2


def test_stream_refuses_new_columns(spark, tmp_path):
    contract = Contract("t", "1.0.0", ("a",), Policy.FAIL, "a! STRING")
    spark.createDataFrame([("x", 1)], "a string, extra int").coalesce(1).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="extra"):
        jobs.ingest(jobs.parquet_files(spark, str(tmp_path / "in"), contract, "dev"), contract, str(tmp_path / "t"), str(tmp_path / "b"), str(tmp_path / "c"))


def test_hourly_revenue_stream(spark, tmp_path):
    t = lambda h: dt.datetime(2027, 4, 1) + dt.timedelta(hours=h)
    rows = [("o1", 1, "g", "A", "SALE", 10.0, t(0)), ("o1", 1, "g", "A", "SALE", 10.0, t(0)), ("o2", 2, "g", "A", "REFUND", 4.0, t(0)), ("o3", 3, "g", "A", "SALE", 1.0, t(100))]
    schema = "order_id string, __seq long, game_id string, seat_class string, event_type string, paid_price_usd double, __commit_ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.hourly_revenue(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r["game_id"], r["running_revenue_usd"]) for r in spark.table("hourly").collect()]
    assert got == [("g", 6.0)]  # the last hour is still open
