import datetime as dt
import json
import logging
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes, checks, star, texts, versions
from millrace.plans import marts, runlog, statements
from millrace.plans.versioned import Conflict, Versioned
from millrace.sources import contracts, files, landing, settings
from millrace.sources.contracts import Contract, Policy
from millrace.streaming import jobs

CONF = Path(__file__).resolve().parent.parent / "conf"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_versions_of_a_table(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS held")
    table = Versioned(spark, str(tmp_path / "t"), "held.prices")
    assert not table.exists()
    assert table.write(spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, v double")) == 0
    before = table.entries()[-1]["time"]
    assert table.update({"v": F.col("v") * 2}, F.col("k") == 1) == 1
    assert table.append(spark.createDataFrame([(3, 7.0, "new")], "k int, v double, w string")) == 2
    assert rows_of(spark.table("held.prices").select("k", "v")) == [(1, 10.0), (2, 6.0), (3, 7.0)]
    assert rows_of(table.read(version=0)) == [(1, 5.0), (2, 6.0)] == rows_of(table.read(at=before))
    changes_ = spark.createDataFrame([(1, None, None, 5, "D"), (2, 9.0, "x", 6, "U"), (2, 8.0, "x", 4, "U"), (4, 1.0, "y", 7, "I")], "k int, v double, w string, __seq int, __op string")
    table.merge(changes_, ["k"], "__seq")
    merged = [(2, 9.0, "x"), (3, 7.0, "new"), (4, 1.0, "y")]
    assert rows_of(table.read()) == merged
    table.merge(changes_, ["k"], "__seq")
    assert rows_of(table.read()) == merged
    table.delete(F.col("k") == 3)
    told = table.history().collect()
    assert [r["operation"] for r in told] == ["DELETE", "MERGE", "MERGE", "APPEND", "UPDATE", "WRITE"] and [r["rows"] for r in told] == [2, 3, 3, 3, 2, 2]
    assert table.detail()["version"] == 5 and table.detail()["bytes"] > 0
    assert table.vacuum(keep_hours=1.0) == [] and table.vacuum(keep_hours=0.0) == [0, 1, 2, 3, 4]
    assert rows_of(spark.table("held.prices").select("k")) == [(2,), (4,)]
    with pytest.raises(LookupError):
        table.read(version=0)
    with pytest.raises(LookupError):
        table.read(at="2001-01-01T00:00:00")


def test_two_writers_of_one_version(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "t"))
    table.write(spark.range(1))
    files.write_new(spark, f"{table.folder}/log/00000001.json", "{}")
    table.entries = lambda: [{"version": 0}]
    with pytest.raises(Conflict):
        table.write(spark.range(2))


def test_statements(spark, tmp_path):
    conf = settings.load("dev", CONF, {"catalog": "sql_dev"}, {})
    assert statements.run(spark, "SELECT :a + 1 AS n, 'x' AS t", {"a": 2}) == {"columns": ["n", "t"], "rows": [[3, "x"]], "row_count": 1}
    with pytest.raises(ValueError, match="more than"):
        statements.run(spark, "SELECT * FROM range(5)", most=4)
    assert {conf.database(x) for x in settings.LAYERS} <= set(statements.databases(spark, conf, {"team": "ops"}))
    assert statements.tags(spark, "sql_dev_gold") == {"environment": "dev", "layer": "gold", "team": "ops"}
    assert statements.session(spark).first()["environment"] == "dev"
    smoke = statements.smoke(spark, conf, "r1", "abc")
    assert smoke["status"] == "ok" and smoke["rows"] == 1 and statements.smoke(spark, conf, "r2", "abc")["rows"] == 1
    contract = contracts.get("pricing")
    statements.create_table(spark, "sql_dev_bronze.price", contract, properties={"layer": "bronze"})
    statements.create_table(spark, "sql_dev_bronze.price", contract)
    assert spark.table("sql_dev_bronze.price").columns == contract.names
    told = {r[0]: r[2] for r in spark.sql("DESCRIBE TABLE sql_dev_bronze.price").collect()}
    assert told["price_point_id"] == "key, must be present" and "contract_version" in str(spark.sql("SHOW TBLPROPERTIES sql_dev_bronze.price").collect())
    t = dt.datetime(2027, 4, 1)
    row = ("p1", "g1", "A", 1.0, 2.0, t, t, "r")
    statements.insert(spark, "sql_dev_bronze.price", spark.createDataFrame([row], contract.schema()), contract)
    with pytest.raises(Exception, match="price_point_id is present"):
        statements.insert(spark, "sql_dev_bronze.price", spark.createDataFrame([(None, *row[1:])], spark.table("sql_dev_bronze.price").schema), contract)
    statements.values(spark, "sql_dev_bronze.price", [("p2", *row[1:])])
    assert spark.table("sql_dev_bronze.price").count() == 2
    outside = str(tmp_path / "outside")
    statements.create_table(spark, "sql_dev_bronze.far", contracts.get("deposits"), location=outside)
    statements.values(spark, "sql_dev_bronze.far", [("d", "a", 1.0, t, 1, "w", t, True, "FULL", 2, False, t)])
    found = {r["name"]: r["is_external"] for r in statements.tables(spark, "sql_dev_bronze").collect()}
    assert found == {"far": True, "price": False}
    assert [r["name"] for r in statements.tables(spark, "sql_dev_bronze", "p%", "^pr").collect()] == ["price"]
    spark.sql("DROP TABLE sql_dev_bronze.far")
    assert files.names(spark, outside)  # an external table leaves its files
    spark.sql("DROP TABLE sql_dev_bronze.price")
    spark.createDataFrame([(i,) for i in range(30)], "n int").write.json(str(tmp_path / "j"))
    assert statements.peek(spark, str(tmp_path / "j")).count() == 20
    assert statements.conf(spark, "millrace.nothing", "x") == "x"


def test_policies_on_columns_beyond_the_contract(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.csv").write_text("n,a\n1,x\n")
    (source / "2.csv").write_text("a,extra,n\ny,more,2\n")
    got = {}
    for policy in (Policy.ADD, Policy.IGNORE, Policy.RESCUE, Policy.FAIL):
        contract = Contract("t", "1.0.0", ("a",), policy, "a! STRING\nn INT")
        paths = (str(source), str(tmp_path / policy.name), contract, str(tmp_path / f"ledger-{policy.name}"))
        if policy is Policy.FAIL:
            with pytest.raises(Exception, match="extra"):
                landing.copy_csv(spark, *paths)
            assert not (tmp_path / policy.name).exists()
            continue
        assert landing.copy_csv(spark, *paths) == 2
        got[policy] = spark.read.parquet(paths[1])
    assert rows_of(got[Policy.ADD].select("a", "n", F.coalesce("extra", F.lit("-")))) == [("x", 1, "-"), ("y", 2, "more")]
    assert "extra" not in got[Policy.IGNORE].columns and rows_of(got[Policy.IGNORE].select("a", "n")) == [("x", 1), ("y", 2)]
    assert rows_of(got[Policy.RESCUE].select("a", F.coalesce("_rescued_data", F.lit("-")))) == [("x", "-"), ("y", '{"extra":"more"}')]


def test_a_new_ledger_loses_nothing(spark, tmp_path):
    contract = Contract("t", "1.0.0", ("a",), Policy.RESCUE, "a! STRING")
    for name in "xy":
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text(f'{{"a":"{name}"}}\n')
        jobs.ingest(jobs.json_lines(spark, str(tmp_path / name), contract, "dev"), contract, str(tmp_path / "t"), str(tmp_path / "b"), str(tmp_path / f"ledger {name}"))
    assert sorted(r["a"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["x", "y"]


def test_absent_required_columns_refuse_all(spark):
    for name, missing in (("crm_accounts", "account_id"), ("pos", "txn_id")):
        contract = contracts.get(name)
        kept = [f for f in contract.schema() if f.name != missing]
        df = spark.createDataFrame([tuple(None for _ in kept)] * 2, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept))
        good, bad = landing.split(df, contract)
        assert good.count() == 0 and [r["_quarantine_reason"] for r in bad.collect()] == [f"ABSENT_COLUMN_{missing.upper()}"] * 2


def test_reasons_of_sale_lines(spark):
    contract = contracts.get("pos")
    good = {f.name: (dt.datetime(2027, 4, 1) if f.name == "txn_ts" else 1 if f.dataType.simpleString() == "int" else 1.0 if f.dataType.simpleString() == "double" else "x") for f in contract.schema()}
    rows = [good, *({**good, c: None} for c in ("txn_line_id", "txn_id", "sku", "txn_ts", "game_id", "terminal_id", "item_name"))]
    df = spark.createDataFrame([tuple(r[c] for c in contract.names) for r in rows], contract.ddl().replace(" NOT NULL", ""))
    fine, bad = landing.split(df, contract)
    assert fine.count() == 2
    assert sorted(r["_quarantine_reason"] for r in bad.collect()) == ["CONTRACT_VIOLATION", "CONTRACT_VIOLATION", "NULL_BASKET_ID", "NULL_EVENT_TIME", "NULL_PRIMARY_KEY", "NULL_SKU"]
    assert tuple(checks.reconcile_split(df, contract).first()) == (8, 2, 6, 0)
    assert "txn_line_id STRING NOT NULL" in contract.ddl() and "item_name STRING," in contract.ddl()


def test_merge_of_odd_snapshots(spark):
    schema = "k string, cohort string, day string"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    first = versions.merge(None, make(("a", "x", "2027-02-01"), (None, "n", "2027-02-01"), ("b", "x", "2027-02-01"), ("b", "y", "2027-02-01")), ["k"], ["cohort"], "day")
    assert first.where("k = 'b'").count() == 1 and first.where("k = 'b'").first()["cohort"] == "y"
    same = versions.merge(first, make((None, "n", "2027-03-01")), ["k"], ["cohort"], "day")
    assert same.count() == 3 and same.where("k IS NULL").first()["__effective_from"] == dt.date(2027, 2, 1)
    back = versions.merge(first, make(("a", "z", "2027-01-01")), ["k"], ["cohort"], "day")
    assert back.where("k = 'a'").first()["cohort"] == "x" and back.count() == 3
    corrected = versions.merge(first, make(("a", "z", "2027-02-01")), ["k"], ["cohort"], "day")
    assert [r["cohort"] for r in corrected.where("k = 'a'").collect()] == ["z"]
    assert versions.overlaps(corrected, ["k"]).count() == 0


def test_equal_sequences_have_one_answer(spark):
    rows = [("o", 2, "U", e, dt.datetime(2027, 4, 1)) for e in ("TRANSFER", "RESALE")]
    schema = "order_id string, __seq long, __op string, event_type string, __commit_ts timestamp"
    got = {changes.latest_state(spark.createDataFrame(r, schema)).first()["event_type"] for r in (rows, rows[::-1])}
    assert got == {"TRANSFER"}


def test_settings_scope_names():
    dev, prd = settings.load("dev", CONF, variables={}), settings.load("prd", CONF, variables={})
    assert dev.table("gold", "mart") == "ballpark_dev_gold.mart" and prd.table("gold", "mart") != dev.table("gold", "mart")
    assert dev.landing != prd.landing and not prd.landing.startswith("/tmp") and dev.schema_path("x") != dev.checkpoint_path("x")
    for bad in ({"sources": {"pos": {"path": "/etc"}}}, {"sources": {"pos": {"path": "../x"}}}, {"sources": {"pos": {"colour": 1}}}, {"quality": 3}):
        with pytest.raises(settings.SettingsError):
            settings.load("dev", CONF, bad, {})
    for call in (lambda: dev.table("tin", "x"), lambda: dev.table("gold", "x; y"), lambda: dev.checkpoint_path("a/../b")):
        with pytest.raises(settings.SettingsError):
            call()
    assert [n for n, s in prd.sources.items() if s.streaming] == ["gate_scans", "ticketing_cdc", "pos"]
    for name in prd.sources:
        assert contracts.get(name).policy.value == prd.sources[name].policy


def test_texts(spark):
    df = spark.createDataFrame([("c", "The Club shall provide 12 suite tickets per season. Nothing. Sponsor may hold 3 events."), ("d", None)], "contract_id string, contract_text string")
    assert rows_of(texts.clauses(df)) == [("c", 3, "events"), ("c", 12, "suite tickets per season")]
    said = spark.createDataFrame([("call (555) 123-4567 or a.b@c.example now",)], "t string").select(texts.redacted(F.col("t"))).first()[0]
    assert said == "call [PHONE] or [EMAIL] now"
    near = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(texts.cosine(F.col("a"), F.col("b"))).collect()
    assert abs(near[0][0] - 0.5**0.5) < 1e-12 and near[1][0] is None


def test_layouts(spark, tmp_path):
    rows = spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("k"), "id")
    marts.clustered(rows, str(tmp_path / "c"), ["k"], 8)
    spans = spark.read.parquet(str(tmp_path / "c")).groupBy(F.input_file_name()).agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("a").collect()
    assert len(spans) == 8 and all(x["b"] < y["a"] for x, y in zip(spans, spans[1:], strict=False))
    spark.sql("CREATE DATABASE IF NOT EXISTS held")
    for name in ("held.one", "held.two"):
        marts.bucketed(rows, name, ["k"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = spark.table("held.one").join(spark.table("held.two"), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan


def test_streams_of_scans_and_sales(spark, tmp_path):
    t = lambda m: dt.datetime(2027, 4, 1, 18) + dt.timedelta(minutes=m)
    scans = [("s1", "g", "o1", "n", t(0)), ("s1", "g", "o1", "n", t(0)), ("s2", "h", "o9", "n", t(5))]
    sales = [("l1", "g", t(30)), ("l2", "g", t(200)), ("l3", "h", t(1))]
    schemas = {"scans": "scan_id string, game_id string, order_id string, gate string, scan_ts timestamp", "sales": "txn_line_id string, game_id string, txn_ts timestamp"}
    for name, rows in (("scans", scans), ("sales", sales)):
        spark.createDataFrame(rows, schemas[name]).coalesce(1).write.parquet(str(tmp_path / name))
    stream = lambda name: spark.readStream.schema(schemas[name]).parquet(str(tmp_path / name))

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    once = run(jobs.admissions(stream("scans"), spark.createDataFrame([("o1",)], "order_id string")), "admitted")
    assert rows_of(once.select("scan_id", "has_order")) == [("s1", True), ("s2", False)]
    assert set(rows_of(run(jobs.matched(stream("scans"), stream("sales")), "met").select("scan_id", "txn_line_id"))) == {("s1", "l1")}


def test_states_are_no_stream_of_changes(spark):
    with pytest.raises(ValueError, match="changes"):
        jobs.hourly_revenue(spark.createDataFrame([], "order_id string, __seq long, is_refunded boolean, __commit_ts timestamp"))


def test_run_logs_as_a_table(spark, tmp_path):
    path = tmp_path / "run.log"
    with path.open("w") as out:
        logger = runlog.configure(stream=out)
        for _ in range(2):
            with runlog.stage(logger, "load"):
                pass
        with pytest.raises(ZeroDivisionError), runlog.stage(logger, "break"):
            1 / 0
    logging.getLogger("millrace").handlers.clear()
    assert {r["stage"]: (r["runs"], r["failures"]) for r in runlog.stages(spark, str(path)).collect()} == {"load": (2, 0), "break": (1, 1)}
    assert json.loads(path.read_text().splitlines()[0])["message"] == "started"


def test_ranks_and_freshness(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    rows = spark.createDataFrame([("d1", t(9)), ("d2", t(2)), ("d3", t(9)), ("d4", None), ("d5", t(1))], "deposit_id string, placed_ts timestamp")
    assert {r["deposit_id"]: r["priority_rank"] for r in star.priority_ranks(rows).collect()} == {"d5": 1, "d2": 2, "d1": 3, "d3": 4, "d4": 5}
    assert not checks.stale(rows, "placed_ts", "2026-01-09 01:00:00", 120).first()["is_stale"]
    assert checks.stale(rows.limit(0), "placed_ts", "2026-01-09 01:00:00", 120).first()["is_stale"]
    protected = checks.protected(spark.createDataFrame([("a", "Ann", dt.date(2000, 1, 1)), ("b", "Bo", dt.date(2015, 1, 1)), ("c", "Cy", None)], "account_id string, first_name string, birth_date date"), contracts.get("crm_accounts"), "s", on="2027-01-01").collect()
    assert [(r["account_id"], r["birth_date"], len(r["first_name"])) for r in protected] == [("a", "2000", 64)]
