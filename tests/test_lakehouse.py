import datetime as dt

import pytest

from millrace.operators import changes, checks, star, versions
from millrace.sources import contracts, landing
from millrace.sources.contracts import Contract, ContractError, Policy

D = dt.date


def test_latest_state_follows_the_sequence(spark):
    rows = [("o1", 1, "I", "SALE", dt.datetime(2027, 4, 1)), ("o1", 2, "D", "REFUND", dt.datetime(2027, 3, 20)), ("o2", 5, "I", "SALE", None), ("o2", 6, "U", "TRANSFER", None), ("o2", 6, "U", "TRANSFER", None), ("o3", 7, None, None, None)]
    events = spark.createDataFrame(rows, "order_id string, __seq long, __op string, event_type string, __commit_ts timestamp")
    state = {r["order_id"]: r for r in changes.latest_state(changes.without_repeats(events)).collect()}
    assert state["o1"]["is_refunded"] and state["o1"]["order_status"] == "REFUNDED"
    assert not state["o2"]["is_refunded"] and state["o2"]["order_status"] == "TRANSFERRED"
    assert state["o3"]["is_refunded"] is None and state["o3"]["order_status"] == "ACTIVE"
    assert [r["order_id"] for r in changes.active(changes.latest_state(events)).collect()] == ["o2"]


def snapshots(spark):
    schema = "account_id string, cohort string, email string, day string"
    one = spark.createDataFrame([("a", "x", "1", "2027-01-01"), ("b", "x", "1", "2027-01-01"), ("c", None, "1", "2027-01-01"), ("e", "x||y", "1", "2027-01-01")], schema)
    two = spark.createDataFrame([("a", "y", "1", "2027-02-01"), ("b", "x", "2", "2027-02-01"), ("c", "z", "1", "2027-02-01"), ("d", "x", "1", "2027-02-01")], schema)
    return one, two


def test_merge(spark):
    one, two = snapshots(spark)
    merged = versions.fold([one, two], ["account_id"], ["cohort"], "day")
    rows = sorted((r["account_id"], r["cohort"] or "", r["email"], r["__effective_from"], r["__effective_to"], r["__is_current"]) for r in merged.collect())
    high, first, second = D(9999, 12, 31), D(2027, 1, 1), D(2027, 2, 1)
    assert rows == [
        ("a", "x", "1", first, second, False),
        ("a", "y", "1", second, high, True),
        ("b", "x", "1", first, high, True),
        ("c", "", "1", first, second, False),
        ("c", "z", "1", second, high, True),
        ("d", "x", "1", second, high, True),
        ("e", "x||y", "1", first, high, True),
    ]
    again = versions.merge(merged, two, ["account_id"], ["cohort"], "day")
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.select(*again.columns).collect()))
    assert versions.overlaps(merged, ["account_id"]).count() == 0


def test_as_of_boundaries(spark):
    seats = spark.createDataFrame([("s1", 150, "A", None, None), ("s2", 120, "B", 220, "2027-05-15")], "seat_id string, section int, seat_class string, moved_to int, moved_on string")
    dimension = versions.split_moves(seats, "section", "moved_to", "moved_on", "2027-01-01")
    assert dimension.count() == 3 and versions.current(dimension).count() == 2
    orders = spark.createDataFrame([(1, "s2", D(2027, 5, 14)), (2, "s2", D(2027, 5, 15)), (3, "s1", D(2027, 6, 1)), (4, "ghost", D(2027, 6, 1)), (5, "s1", D(2026, 12, 31))], "o int, seat_id string, on date")
    from pyspark.sql import functions as F

    got = {r["o"]: r["at"] for r in versions.as_of(orders, dimension, "seat_id", F.col("on"), {"section": "at"}).collect()}
    assert got == {1: 120, 2: 220, 3: 150, 4: None, 5: None}


def test_dates(spark):
    rows = {r["date"]: r for r in star.date_dimension(star.dates_between(spark, "2027-04-01", "2027-04-07")).collect()}
    saturday = rows[D(2027, 4, 3)]
    assert len(rows) == 7 and saturday["day_of_week"] == 7 and saturday["day_name"] == "Saturday" and saturday["is_weekend"] and saturday["date_key"] == 20270403


def test_contract_rules():
    good = dict(name="t", version="1.0.0", key=("a",), policy=Policy.IGNORE, columns="a! STRING\nb* DECIMAL(10,2)\nc ARRAY<STRING>")
    made = Contract(**good)
    assert made.required == ["a"] and made.personal == ["b"] and len(made.schema()) == 3
    for change in ({"version": "1"}, {"key": ()}, {"key": ("z",)}, {"columns": "a STRING\na INT"}, {"columns": "a TEXT"}, {"event_time": "z"}, {"columns": ""}):
        with pytest.raises(ContractError):
            Contract(**(good | change))
    with pytest.raises(KeyError, match="gate_scans"):
        contracts.get("nothing")


def test_split_loses_no_row(spark):
    contract = contracts.get("gate_scans")
    now = dt.datetime(2027, 4, 10)
    rows = [("1", "g", "n", now, now), (None, "g", "n", now, now), ("2", None, "n", now, now), ("3", "g", None, now, now), ("4", "g", "n", None, now), ("5", "g", "n", dt.datetime(2027, 4, 1), now)]
    df = spark.createDataFrame(rows, "scan_id string, game_id string, gate string, scan_ts timestamp, arrived timestamp")
    good, bad = landing.split(df, contract, "arrived")
    assert [r["scan_id"] for r in good.collect()] == ["1"]
    assert sorted(r["_quarantine_reason"] for r in bad.collect()) == ["LATENESS_BEYOND_CONTRACT", "NULL_EVENT_TIME", "NULL_GAME_ID", "NULL_GATE", "NULL_PRIMARY_KEY"]
    assert checks.reconcile(df, good, bad).first()["lost"] == 0


def test_rescue(spark):
    contract = Contract("t", "1.0.0", ("a",), Policy.RESCUE, "a! STRING\nn INT")
    lines = spark.createDataFrame([('{"a":"x","n":1}',), ('{"a":"x","n":"many","more":2}',), ("not json",), ('{"a":"y","n":null}',)], "value string")
    got = [tuple(r) for r in landing.rescued(lines, contract).collect()]
    assert got[0] == ("x", 1, None) and got[3] == ("y", None, None)
    assert got[1][:2] == ("x", None) and '"more":2' in got[1][2] and '"n":"many"' in got[1][2]
    assert got[2][:2] == (None, None) and "not json" in got[2][2]


def test_copy_is_idempotent_by_file(spark, tmp_path):
    contract = Contract("t", "1.0.0", ("a",), Policy.ADD, "a! STRING\nn INT")
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.csv").write_text("a,n\nx,1\ny,bad\n")
    paths = (str(source), str(tmp_path / "out"), contract, str(tmp_path / "ledger"))
    assert landing.copy_csv(spark, *paths) == 2 and landing.copy_csv(spark, *paths) == 0
    (source / "2.csv").write_text("a,n\nz,3\n")
    landing.copy_csv(spark, *paths)
    rows = sorted((r["a"], r["n"]) for r in spark.read.parquet(paths[1]).collect())
    assert rows == [("x", 1), ("y", None), ("z", 3)]


def test_new_columns_are_refused(spark, tmp_path):
    contract = Contract("t", "1.0.0", ("a",), Policy.FAIL, "a! STRING")
    spark.createDataFrame([("x", 1)], "a string, extra int").write.parquet(str(tmp_path / "p"))
    with pytest.raises(landing.NewColumns, match="extra"):
        landing.forbid_new_columns(spark, [str(tmp_path / "p")], contract)


def test_checks(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, -1.0)], "k int, v double")
    found = {r["expectation"]: (r["failed"], r["total"]) for r in checks.violations(df, {"positive": "v > 0", "keyed": "k IS NOT NULL"}).collect()}
    assert found == {"positive": (2, 3), "keyed": (0, 3)}
    assert checks.keep(df, {"positive": "v > 0"}).count() == 1
    assert checks.require(df, {"keyed": "k IS NOT NULL"}).count() == 3
    with pytest.raises(Exception, match="positive"):
        checks.require(df, {"positive": "v > 0"}).count()
    assert tuple(checks.uniqueness(df, ["k"]).first()) == (3, 2, 1)
    assert checks.gate(100, 0, 0, 1, 5) == "ok" and checks.gate(98, 2, 0, 1, 5) == "warn"
    for bad in ((90, 10, 0), (0, 0, 0), (100, 0, 1)):
        with pytest.raises(checks.GateError):
            checks.gate(*bad, 1, 5)


def test_registered_queries_run(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
