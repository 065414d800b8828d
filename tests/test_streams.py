import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import observed, versions
from millrace.plans import increments  # noqa: F401
from millrace.sources import files
from millrace.sources.contracts import Contract, Policy
from millrace.streaming import jobs, tables

T0 = dt.datetime(2027, 4, 1)
CHANGES = "order_id long, __seq long, event_type string, paid_price_usd double, __commit_ts timestamp, game_id long, seat_class string"
LINES = Contract("t", "1.0.0", ("a",), Policy.RESCUE, "a! STRING\nn INT", refusals=(("a", "NULL_PRIMARY_KEY"),))


def hour(h):
    return T0 + dt.timedelta(hours=h)


def put(spark, rows, schema, folder, name):
    """One Parquet file of a name, as a writer outside Spark lays it down."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f".{name}"))
    part = next((folder / f".{name}").glob("part-*.parquet"))
    os.rename(part, folder / f"{name}.parquet")


def test_both_forms_agree_over_several_files_and_runs(spark, tmp_path):
    got = {}
    for form, plan in (("py", tables.revenue), ("sql", tables.revenue_sql)):
        folder = tmp_path / form
        folder.mkdir()
        put(spark, [(1, 1, "SALE", 10.0, hour(0), 1, "A"), (2, 2, "REFUND", 4.0, hour(0), 1, "A"), (3, 3, "VIEW", 9.0, hour(1), 1, "B")], CHANGES, folder, "one")
        put(spark, [(4, 4, "SALE", 1.0, hour(30), 1, "A")], CHANGES, folder, "two")
        stream = lambda: plan(spark.readStream.schema(CHANGES).parquet(str(folder)))  # noqa: B023, E731
        first = tables.drained(stream(), "r", str(tmp_path / f"{form}-run"))
        assert first.count() == 0  # the watermark has passed no hour
        put(spark, [(5, 5, "SALE", 2.0, hour(100), 1, "A")], CHANGES, folder, "three")
        tables.drained(stream(), "r", str(tmp_path / f"{form}-run"))
        put(spark, [(6, 6, "SALE", 50.0, hour(0), 1, "A"), (7, 7, "SALE", 3.0, hour(200), 1, "A")], CHANGES, folder, "four")  # the first is too late
        got[form] = sorted(tuple(r) for r in tables.drained(stream(), "r", str(tmp_path / f"{form}-run")).collect())
    assert got["py"] == got["sql"] == [(1, "A", hour(0), 6.0), (1, "A", hour(30), 1.0), (1, "A", hour(100), 2.0), (1, "B", hour(1), 0.0)]


def test_a_failure_between_write_and_commit_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text(f'{{"a":"x{k}","n":1}}\n{{"n":2}}\n')
    table, bad, ledger = (str(tmp_path / p) for p in ("table", "bad", "ledger"))
    run = lambda: jobs.ingest(jobs.json_lines(spark, str(source), LINES, "dev", 1), LINES, table, bad, ledger)
    real, calls = files.write_new, []

    def failing(*given):
        calls.append(given)
        if len(calls) == 2:
            raise OSError("the store is gone")
        return real(*given)

    monkeypatch.setattr(files, "write_new", failing)
    with pytest.raises(Exception, match="the store is gone"):
        run()
    assert spark.read.parquet(table).count() == 2  # written, not committed
    monkeypatch.setattr(files, "write_new", real)
    run()
    assert sorted(r["a"] for r in spark.read.parquet(table).collect()) == ["x0", "x1", "x2"]
    assert spark.read.parquet(bad).count() == 3
    assert jobs.told(spark, table) == {"accepted": 3, "refused": 3, "null_keys": 0} and jobs.told(spark, str(tmp_path / "none"))["accepted"] == 0


def test_a_join_of_streams_goes_on_from_its_state(spark, tmp_path):
    scans, sales = tmp_path / "scans", tmp_path / "sales"
    one, two = "scan_id string, game_id long, scan_ts timestamp", "txn_line_id string, game_id long, txn_ts timestamp"
    for folder in (scans, sales):
        folder.mkdir()
    put(spark, [("s1", 1, hour(0)), ("s2", 2, hour(0))], one, scans, "a")
    put(spark, [("t0", 9, hour(0))], two, sales, "a")
    plan = lambda: jobs.matched(spark.readStream.schema(one).parquet(str(scans)), spark.readStream.schema(two).parquet(str(sales)))
    assert tables.drained(plan(), "m", str(tmp_path / "run")).count() == 0
    put(spark, [("t1", 1, hour(1)), ("t2", 2, hour(3))], two, sales, "b")  # the second is beyond two hours
    got = tables.drained(plan(), "m", str(tmp_path / "run")).select("scan_id", "txn_line_id").collect()
    assert [tuple(r) for r in got] == [("s1", "t1")]


def test_alerts_hear_of_batches_beyond_the_thresholds(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("".join('{"a":"x"}\n' if k % 10 else '{"n":1}\n' for k in range(100)))
    heard = []
    alerts = observed.Alerts("lines", 5.0, 50.0, lambda level, text, figures: heard.append((level, figures["failed"], figures["rows"])))
    jobs.ingest(jobs.json_lines(spark, str(source), LINES, "dev"), LINES, str(tmp_path / "t"), str(tmp_path / "b"), str(tmp_path / "c"), alerts)
    end = time.time() + 20
    while not heard and time.time() < end:
        time.sleep(0.2)
    assert heard == [("warn", 10, 100)]


def test_expectations_are_counted_by_the_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "n int, s string")
    got = observed.violations(rows, {"n": "n IS NOT NULL", "small": "n < 3"}, lambda df: df.write.parquet(str(tmp_path / "t")))
    assert [tuple(r) for r in got.collect()] == [("n", 1, 3), ("small", 2, 3)]
    empty, told = observed.watched(rows.limit(0), {"n": "n IS NOT NULL"})
    empty.write.parquet(str(tmp_path / "e"))
    assert told() == {"rows": 0, "n": 0}
    with pytest.raises(ValueError, match="rows"):
        observed.counters({"rows": "true"})


def dims(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_increments_equal_the_fold_and_the_plan_stays_level(spark):
    days = [f"2027-{m:02d}-{d:02d}" for m in (1, 2) for d in (1, 5, 9, 20)]
    shape = "id int, cohort string, note int, day string"
    row = lambda k, j, day: (k or None, "abc"[(k * j + j // 3) % 3] if (k + j) % 4 else None, k * j, day)
    made = [spark.createDataFrame([row(k, j, day) for k in range(6) if k != j % 5], shape) for j, day in enumerate(days)]
    want = dims(versions.fold(made, ["id"], ["cohort"], "day"))
    whole = made[0]
    for more in made[1:]:
        whole = whole.unionByName(more)
    at_once = versions.advance(None, whole, ["id"], ["cohort"], "day")
    assert dims(at_once) == want
    held = spark.createDataFrame(versions.advance(None, made[0].unionByName(made[1]), ["id"], ["cohort"], "day").collect(), at_once.schema)
    rest = made[2]
    for more in made[3:]:
        rest = rest.unionByName(more)
    held = spark.createDataFrame(versions.advance(held, rest, ["id"], ["cohort"], "day").collect(), at_once.schema)
    assert dims(held) == want
    assert dims(versions.advance(held, whole, ["id"], ["cohort"], "day")) == want  # applied again: nothing changes
    assert dims(versions.advance(held, whole.limit(0), ["id"], ["cohort"], "day")) == want
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window")
    many = spark.range(50).selectExpr("cast(id % 3 AS int) AS id", "cast(id AS string) AS cohort", "0 AS note", "cast(date_add(date'2027-01-01', cast(id AS int)) AS string) AS day")
    assert steps(versions.advance(None, many, ["id"], ["cohort"], "day")) == steps(versions.advance(None, made[0], ["id"], ["cohort"], "day"))
    # On the day that the open version began, a delivery replaces it; an earlier one changes nothing.
    one = versions.advance(None, spark.createDataFrame([(1, "a", 0, "2027-01-05")], shape), ["id"], ["cohort"], "day")
    late = spark.createDataFrame([(1, "b", 0, "2027-01-05"), (1, "c", 0, "2027-01-01")], shape)
    assert dims(versions.advance(one, late, ["id"], ["cohort"], "day")) == dims(versions.advance(None, late.where("cohort = 'b'"), ["id"], ["cohort"], "day"))


def test_the_sorted_merge_equals_a_search(spark):
    import random

    rng = random.Random(5)
    prices = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([hour(rng.randint(0, 400)), None]) if rng.random() < 0.1 else hour(rng.randint(0, 400)), rng.randint(1, 99)) for _ in range(300)]
    rows = [(k, rng.choice(["hot", "a", "b", "c", None]), hour(rng.randint(-50, 450)) if rng.random() < 0.95 else None) for k in range(400)]
    df = versions.as_of_sorted(spark.createDataFrame(rows, "n int, k string, t timestamp"), spark.createDataFrame(prices, "k string, since timestamp, price int"), "k", "t", "since", {"price": "paid"})
    want = []
    for n, k, t in rows:
        known = [(s, p) for kk, s, p in prices if kk == k and s is not None and t is not None and k is not None and s <= t]
        want.append((n, k, t, max(known)[1] if known else None))
    assert df.columns == ["n", "k", "t", "paid"] and sorted((tuple(r) for r in df.collect()), key=lambda r: r[0]) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_the_last_hours_stay_open_in_the_registered_query(spark, tmp_path):
    rows = [(k, hour(k), k % 3, "purchase", float(k), "{}") for k in range(120)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = tables.drained(tables.revenue(tables.change_stream(spark, str(tmp_path))), "r")
    assert got.agg(F.max("window_start")).first()[0] == hour(119 - 48 - 1) and json.loads(got.limit(1).toJSON().first())
