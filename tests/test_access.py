import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import checks, layout
from millrace.plans import access
from millrace.sources import contracts, landed
from millrace.streaming import tables


def test_roles_see_what_their_tags_allow(spark):
    spark.createDataFrame([(1, "Ann", "2000-01-01"), (2, "Bo", "2020-01-01"), (3, None, None)], "id int, name string, born string").createOrReplaceTempView("people")
    access.standard(spark, "it's", "2027-01-01")
    made = access.grant(spark, "people", {"name": "person", "born": "birth"}, temporary=True)
    seen = {r: sorted(map(tuple, spark.table(v).collect())) for r, v in made.items() if r in ("analyst", "visitor")}
    assert seen["visitor"] == [(1, None, None)]
    assert [(r[0], r[2]) for r in seen["analyst"]] == [(1, "2000")] and len(seen["analyst"][0][1]) == 64
    assert spark.table(made["support"]).select("name", "born").collect()[1] == ("B.", "2020")
    assert spark.table(made["steward"]).count() == 3
    columns = {"id": "int", "name": "string"}
    with pytest.raises(ValueError, match="birth"):  # a filter whose column is not there
        access.query(columns, {"name": "person"}, access.ROLES[0], "people")
    with pytest.raises(ValueError, match="plain"):
        access.query(columns, {"name": "person"}, access.Role("x", {"person": "f(1) --"}), "people")
    with pytest.raises(ValueError, match="no such"):
        access.query(columns, {"nam": "person"}, access.ROLES[2], "people")


def test_a_table_without_the_day_of_birth_is_refused(spark):
    with pytest.raises(ValueError, match="birth_date"):
        checks.protected(spark.createDataFrame([("a",)], "account_id string"), contracts.get("crm_accounts"), "s")


def test_a_curve_reads_fewer_files_for_either_column(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") * 7919 % 1000).cast("int").alias("a"), (F.col("id") * 104729 % 977).cast("double").alias("b"), "id").withColumn("a", F.when(F.col("id") % 500 != 0, F.col("a")))
    layout.write_curved(rows, str(tmp_path / "curve"), ["a", "b"], 16)
    rows.repartitionByRange(16, "a").write.parquet(str(tmp_path / "range"))
    curved, ranged = (spark.read.parquet(str(tmp_path / p)) for p in ("curve", "range"))
    assert curved.count() == 40_000 and curved.where("a IS NULL").count() == 80
    assert layout.read_for(ranged, "b", 100, 120) == 16  # sorted by the other column alone
    assert layout.read_for(curved, "a", 100, 120) <= 8 and layout.read_for(curved, "b", 100, 120) <= 8
    with pytest.raises(ValueError, match="number"):
        layout.curve(rows.withColumn("s", F.lit("x")), ["s"])
    assert layout.curve(rows.limit(0), ["a", "b"]).count() == 0


def test_places_on_the_curve(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (3, 3), (2, 1)], "x int, y int")
    got = [r[0] for r in df.select(layout.interleaved([F.col("x"), F.col("y")], 2)).collect()]
    assert got == [0, 2, 1, 3, 15, 9]
    ranks = spark.createDataFrame([(None,), (-1.0,), (5.0,), (7.0,), (99.0,)], "v double").select(layout.rank(F.col("v"), [5.0, 6.0, 8.0])).collect()
    assert [r[0] for r in ranks] == [0, 0, 1, 2, 3]


def test_landed_files_in_batch_and_stream(spark, tmp_path):
    landed.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"a":"x","n":1,"more":[1]}\n{"a":"y"}\n')
    (folder / "2.json").write_text("")
    (folder / "_hidden.json").write_text('{"a":"no"}\n')
    shape = "a STRING, n INT, day DATE"
    read = lambda: spark.read.format("landed").schema(shape).load(str(folder))
    assert sorted(map(tuple, read().collect())) == [("x", 1, None), ("y", None, None)]
    stream = lambda: spark.readStream.format("landed").schema(shape).load(str(folder))
    assert tables.drained(stream(), "l", str(tmp_path / "run")).count() == 2
    (folder / "3.json").write_text('{"a":"z","n":3,"day":"2027-04-01"}\n')
    os.utime(folder / "3.json", ns=(2**61, 2**61))
    got = tables.drained(stream(), "l", str(tmp_path / "run"))
    assert sorted(r["a"] for r in got.collect()) == ["x", "y", "z"] and str(got.where("a = 'z'").first()["day"]) == "2027-04-01"
    (tmp_path / "c.csv").write_text("n,a,b\n5,q,\n,,\n")
    rows = spark.read.format("landed").option("kind", "csv").schema(shape).load(str(tmp_path / "c.csv"))
    assert sorted(map(str, rows.collect())) == sorted(["Row(a='q', n=5, day=None)", "Row(a=None, n=None, day=None)"])
    with pytest.raises(Exception, match="none of"):
        spark.read.format("landed").option("kind", "xml").schema(shape).load(str(folder)).collect()


def test_schemas_are_kept_apart_and_change_only_with_their_version(spark, tmp_path):
    from millrace.sources import schemas
    from millrace.sources.contracts import Contract, ContractError, Policy

    path = str(tmp_path / "s")
    of = lambda version, columns: Contract("t", version, ("a",), Policy.RESCUE, columns, refusals=(("a", "NULL_PRIMARY_KEY"),))
    first, second = of("1.9.0", "a! STRING\nn INT"), of("1.10.0", "a! STRING\nn INT\nmore DATE")
    assert schemas.remember(spark, path, first) and not schemas.remember(spark, path, first)
    with pytest.raises(ContractError, match="n changed without"):
        schemas.remember(spark, path, of("1.9.0", "a! STRING\nn BIGINT"))
    with pytest.raises(ContractError, match="cannot be read"):
        schemas.remember(spark, path, of("2.0.0", "a! STRING"))
    assert schemas.remember(spark, path, second)
    with pytest.raises(ContractError, match="used already"):
        schemas.remember(spark, path, of("1.9.5", "a! STRING\nn INT"))
    assert [e["version"] for e in schemas.kept(spark, path)] == ["1.9.0", "1.10.0"]
