"""SQL from text to a plain result, table definitions, and the smoke test of a deployment."""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import checks
from millrace.sources.contracts import Contract
from millrace.sources.settings import LAYERS, Settings


def run(spark: SparkSession, query: str, args: Mapping | None = None, most: int = 1000) -> dict:
    """The result of one statement as {columns, rows, row_count}; a result of over `most` rows raises.

    :name markers take their values from args, IDENTIFIER(:name) a table's name.
    """
    found = spark.sql(query, args=dict(args or {}))
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return {"columns": found.columns, "rows": [list(r) for r in rows], "row_count": len(rows)}


def session(spark: SparkSession) -> DataFrame:
    """Who runs where: one row of the session functions, and settings under millrace.*"""
    told = spark.sql("SELECT current_catalog() AS catalog, current_schema() AS schema, current_user() AS user")
    return told.withColumn("environment", F.lit(conf(spark, "millrace.environment", "dev")))


def conf(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A setting of the running session, as jobs get theirs."""
    return spark.conf.get(name, default)


def databases(spark: SparkSession, settings: Settings, tags: Mapping[str, str] | None = None) -> list[str]:
    """Make the databases of an environment's layers, commented and tagged; all there are."""
    told = {"environment": settings.environment, **(tags or {})}
    for layer in LAYERS:
        listed = ", ".join(f"'{k}' = '{v}'" for k, v in sorted({**told, "layer": layer}.items()))
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {settings.database(layer)} COMMENT 'layer {layer} of {settings.catalog}' WITH DBPROPERTIES ({listed})")
    return sorted(d.name for d in spark.catalog.listDatabases())


def tags(spark: SparkSession, database: str) -> dict[str, str]:
    """A database's tags."""
    rows = spark.sql(f"DESCRIBE DATABASE EXTENDED {database}").collect()
    text = next((r[1] for r in rows if r[0] == "Properties"), "")
    return dict(pair.split(",", 1) for pair in text.strip("()").replace("), (", ")(").split(")(") if "," in pair)


def create_table(spark: SparkSession, name: str, contract: Contract, location: str | None = None, more: Sequence[str] = (), properties: Mapping[str, str] | None = None) -> None:
    """A Parquet table of a contract's columns, with NOT NULL, comments and properties, if there is none.

    With a location it is external: dropping it leaves the files. Spark does not
    enforce NOT NULL on Parquet: `insert` does.
    """
    columns = [f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'} COMMENT '{contract.comment(f.name)}'" for f in contract.schema()]
    told = {"contract": contract.name, "contract_version": contract.version, **(properties or {})}
    listed = ", ".join(f"'{k}' = '{v}'" for k, v in sorted(told.items()))
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join([*columns, *more])}) USING parquet{place} COMMENT '{contract.name} {contract.version}' TBLPROPERTIES ({listed})")


def insert(spark: SparkSession, name: str, rows: DataFrame, contract: Contract) -> None:
    """Append rows by name; a null in a column that must be present raises, and nothing is written."""
    checks.require(rows, {f"{c} is present": f"`{c}` IS NOT NULL" for c in contract.required}).select(*spark.table(name).columns).write.insertInto(name)


def values(spark: SparkSession, name: str, rows: Sequence[Sequence]) -> None:
    """INSERT ... VALUES with the values as parameters."""
    marks = ", ".join("(" + ", ".join(f":v{i}_{k}" for k in range(len(row))) + ")" for i, row in enumerate(rows))
    spark.sql(f"INSERT INTO {name} VALUES {marks}", args={f"v{i}_{k}": v for i, row in enumerate(rows) for k, v in enumerate(row)})


def tables(spark: SparkSession, database: str, like: str = "%", matching: str = ".*") -> DataFrame:
    """name, kind and is_external of a database's tables whose names are LIKE and RLIKE the patterns, in order."""
    rows = [(t.name, t.tableType, t.tableType == "EXTERNAL") for t in spark.catalog.listTables(database) if not t.isTemporary]
    found = spark.createDataFrame(rows, "name string, kind string, is_external boolean")
    return found.where(F.col("name").like(like) & F.col("name").rlike(matching)).orderBy("name")


def peek(spark: SparkSession, path: str, kind: str = "json", most: int = 20) -> DataFrame:
    """The first rows of files, without a table: at most `most`, for a look."""
    return spark.sql(f"SELECT * FROM {kind}.`{path}`").limit(most)


def smoke(spark: SparkSession, settings: Settings, run_id: str, revision: str) -> dict:
    """Whether an environment works: its databases are there, a row is written to the deploy log and read back.

    Fails with the reason; otherwise {status, databases, rows}.
    """
    databases(spark, settings)
    wanted = [settings.database(x) for x in LAYERS]
    there = spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "name string").where(F.col("name").isin(wanted))
    counted = there.agg(F.count(F.lit(1)).alias("n"))
    said = F.concat(F.lit("databases: "), F.col("n").cast("string"))
    counted.select(F.when(F.col("n") >= len(wanted), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).collect()
    log = settings.table("ops", "deploy_smoke")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {log} (run_id STRING, environment STRING, git_sha STRING, deployed_by STRING, deployed_at TIMESTAMP) USING parquet")
    spark.sql("INSERT INTO IDENTIFIER(:log) SELECT :run, :environment, :revision, current_user(), current_timestamp()", args={"log": log, "run": run_id, "environment": settings.environment, "revision": revision})
    rows = spark.sql("SELECT count(*) AS n FROM IDENTIFIER(:log) WHERE run_id = :run", args={"log": log, "run": run_id}).first()["n"]
    if not rows:
        raise checks.GateError(f"{log} does not give back the row of run {run_id}")
    return {"status": "ok", "databases": wanted, "rows": rows}


def main(arguments: Sequence[str] | None = None) -> int:
    """python -m millrace.plans.statements "SELECT ..." [--arg name=value]: the result as one JSON line."""
    parser = argparse.ArgumentParser(prog="millrace.plans.statements")
    parser.add_argument("query")
    parser.add_argument("--arg", action="append", default=[], metavar="NAME=VALUE")
    parser.add_argument("--most", type=int, default=1000)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("millrace-sql").getOrCreate()
    print(json.dumps(run(spark, given.query, dict(a.split("=", 1) for a in given.arg), given.most), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
