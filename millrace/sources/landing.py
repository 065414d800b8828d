"""Landing files to bronze: audit columns, rescue, refusal of new columns, valid and quarantined rows."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.sources import files
from millrace.sources.contracts import Contract, Policy

# Names of the audit columns.
AUDIT = ("_ingest_ts", "_source_file", "_source_file_modified_ts", "_environment", "_contract_version")


class NewColumns(RuntimeError):
    """Files bring columns that their contract lacks and its policy refuses."""


def audited(df: DataFrame, contract: Contract, environment: str) -> DataFrame:
    """df read from files (batch or stream), with where, when and under which contract each row came."""
    return df.select(
        "*",
        F.current_timestamp().alias("_ingest_ts"),
        F.col("_metadata.file_path").alias("_source_file"),
        F.col("_metadata.file_modification_time").alias("_source_file_modified_ts"),
        F.lit(environment).alias("_environment"),
        F.lit(contract.version).alias("_contract_version"),
    )


def rescued(lines: DataFrame, contract: Contract) -> DataFrame:
    """Rows of the contract's columns from JSON lines (column value), with _rescued_data.

    _rescued_data is a JSON object of fields that the contract lacks and of those
    whose value does not fit their type (the column is null then); null if there
    are none. A line that is no JSON object, or null, gives a row of nulls with
    the line rescued under "_malformed". Other columns of lines pass through.
    """
    schema = contract.schema()
    raw = F.expr("try_variant_get(try_parse_json(value), '$', 'map<string,variant>')")
    parsed = lines.withColumn("_raw", raw).withColumn("_row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    names = F.array(*(F.lit(c) for c in contract.names))
    # What came out, by name: a present, non-null field that is not there has no column or did not fit. One
    # lookup for any number of columns, as the optimizer's work on a test for each grows with a power of it.
    fitted = F.from_json(F.to_json("_row"), "map<string,string>")
    extra = F.map_filter("_raw", lambda k, v: ~F.map_contains_key(F.col("_fitted"), k) & ~(F.is_variant_null(v) & F.array_contains(names, k)))
    malformed = F.to_json(F.struct(F.coalesce(F.col("value"), F.lit("")).alias("_malformed")))
    told = F.when(F.col("_raw").isNull(), malformed).when(F.size("_extra") > 0, F.to_json("_extra"))
    out = parsed.withColumn("_fitted", F.coalesce(fitted, F.create_map().cast("map<string,string>"))).withColumn("_extra", extra).withColumn("_rescued_data", told)
    rest = [c for c in lines.columns if c != "value"]
    return out.select(*(F.col(f"_row.{c}").alias(c) for c in contract.names), *rest, "_rescued_data")


def forbid_new_columns(spark: SparkSession, paths: list[str], contract: Contract) -> None:
    """Raise NewColumns if Parquet files have columns that the contract lacks; only footers are read."""
    found = spark.read.option("mergeSchema", "true").parquet(*paths).columns if paths else []
    extra = sorted(set(found) - set(contract.names))
    if extra and contract.policy is Policy.FAIL:
        raise NewColumns(f"{contract.name}: {', '.join(extra)}")


def split(df: DataFrame, contract: Contract, arrived: str | None = "_source_file_modified_ts") -> tuple[DataFrame, DataFrame]:
    """(rows that keep the contract, the others with _quarantine_reason); every row is in one of them.

    Without a column that must be present all rows are refused for it.
    """
    arrived, present = arrived if arrived in df.columns else None, set(df.columns)
    flagged = df.withColumn("_valid", contract.valid(arrived, present))
    bad = flagged.where(~F.col("_valid")).drop("_valid").withColumn("_quarantine_reason", contract.reason(present))
    return flagged.where("_valid").drop("_valid"), bad


def cast_to(df: DataFrame, contract: Contract) -> DataFrame:
    """String columns as the contract's types; what does not fit becomes null, for the split to refuse."""
    return df.select(*(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in contract.schema() if f.name in df.columns), *(c for c in df.columns if c not in contract.names))


def ledger_id(spark: SparkSession, checkpoint: str) -> str:
    """The name that a stream's checkpoint has had since it was made: a new ledger has another."""
    return json.loads(files.read(spark, f"{checkpoint}/metadata").splitlines()[0])["id"][:13]


def _of_policy(rows: DataFrame, contract: Contract) -> DataFrame:
    """Text rows with the contract's columns, and with what the policy makes of the others."""
    extra = [c for c in rows.columns if c not in contract.names]
    if extra and contract.policy is Policy.FAIL:
        raise NewColumns(f"{contract.name}: {', '.join(extra)}")
    out = [F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in contract.names]
    if contract.policy is Policy.ADD:
        out += [F.col(f"`{c}`") for c in extra]
    if contract.policy is Policy.RESCUE:
        told = F.to_json(F.struct(*(F.col(f"`{c}`") for c in extra))) if extra else F.lit("{}")
        out.append(F.when(told != "{}", told).alias("_rescued_data"))
    return rows.select(*out, F.col("_metadata.file_path").alias("_source_file"))


def copy_csv(spark: SparkSession, source: str, table_path: str, contract: Contract, ledger: str) -> int:
    """Load CSV files that the ledger does not know into a Parquet table, once per file name; rows loaded.

    An available-now stream does it: its checkpoint is the ledger of files, and a
    rerun, or a run that was cut off, loads no file twice. Columns are found by
    each file's header, read as text and cast, so that a bad value is refused and
    fails no load. Columns that the contract lacks are its policy's: they widen the
    table as text (read it with mergeSchema), refuse the load before anything is
    written, go into _rescued_data, or are left out. Headers are gathered in one
    pass over a batch; files of one header are read together.
    """
    loaded = []

    def write(batch: DataFrame, number: int) -> None:
        reader = lambda: batch.sparkSession.read.option("header", True)
        # Each file's first line, in one pass over the batch; one small job for each different header.
        first = batch.where("_begins = 0 AND trim(value) <> ''").withColumn("_n", F.monotonically_increasing_id())
        lines = first.groupBy("_source_file").agg(F.min_by("value", "_n").alias("_header"))
        headers: dict[tuple[str, ...], list[str]] = {}
        for row in lines.groupBy("_header").agg(F.sort_array(F.collect_list("_source_file")).alias("names")).collect():
            headers.setdefault(tuple(reader().csv(row["names"][0]).columns), []).extend(row["names"])
        rows = [_of_policy(reader().schema(StructType([StructField(c, StringType()) for c in h])).csv(names), contract) for h, names in sorted(headers.items())]
        if rows:
            every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
            told = every.select("*", F.current_timestamp().alias("_ingest_ts"), F.lit(contract.version).alias("_contract_version"))
            path = f"{table_path}/batch={ledger_id(spark, ledger)}-{number}"
            cast_to(told, contract).write.mode("overwrite").parquet(path)
            loaded.append(batch.sparkSession.read.parquet(path).count())

    lines = spark.readStream.text(source).select("value", F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_block_start").alias("_begins"))
    query = lines.writeStream.foreachBatch(write).option("checkpointLocation", ledger).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(loaded)
