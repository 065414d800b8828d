"""The schemas that a stream was read by, kept apart from its checkpoint: one small file for each contract version."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from millrace.sources import files
from millrace.sources.contracts import Contract, ContractError


def _order(version: str) -> tuple[int, ...]:
    return tuple(map(int, version.split(".")))


def kept(spark: SparkSession, path: str) -> list[dict]:
    """{version, policy, columns} of each version, oldest first; columns map names to types."""
    found = [json.loads(files.read(spark, f"{path}/{n}")) for n in files.names(spark, path) if n.endswith(".json")]
    return sorted(found, key=lambda e: _order(e["version"]))


def remember(spark: SparkSession, path: str, contract: Contract) -> bool:
    """Keep the contract's schema; whether it is new there.

    Raises ContractError where columns have changed without a new version, where
    a version comes before one that was used, and where a new version drops a
    column or changes its type: files of the old one could not be read by it.
    """
    told = {"version": contract.version, "policy": contract.policy.name, "columns": {f.name: f.dataType.simpleString() for f in contract.schema()}}
    before = kept(spark, path)
    same = next((e for e in before if e["version"] == contract.version), None)
    if same:
        if same["columns"] != told["columns"]:
            changed = sorted(set(same["columns"].items()) ^ set(told["columns"].items()))
            raise ContractError(f"{contract.name} {contract.version}: {', '.join(dict(changed))} changed without a new version")
        return False
    if before:
        last = before[-1]
        if _order(last["version"]) > _order(contract.version):
            raise ContractError(f"{contract.name} {contract.version}: {last['version']} was used already")
        if broken := [c for c, kind in last["columns"].items() if told["columns"].get(c) != kind]:
            raise ContractError(f"{contract.name} {contract.version}: {', '.join(broken)} cannot be read as in {last['version']}")
    if not files.write_new(spark, f"{path}/{contract.version}.json", json.dumps(told)):
        return remember(spark, path, contract)  # another run was first
    return True
