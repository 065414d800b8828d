"""Tables of versions: every write makes a new folder, and a log entry makes it the table.

    folder/data/<unique>/...   Parquet files of one version
    folder/log/00000007.json   version, time, operation, path, rows, columns

An entry is created, never replaced, so of two writers that start from one version
only one ends; the other raises Conflict. Readers and a write that reads the
table it replaces never meet half-written files. Update and merge rewrite the
rows of the whole table, as plain Parquet needs.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import observed
from millrace.sources import files


class Conflict(RuntimeError):
    """Another writer has made the version that this one would have made."""


class Versioned:
    """One table, shown to SQL as a view of that name where one is given."""

    def __init__(self, spark: SparkSession, folder: str, name: str | None = None):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name

    def entries(self) -> list[dict]:
        """The log, oldest first."""
        found = [n for n in files.names(self.spark, f"{self.folder}/log") if n.endswith(".json")]
        return [json.loads(files.read(self.spark, f"{self.folder}/log/{n}")) for n in found]

    def exists(self) -> bool:
        return any(n.endswith(".json") for n in files.names(self.spark, f"{self.folder}/log"))

    def _entry(self, version: int | None, at: str | None) -> dict:
        log = self.entries()
        if version is not None:
            log = [e for e in log if e["version"] == version]
        elif at is not None:
            limit = datetime.fromisoformat(at).replace(tzinfo=timezone.utc) if datetime.fromisoformat(at).tzinfo is None else datetime.fromisoformat(at)
            log = [e for e in log if datetime.fromisoformat(e["time"]) <= limit]
        if not log:
            raise LookupError(f"{self.folder} has no version {version if version is not None else at or ''}".rstrip())
        return log[-1]

    def read(self, version: int | None = None, at: str | None = None) -> DataFrame:
        """The table now, as of a version, or as of a time (ISO, UTC if no zone is given)."""
        entry = self._entry(version, at)
        return self.spark.read.schema(entry["schema"]).parquet(entry["path"])

    def write(self, rows: DataFrame, operation: str = "WRITE") -> int:
        """Make rows the next version; its number. `rows` may read this table."""
        log = self.entries()
        version, path = (log[-1]["version"] + 1 if log else 0), f"{self.folder}/data/{uuid.uuid4().hex}"
        watched, told = observed.watched(rows, {})
        watched.write.parquet(path)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        entry = {"version": version, "time": datetime.now(timezone.utc).isoformat(), "operation": operation, "path": path, "rows": told()[observed.TOTAL], "columns": rows.columns, "schema": schema}
        if not files.write_new(self.spark, f"{self.folder}/log/{version:08d}.json", json.dumps(entry)):
            files.remove(self.spark, path)
            raise Conflict(f"{self.folder}: version {version} was made by another writer")
        self.show()
        return version

    def show(self) -> None:
        """Point the view at the latest version; any session that shares the catalogue sees it."""
        if self.name:
            entry = self._entry(None, None)
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS SELECT * FROM parquet.`{entry['path']}`")

    def append(self, rows: DataFrame) -> int:
        """Rows added; columns that the table lacks widen it, those that rows lack are null."""
        return self.write(self.read().unionByName(rows, allowMissingColumns=True) if self.exists() else rows, "APPEND")

    def update(self, values: Mapping[str, Column], where: Column) -> int:
        """Set columns in the rows for which `where` is true."""
        hit = F.coalesce(where, F.lit(False))
        now = self.read()
        kinds = {f.name: f.dataType for f in now.schema}
        return self.write(now.withColumns({c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}), "UPDATE")

    def delete(self, where: Column) -> int:
        """Remove the rows for which `where` is true."""
        return self.write(self.read().where(~F.coalesce(where, F.lit(False))), "DELETE")

    def merge(self, changes: DataFrame, keys: Sequence[str], sequence: str, operation: str = "__op") -> int:
        """Apply changes by key: of each key's the last in sequence; D deletes, others replace or add the row.

        The sequence and operation columns are not kept. Null keys match each other.
        """
        payload = [c for c in changes.columns if c not in (sequence, operation)]
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(*payload, operation), sequence).alias("_last")).select("_last.*")
        if not self.exists():
            return self.write(last.where(~F.col(operation).eqNullSafe("D")).drop(operation), "MERGE")
        now, match = self.read(), last.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        rest = now.join(match, on, "left_anti")
        return self.write(rest.unionByName(last.where(~F.col(operation).eqNullSafe("D")).select(*now.columns)), "MERGE")

    def history(self) -> DataFrame:
        """version, time, operation, rows and columns of each version, newest first."""
        rows = [(e["version"], e["time"], e["operation"], e["rows"], e["columns"]) for e in reversed(self.entries())]
        return self.spark.createDataFrame(rows, "version long, time string, operation string, rows long, columns array<string>")

    def detail(self) -> dict:
        """Where the table is, its version, rows, columns and bytes."""
        entry = self._entry(None, None)
        return {"location": self.folder, "version": entry["version"], "rows": entry["rows"], "columns": entry["columns"], "bytes": files.size(self.spark, entry["path"])}

    def vacuum(self, keep_hours: float = 168.0) -> list[int]:
        """Remove the versions that stopped being the table more than keep_hours ago; their numbers."""
        log, gone = self.entries(), []
        for entry, after in zip(log, log[1:], strict=False):
            if time.time() - datetime.fromisoformat(after["time"]).timestamp() > keep_hours * 3600:
                files.remove(self.spark, entry["path"])
                files.remove(self.spark, f"{self.folder}/log/{entry['version']:08d}.json")
                gone.append(entry["version"])
        return gone
