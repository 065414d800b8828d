"""Landing files as a data source: spark.read.format("landed"), and the same as a stream.

    landed.register(spark)
    spark.read.format("landed").option("kind", "json").schema("a STRING, n INT").load(path)
    spark.readStream.format("landed").option("kind", "csv").schema(ddl).load(path)

A file is a partition and is read in Arrow batches on the workers. Kinds: json
(lines), csv (with a header) and parquet. Columns are found by name and cast to
the schema that is asked for: what a file lacks is null, what the schema lacks is
left out, and a value that does not fit raises; times without a zone are UTC. As a
stream, files are taken once, in the order of (time of modification, name), all
that are there in one batch. Workers must reach the path: local, mounted, or a
store that pyarrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KINDS = ("json", "csv", "parquet")


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[int, str]]:
    """(modification in nanoseconds, path) of the files below a folder, or of one file, in order; hidden ones are left out."""
    from pyarrow import fs

    store, inside = _store(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    below = lambda f: f.path[len(inside) :].strip("/").split("/")
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == fs.FileType.File and not any(p[:1] in (".", "_") for p in below(f)))


def fitted(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """A column in the type that is asked for."""
    if pa.types.is_timestamp(kind) and kind.tz and pa.types.is_string(column.type):
        import pyarrow.compute as pc

        try:
            return column.cast(kind)
        except pa.ArrowInvalid:  # no zone
            return pc.assume_timezone(column.cast(pa.timestamp(kind.unit)), "UTC").cast(kind)
    return column.cast(kind)


def batches(path: str, file: str, kind: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A file's rows in the schema's columns."""
    store, _ = _store(path)
    with store.open_input_file(file) as source:
        if kind == "parquet":
            import pyarrow.parquet as pq

            reader = pq.ParquetFile(source)
            names = [n for n in schema.names if n in reader.schema_arrow.names]
            found = reader.iter_batches(columns=names)
        elif source.size() == 0:
            found = iter(())
        elif kind == "csv":
            from pyarrow import csv

            text = {n: pa.string() for n in schema.names}
            found = csv.open_csv(source, convert_options=csv.ConvertOptions(column_types=text, strings_can_be_null=True, null_values=[""], include_columns=None))
        else:
            from pyarrow import json

            known = pa.schema([(f.name, pa.string() if pa.types.is_temporal(f.type) else f.type) for f in schema])
            found = json.open_json(source, parse_options=json.ParseOptions(explicit_schema=known, unexpected_field_behavior="ignore"))
        for batch in found:
            columns = [fitted(batch.column(f.name), f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class File(InputPartition):
    """One file of a read."""

    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Files:
    """What batch and stream readers share."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "json")
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind!r} is none of {', '.join(KINDS)}")
        self.arrow = to_arrow_schema(schema)

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition.path, self.kind, self.arrow)


class Reader(_Files, DataSourceReader):
    def partitions(self) -> list[File]:
        return [File(f) for _, f in listed(self.path)]


class StreamReader(_Files, DataSourceStreamReader):
    """Offsets are the last file taken; each batch is the files after the one before."""

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def _after(self, start: dict) -> list[tuple[int, str]]:
        return [x for x in listed(self.path) if x > (start["time"], start["file"])]

    def latestOffset(self) -> dict:
        there = listed(self.path)
        return {"time": there[-1][0], "file": there[-1][1]} if there else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(f) for t, f in self._after(start) if (t, f) <= (end["time"], end["file"])]

    def commit(self, end: dict) -> None:
        pass


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        raise ValueError("give the schema that the files are read by")

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session; known already, it is registered again."""
    spark.dataSource.register(Landed)
