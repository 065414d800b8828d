"""Small files beside the data, on whatever file system Spark writes to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not be there yet; False if it is."""
    fs, where = _at(spark, path)
    if fs.exists(where):
        return False
    try:
        out = fs.create(where, False)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all below a folder."""
    fs, where = _at(spark, path)
    return int(fs.getContentSummary(where).getLength()) if fs.exists(where) else 0


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one only in a local session without it."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local(\[[^-]|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="millrace-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
