"""A run's log: one JSON object a line, to be read again with spark.read.json."""

from __future__ import annotations

import json
import logging
import os
import sys
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

_RUN = os.environ.get("MILLRACE_RUN_ID") or uuid.uuid4().hex
_PLAIN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


def run_id() -> str:
    """The same for all of a process."""
    return _RUN


class JsonLines(logging.Formatter):
    """Time, level, logger, message, run and whatever was given as extra."""

    def format(self, record: logging.LogRecord) -> str:
        told = {"time": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage(), "run_id": _RUN}
        told |= {k: v for k, v in vars(record).items() if k not in _PLAIN}
        if record.exc_info:
            told["error"] = self.formatException(record.exc_info)
        return json.dumps(told, default=str)


def configure(level: str = "INFO", stream=None) -> logging.Logger:
    """The package's logger with one JSON handler, however often this is called."""
    logger = logging.getLogger("millrace")
    for handler in [h for h in logger.handlers if isinstance(h.formatter, JsonLines)]:
        logger.removeHandler(handler)
    handler = logging.StreamHandler(stream or sys.stdout)
    handler.setFormatter(JsonLines())
    logger.addHandler(handler)
    logger.setLevel(level)
    logger.propagate = False
    return logger


@contextmanager
def stage(logger: logging.Logger, name: str, **context) -> Iterator[dict]:
    """Log a stage's beginning, end or failure, with its seconds and the metrics put into the yielded dict."""
    metrics: dict = {}
    began = time.monotonic()
    logger.info("started", extra={"stage": name, **context})
    try:
        yield metrics
    except BaseException as error:
        logger.error("failed", extra={"stage": name, **context, **metrics, "seconds": round(time.monotonic() - began, 3), "cause": repr(error)})
        raise
    logger.info("finished", extra={"stage": name, **context, **metrics, "seconds": round(time.monotonic() - began, 3)})


def stages(spark, path: str):
    """Run logs as a table: stage, runs, failures, median and longest seconds of each, the slowest first."""
    from pyspark.sql import functions as F

    rows = spark.read.schema("message string, stage string, seconds double, run_id string").json(path).where("message IN ('finished', 'failed') AND stage IS NOT NULL")
    failures = F.count_if(F.col("message") == "failed")
    found = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), failures.alias("failures"), F.median("seconds").alias("median_seconds"), F.max("seconds").alias("longest_seconds"))
    return found.orderBy(F.col("longest_seconds").desc(), "stage")
