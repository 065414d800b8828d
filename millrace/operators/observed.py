"""Expectations measured while rows are written, and alerts from running streams: no scan of their own.

The counts ride along with whatever reads the rows (Dataset.observe): tasks
count what passes, and the sums are there when the action has ended.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

TOTAL = "rows"


def counters(expectations: Mapping[str, str | Column]) -> list[Column]:
    """All rows, and those for which each predicate is not true."""
    if TOTAL in expectations:
        raise ValueError(f"{TOTAL} is the name of the count of all rows")
    return [F.count(F.lit(1)).alias(TOTAL), *(F.count_if(~F.coalesce(F.expr(p) if isinstance(p, str) else p, F.lit(False))).alias(n) for n, p in expectations.items())]


def watched(df: DataFrame, expectations: Mapping[str, str]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """df, and a function that tells {rows, failures by expectation} once df has been written (or otherwise computed).

    Only the first action over the DataFrame counts; asked before it, the function waits.
    """
    seen = Observation()
    return df.observe(seen, *counters(expectations)), lambda: {k: int(seen.get.get(k) or 0) for k in (TOTAL, *expectations)}


def violations(df: DataFrame, expectations: Mapping[str, str], write: Callable[[DataFrame], None]) -> DataFrame:
    """What checks.violations says of df, counted while write() stores it: (expectation, failed, total)."""
    rows, told = watched(df, expectations)
    write(rows)
    found = told()
    return df.sparkSession.createDataFrame([(n, found[n], found[TOTAL]) for n in expectations], "expectation string, failed long, total long")


def share(failed: int, rows: int) -> float:
    """Percent of the rows; 0 of none."""
    return 100.0 * failed / rows if rows else 0.0


class Alerts(StreamingQueryListener):
    """Tells of a stream's batch whose observed failures pass a threshold.

    Watches metrics called `name` that were made by counters(): tell(level, text,
    figures) is called with "warn" or "fail" for each expectation beyond the
    percentages. It never stops the stream: gates do, where rows are accepted.
    """

    def __init__(self, name: str, warn: float, fail: float, tell: Callable[[str, str, dict], None]):
        super().__init__()
        self.name, self.warn, self.fail, self.tell = name, warn, fail, tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is None:
            return
        counts = {k: int(v or 0) for k, v in found.asDict().items()}
        rows = counts.pop(TOTAL)
        for expectation, failed in counts.items():
            of = share(failed, rows)
            level = "fail" if of > self.fail else "warn" if of > self.warn else None
            if level:
                self.tell(level, f"{expectation}: {of:.2f} % of {rows} rows", {"batch": event.progress.batchId, "expectation": expectation, "failed": failed, "rows": rows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
