"""What the corpus operators share: the shared folder, text chunks and vectorised hashing.

Python code here runs in Arrow-batched workers. Every kernel works on one chunk
of whole documents at a time, so a worker's memory follows the chunk size and
the longest document, never the number of rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, here and in SQL: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one vectorised step takes, unless one document is longer.
CHUNK_BYTES = 1 << 19

#: Bytes of the input's files for each reduce partition at most.
PART_BYTES = 256 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only in a local session without that setting a temporary folder is made; on
    a cluster the setting must be there.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local(\[[^-]|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = spark.conf.get("millrace.shared.dir", None)
        if not top:
            top = tempfile.mkdtemp(prefix="millrace-")
            spark.conf.set("millrace.shared.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage ends here.

    The files survive lost executors. They are left for the folder's owner to
    clear, as checkpoints are.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(docs: DataFrame) -> int:
    """Reduce partitions for one pass over docs: the session's shuffle partitions, more where its files have over PART_BYTES for each."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    known = sum(s for s in sizes if s < 1 << 60)  # what is in no file counts as endless
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PART_BYTES))


def small_batches(spark: SparkSession) -> None:
    """Send at most 1,000 rows to Python at once in this session, where its setting is more.

    Texts vary in length; the default of 10,000 rows fills an executor's memory
    with batches on both sides of the pipe.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, 1000)


def unused(name: str, columns: Iterable[str]) -> str:
    """name, with underscores before it until none of the columns has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def doc_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, a null text as the empty one; other columns only if named."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of at most `limit` bytes of text each (one row at least)."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(lengths(batch.column(column)) + 1)
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
        _trim()


def _trim() -> None:
    """Hand freed memory back to the system, where its C library can: workers stay alive between tasks."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(texts: pa.Array, gap: bytes = b" ") -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer with a gap byte after each: (buffer, bytes as array, starts, lengths)."""
    parts = texts.cast(pa.binary()).to_pylist()
    buffer = gap.join(x or b"" for x in parts) + gap
    size = np.fromiter((len(x) if x else 0 for x in parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(size + len(gap))[:-1])).astype(np.int64)
    return buffer, np.frombuffer(buffer, np.uint8), starts, size


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, which ends in a space."""
    word = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).view(np.int8)))
    return edge[0::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, so that all bits depend on all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _table(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)
    if lower:
        table[65:91] = table[97:123]
    return table


_BYTE, _LOWER = _table(False), _table(True)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """64-bit hashes of any slices of one sequence of values, from one prefix sum.

    Equal slices have equal hashes wherever they lie; 64 bits make others differ
    but for a chance of about 2**-64 a pair.
    """

    def __init__(self, values: np.ndarray):
        power, self.inverse = _power(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.inverse[starts]
        h += (ends - starts).astype(np.uint64) * _PRIME
        return mix(h)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all slices of length k."""
        n = max(0, len(self.sums) - k)
        h = self.sums[k : k + n] - self.sums[:n]
        h *= self.inverse[:n]
        h += _U((k * int(_PRIME)) % (1 << 64))
        return mix(h)


def byte_values(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """A pseudo-random 64-bit value for each byte; lower: A-Z as a-z."""
    return (_LOWER if lower else _BYTE)[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each word."""
    return Rolling(byte_values(data, lower)).slices(starts, ends)


def word_docs(word_starts: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where each document's words begin among all words, with the total at the end."""
    return np.concatenate((np.searchsorted(word_starts, doc_starts, "left"), [len(word_starts)])).astype(np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... (count of them) for each pair, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(first - starts, counts)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open spans by document, touching ones joined; sorted."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # Ends grow along a document only as running maxima: lift each document above the one before.
    change = np.concatenate(([True], doc[1:] != doc[:-1]))
    group = np.cumsum(change) - 1
    lift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate(([True], (start + lift)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], start[first], reach[last] - lift[last]
