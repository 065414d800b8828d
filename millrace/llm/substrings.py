"""Suffix-array dedup (operator 3): difference-cover blockwise construction.

Every byte covered by a string of LENGTH bytes that also starts earlier in the
corpus is removed. Suffixes are put into buckets by content (see repeats), and
one memory-sized block of buckets is sorted at a time: first by PERIOD bytes;
longer ties are resolved by the ranks of a difference-cover sample, computed for
the block beforehand. For any two suffixes there is a shift below PERIOD that
takes both to sample positions, whose ranks decide. Neighbours in the sorted
order that agree in LENGTH bytes are equal strings; all but the earliest go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import common, repeats

LENGTH = 100
GRAM = 32
#: Bytes of contexts sorted at once.
BLOCK = 1 << 20


def cover(r: int) -> tuple[int, np.ndarray]:
    """(period, residues) such that every difference modulo the period is one of two residues.

    Colbourn and Ling's rule: steps of 1 (r times), r + 1, 2r + 1 (r times),
    4r + 3 (2r + 1 times), 2r + 2 (r + 1 times) and 1 (r times).
    """
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate(([0], np.cumsum(steps)))


def shifts(period: int, residues: np.ndarray) -> np.ndarray:
    """For residues a and b, the least d with a + d and b + d both in the cover."""
    inside = np.zeros(period, bool)
    inside[residues] = True
    out = np.full((period, period), -1, np.int16)
    at = np.arange(period)
    for d in range(period - 1, -1, -1):
        hit = inside[(at + d) % period]
        out[np.ix_(hit, hit)] = d
    return out


PERIOD, _COVER = cover(1)
#: Bytes that suffixes are first sorted by: whole words of 8, as many as the period has at least.
PREFIX = -(-PERIOD // 8) * 8
_SHIFT = shifts(PERIOD, _COVER)


def _eights(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number that sorts like them; text is padded by 8."""
    out = np.zeros(len(text) - 8, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | text[k : k + len(out)]
    return out


def _by_prefix(eights: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of at by PREFIX bytes, whether each differs from the one before)."""
    order = np.argsort(eights[at], kind="stable")
    word = eights[at[order]]
    new = np.concatenate(([True], word[1:] != word[:-1]))
    for k in range(8, PREFIX, 8):
        # Only groups of several need the next word.
        group = np.cumsum(new)
        alone = new & np.concatenate((new[1:], [True]))
        rows = np.flatnonzero(~alone)
        if not len(rows):
            break
        word = eights[at[order[rows]] + k]
        sub = np.lexsort((word, group[rows]))
        order[rows] = order[rows[sub]]
        word, inner = word[sub], group[rows][sub]
        new[rows] = np.concatenate(([True], (inner[1:] != inner[:-1]) | (word[1:] != word[:-1])))
    return order, new


def sample_ranks(text: np.ndarray, eights: np.ndarray) -> np.ndarray:
    """Rank among the sample's suffixes, at the sample's positions (others: 0).

    Sorted by PREFIX bytes, then by ranks PERIOD, twice PERIOD, ... further on,
    which are the sample's again, until all differ.
    """
    n = len(eights) - PREFIX
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, _COVER))
    order, new = _by_prefix(eights, at)
    rank = np.zeros(n + 1, np.int64)
    rank[at[order]] = np.cumsum(new)
    step = PERIOD
    while not new.all() and step < n:
        next_rank = rank[np.minimum(at + step, n)]
        key = rank[at] * (len(at) + 2) + next_rank
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank = np.zeros(n + 1, np.int64)
        rank[at[order]] = np.cumsum(new)
        step *= 2
    return rank


def _resolve(at: np.ndarray, new: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """at, with each group that agrees in PREFIX bytes put in order by the sample's ranks.

    A merge network sorts all groups side by side; a comparison takes both
    suffixes to the sample by their residues' shift.
    """
    head = np.flatnonzero(new)
    size = np.diff(np.concatenate((head, [len(at)])))
    many = size > 1
    rows = common.ranges(head[many], size[many])
    if not len(rows):
        return at
    local = rows - np.repeat(head[many], size[many])
    total = np.repeat(size[many], size[many])
    largest = int(size.max())
    p = 1
    while p < largest:
        k = p
        while k >= 1:
            base = k % p
            left = (local >= base) & ((local - base) % (2 * k) < k) & (local // (2 * p) == (local + k) // (2 * p)) & (local + k < total)
            a = rows[left]
            b = a + k
            x, y = at[a], at[b]
            d = _SHIFT[x % PERIOD, y % PERIOD]
            swap = rank[x + d] > rank[y + d]
            at[a[swap]], at[b[swap]] = y[swap], x[swap]
            k //= 2
        p *= 2
    return at


def _block(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each context begins, the text with zeros after it, its words of 8)."""
    size = np.fromiter((len(c) for c in contexts), np.int64, len(contexts))
    n = int(size.sum())
    padded = np.zeros(n + 2 * PREFIX + length + 16, np.uint8)
    padded[:n] = np.frombuffer(b"".join(contexts), np.uint8)
    return np.cumsum(size) - size, padded, _eights(padded)


def equal_windows(contexts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows among the first counts[i] of each context that may have an equal one, sorted as suffixes.

    Returns (context, offset, class): equal windows, and only they, have one
    class. Windows that differ from all others in PREFIX bytes are left out, and
    so are contexts without a tie when the sample is ranked.
    """
    base, _, eights = _block(contexts, length)
    at = common.ranges(base, counts)
    order, new = _by_prefix(eights, at)
    alone = new & np.concatenate((new[1:], [True])) if len(new) else new
    at, new = at[order][~alone], new[~alone]
    if not len(at):
        return at, at, at
    context = np.searchsorted(base, at, "right") - 1
    offset = at - base[context]
    tied, inverse = np.unique(context, return_inverse=True)
    base, padded, eights = _block([contexts[c] for c in tied.tolist()], length)
    at = base[inverse] + offset
    end = len(padded) - length - 16 - PREFIX
    at = _resolve(at, new, sample_ranks(padded, eights[: end + PREFIX]))
    differ = np.zeros(len(at) - 1, bool)
    for k in (*range(0, length - 8, 8), length - 8):
        differ |= eights[at[1:] + k] != eights[at[:-1] + k]
    place = np.searchsorted(base, at, "right") - 1
    return tied[place], at - base[place], np.cumsum(np.concatenate(([True], differ))) - 1


def resolve(key, mark, start, count, many, contexts, bucket):
    """Spans of all windows but the earliest of each class, block by block."""
    size = np.fromiter((len(c) for c in contexts), np.int64, len(contexts))
    out = []
    for a, b in repeats.blocks_of(bucket, size, BLOCK):
        context, offset, group = equal_windows(contexts[a:b], count[a:b])
        if not len(context):
            continue
        row = context + a
        place = start[row] + offset
        order = np.lexsort((place, mark[row], key[row], group))
        later = np.concatenate(([False], group[order][1:] == group[order][:-1]))
        pick = order[later]
        out.append((key[row[pick]], mark[row[pick]], place[pick], place[pick] + LENGTH))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 4))


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, data, starts, sizes = common.flat(texts, b"")
    return common.byte_values(data), np.concatenate((starts, [len(data)]))


def _context(text: bytes, starts: list[int], stops: list[int]) -> list[bytes]:
    return [text[a:b] for a, b in zip(starts, stops, strict=True)]


def removable(docs: DataFrame) -> DataFrame:
    """Keyed documents with the spans of bytes to remove (see repeats.keyed for their order).

    A null text is empty and has none, as has one shorter than LENGTH. Columns
    other than doc_id and text are not read. An empty table gives none.
    """
    rows = repeats.keyed(docs)
    return repeats.with_spans(rows, repeats.find(rows, _units, _context, resolve, LENGTH, GRAM, keep_first=True))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of text without the spans, which are in order and apart."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def remove(docs: DataFrame) -> DataFrame:
    """doc_id and kept binary: each text's bytes without those that repeat earlier ones."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in common.pieces(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            kept = [cut(t, repeats.united(s)) for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary())], schema.names)

    return removable(docs).select("doc_id", "text", "spans").mapInArrow(run, schema)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["n_bytes", "n_removed", "n_spans"]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in names), T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for batch in common.pieces(batches, "text"):
            rows: list[tuple] = []
            for text, listed in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                spans = repeats.united(listed)
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut(text, spans)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], schema.names)

    return removable(docs).select("doc_id", "text", "spans").mapInArrow(run, schema)


OP3_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT r, doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS s FROM (SELECT r, doc_id, h, unnest(range(greatest(length(h) // 2 - {LENGTH} + 1, 0))) AS i FROM d)
), later AS (
  SELECT r, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, r, i) > 1
), runs AS (
  SELECT r, min(i) AS a, max(i) + {LENGTH} AS b
  FROM (SELECT r, i, sum(CASE WHEN i - before <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM later)) GROUP BY r, run
), kept AS (
  SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS tail, string_agg(substr(h, 2 * until_ + 1, 2 * (a - until_)), '' ORDER BY a) AS head
  FROM (SELECT runs.*, h, coalesce(lag(b) OVER (PARTITION BY runs.r ORDER BY a), 0) AS until_ FROM runs JOIN d USING (r)) GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
