"""Exact repeated windows across a corpus: what operators 3 and 7 have in common.

A window is `length` consecutive units (bytes or words) of one document. Most
windows of a corpus occur once; sorting all their suffixes would move the corpus
many times over. So suffixes are first put into buckets by content: a window's
anchor is the gram of `gram` units inside it with the least hash (the first of
equals). Equal windows have equal anchors at equal offsets, so equal windows
always meet in one bucket. Consecutive windows with one anchor form a run; its
units, from the first window's beginning to the last one's end, are its context.

1. Map: every document's runs, as (anchor, hash of the context, place). Runs
   with equal contexts in one flush are folded into the first of them. Anchors
   are told apart by 63 bits: least hashes crowd at the low end, so that with
   32 bits many runs of 6 GB of text shared a bucket by chance.
2. Reduce by anchor: contexts that occur once in a bucket of one are done, as
   are repeats of a whole context. Of each other bucket the first run of every
   different context is asked for; these representatives stand for the rest.
3. Texts of the runs asked for are fetched by a join, and the operator's own
   suffix structure, over one memory-sized block of buckets at a time, decides
   which of their windows are equal.
4. Spans are gathered by document.

A bucket with more than HOT different contexts, as one passage before very many
different texts has, is split further: each of its windows is a bucket of its own
content, folded over a flush, so no group of step 3 has more than HOT contexts or
one row for each flush.

Everything is exact but for 64-bit hashes of contexts within a bucket. A gram or
line that stands in a third of all documents costs one row per flush and
different context. Texts are shuffled twice, runs once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

#: Text that one flush of the map covers: runs with equal contexts in it are folded.
FLUSH = 16 << 20
#: Different contexts of a bucket beyond which its windows are told apart one by one, and how many are held for that.
HOT = 2048
HELD = 100_000
_PLACE = np.uint64((1 << 28) - 1)

_RUN = [("anchor", np.uint64), ("context", np.uint64), ("key", np.int64), ("mark", np.int64), ("start", np.int32), ("count", np.uint16), ("offset", np.uint16), ("many", np.uint8)]
SPAN = "key long, mark long, start int, stop int"
_FOUND = f"{SPAN}, bucket long, count int, many int, apart boolean"

Runs = dict[str, np.ndarray]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), and the pair that tells documents apart and orders them.

    Documents are ordered by doc_id, null first; rows with one id and different
    texts are different documents, in the order of a hash of the text. Rows that
    agree in both are one document, and get equal results.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(text).alias("mark"))


def runs(codes: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, Runs]:
    """(document, run columns without key and mark) of the documents codes[first[d]:first[d + 1]]."""
    windows = np.maximum(0, np.diff(first) - length + 1)
    if not windows.any():
        empty = {name: np.zeros(0, kind) for name, kind in _RUN if name not in ("key", "mark", "many")}
        return np.zeros(0, np.int64), empty
    roll = common.Rolling(codes)
    grams = roll.grams(gram)
    places = np.arange(len(grams), dtype=np.uint64)
    least = common.sliding_min((grams & ~_PLACE) | (places & _PLACE), length - gram + 1)
    start = common.ranges(first[:-1], windows)
    # The place is stored modulo 2**28; it lies within a window of its start.
    anchor = start + ((least[start].astype(np.int64) - start) & int(_PLACE))
    opens = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.concatenate((opens, [len(start)])))
    begin, anchor = start[opens], anchor[opens]
    doc = np.searchsorted(first, begin, "right") - 1
    # Empty documents share a beginning with the next one; take the last that begins there.
    offset = anchor - begin
    context = roll.slices(begin, begin + count + length - 1)
    context = common.mix(context + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return doc, {"anchor": grams[anchor] >> np.uint64(1), "context": context, "start": (begin - first[doc]).astype(np.int32), "count": count.astype(np.uint16), "offset": offset.astype(np.uint16)}


def _folded(r: Runs, keep_first: bool, length: int) -> tuple[Runs, tuple[np.ndarray, ...]]:
    """One run for each context, the first by (key, mark, start), and the spans known to repeat.

    many marks contexts with more than one place. With keep_first a context's
    first place stays and the others repeat; without, all places repeat.
    """
    order = np.lexsort((r["start"], r["mark"], r["key"], r["context"]))
    r = {k: v[order] for k, v in r.items()}
    if not len(order):
        return r, (r["key"], r["mark"], r["start"].astype(np.int64), r["start"].astype(np.int64))
    same = r["context"][1:] == r["context"][:-1]
    again = same & (r["key"][1:] == r["key"][:-1]) & (r["mark"][1:] == r["mark"][:-1]) & (r["start"][1:] == r["start"][:-1])
    if again.any():  # one document, from rows that agree
        stay = np.concatenate(([True], ~again))
        many = np.maximum.reduceat(r["many"], np.flatnonzero(stay))
        r = {k: v[stay] for k, v in r.items()} | {"many": many}
        same = r["context"][1:] == r["context"][:-1]
    head = np.concatenate(([True], ~same))
    first = np.flatnonzero(head)
    many = np.maximum(np.maximum.reduceat(r["many"], first), (np.diff(np.concatenate((first, [len(head)]))) > 1).astype(np.uint8))
    repeated = ~head if keep_first else many[np.cumsum(head) - 1].astype(bool)
    start = r["start"][repeated].astype(np.int64)
    spans = (r["key"][repeated], r["mark"][repeated], start, start + r["count"][repeated] + (length - 1))
    return {k: v[first] for k, v in r.items()} | {"many": many}, spans


def joined(key: np.ndarray, mark: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans united within each document."""
    if not len(key):
        return key, mark, start, stop
    order = np.lexsort((mark, key))
    k, m = key[order], mark[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])))
    doc = np.cumsum(new) - 1
    d, a, b = common.merged(doc, start[order].astype(np.int64), stop[order].astype(np.int64))
    head = np.flatnonzero(new)
    return k[head][d], m[head][d], a, b


def _pack(r: Runs, rows: np.ndarray) -> bytes:
    return b"".join(r[name][rows].astype(kind).tobytes() for name, kind in _RUN)


def _unpack(blobs: list[bytes]) -> Runs:
    width = sum(np.dtype(kind).itemsize for _, kind in _RUN)
    columns: dict[str, list] = {name: [] for name, _ in _RUN}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for name, kind in _RUN:
            columns[name].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(columns[name]) if blobs else np.zeros(0, kind) for name, kind in _RUN}


def _span_rows(spans: tuple[np.ndarray, ...]) -> pa.Table:
    key, mark, start, stop = spans
    return pa.table({"key": pa.array(key, pa.int64()), "mark": pa.array(mark, pa.int64()), "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32())})


def find(docs: DataFrame, units: Callable, context: Callable, resolve: Callable, length: int, gram: int, keep_first: bool) -> DataFrame:
    """Repeated spans, in units, of keyed documents: (key, mark, start, stop); they may overlap.

    units(texts) gives (codes, first): the units' hashes and where each document
    begins. context(text, starts, stops) gives the bytes of runs of one document.
    resolve(keys, marks, starts, counts, many, contexts, buckets) gives the spans
    of the windows that repeat among the contexts, a table of SPAN's columns.
    """
    spark = docs.sparkSession
    parts = common.tasks(docs)
    common.small_batches(spark)

    def collect(batches):
        held: list[Runs] = []
        size = 0

        def flush():
            r = {name: np.concatenate([h[name] for h in held]) for name, _ in _RUN}
            r, spans = _folded(r, keep_first, length)
            out_part, out_blob = [], []
            part = r["anchor"] % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                if ends[p] < ends[p + 1]:
                    out_part.append(p)
                    out_blob.append(_pack(r, order[ends[p] : ends[p + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array([0] * len(out_part), pa.int8()), pa.array(out_blob, pa.binary())], ["part", "kind", "blob"])
            key, mark, start, stop = joined(*spans)
            for p, at in enumerate(range(0, len(key), 100_000)):
                blob = b"".join(x[at : at + 100_000].astype(np.int64).tobytes() for x in (key, mark, start, stop))
                yield pa.RecordBatch.from_arrays([pa.array([int(key[at]) % parts], pa.int32()), pa.array([1], pa.int8()), pa.array([blob], pa.binary())], ["part", "kind", "blob"])

        for batch in common.pieces(batches, "text"):
            codes, first = units(batch.column("text"))
            doc, r = runs(codes, first, length, gram)
            r["key"] = batch.column("key").to_numpy()[doc]
            r["mark"] = batch.column("mark").to_numpy()[doc]
            r["many"] = np.zeros(len(doc), np.uint8)
            held.append(r)
            size += int(common.lengths(batch.column("text")).sum())
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def compare(rows: pa.Table) -> pa.Table:
        kind, blobs = rows.column("kind").to_numpy(), rows.column("blob").to_pylist()
        sure = [np.frombuffer(b, np.int64).reshape(4, -1) for b, k in zip(blobs, kind, strict=True) if k]
        r, spans = _folded(_unpack([b for b, k in zip(blobs, kind, strict=True) if not k]), keep_first, length)
        key, mark, start, stop = (np.concatenate([s, *(x[i] for x in sure)]) for i, s in enumerate(spans))
        key, mark, start, stop = joined(key, mark, start, stop)
        # Buckets with several contexts; where all places repeat, only those with a context not known to.
        order = np.argsort(r["anchor"], kind="stable")
        anchor = r["anchor"][order]
        head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((head, [len(anchor)])))
        open_ = size > 1
        if not keep_first and len(head):
            open_ &= np.minimum.reduceat(r["many"][order], head) == 0
        asked = order[np.repeat(open_, size)]
        apart = np.repeat(size > HOT, size)[np.repeat(open_, size)]
        ask = {k: v[asked] for k, v in r.items()}
        n, m = len(key), len(asked)
        start_all = np.concatenate((start, ask["start"]))
        return pa.table(
            {
                "key": pa.array(np.concatenate((key, ask["key"])), pa.int64()),
                "mark": pa.array(np.concatenate((mark, ask["mark"])), pa.int64()),
                "start": pa.array(start_all, pa.int32()),
                "stop": pa.array(np.concatenate((stop, ask["start"].astype(np.int64) + ask["count"] + (length - 1))), pa.int32()),
                "bucket": pa.array(np.concatenate((np.full(n, -1), ask["anchor"].astype(np.int64))), pa.int64()),
                "count": pa.array(np.concatenate((np.zeros(n, np.int32), ask["count"])), pa.int32()),
                "many": pa.array(np.concatenate((np.zeros(n, np.int32), ask["many"])), pa.int32()),
                "apart": pa.array(np.concatenate((np.zeros(n, bool), apart))),
            }
        )

    blobs = docs.select("text", "key", "mark").mapInArrow(collect, "part int, kind byte, blob binary")
    found = common.written(blobs.groupBy("part").applyInArrow(compare, _FOUND), "repeats")
    sure = found.where("bucket < 0").select("key", "mark", "start", "stop")
    asked = found.where("bucket >= 0").groupBy("key", "mark").agg(F.collect_list(F.struct("start", "stop", "bucket", "count", "many", "apart")).alias("asked"))
    blocks = 4 * parts

    def told(columns: dict[str, np.ndarray], contexts: list[bytes]) -> pa.RecordBatch:
        block = common.mix(columns["bucket"].astype(np.uint64)) % np.uint64(blocks)
        named = [(c, pa.array(columns[c], kind)) for c, kind in (("key", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("bucket", pa.int64()), ("count", pa.int32()), ("many", pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32(), safe=False), *(x for _, x in named), pa.array(contexts, pa.binary())], ["block", *(c for c, _ in named), "context"])

    def windows(held: list[tuple[dict[str, np.ndarray], list[bytes]]]):
        """Windows of split buckets, each in the bucket of its content: one of those that agree, and the spans of the others (bucket -1)."""
        columns = {c: np.concatenate([h[c] for h, _ in held]) for c in ("key", "mark", "start", "bucket")}
        contexts = [c for _, listed in held for c in listed]
        _, data, begin, size = common.flat(pa.array(contexts, pa.binary()))
        name = common.Rolling(common.byte_values(data)).slices(begin, begin + size)
        name = (common.mix(name ^ columns["bucket"].astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        order = np.lexsort((columns["start"], columns["mark"], columns["key"], name))
        columns, name = {c: v[order] for c, v in columns.items()}, name[order]
        head = np.concatenate(([True], name[1:] != name[:-1]))
        many = np.diff(np.concatenate((np.flatnonzero(head), [len(name)]))) > 1
        again = ~head if keep_first else many[np.cumsum(head) - 1]
        start = columns["start"][again].astype(np.int64)
        key, mark, start, stop = joined(columns["key"][again], columns["mark"][again], start, start + length)
        ones = np.ones(len(key), np.int64)
        yield told({"key": key, "mark": mark, "start": start, "bucket": -ones, "count": stop - start, "many": 0 * ones}, [b""] * len(key))
        first = {c: v[head] for c, v in columns.items()} | {"bucket": name[head], "count": np.ones(len(many), np.int64), "many": many.astype(np.int64)}
        yield told(first, [contexts[i] for i in order[head].tolist()])

    def fetch(batches):
        held, rows_held = [], 0
        for batch in common.pieces(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            lists = batch.column("asked")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            inner = lists.flatten()
            fields = {c: inner.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop", "bucket", "count", "many", "apart")}
            row = np.repeat(np.arange(len(texts)), sizes)
            place = {c: batch.column(c).to_numpy()[row] for c in ("key", "mark")}
            for apart in (False, True):
                take = np.flatnonzero(fields["apart"] == apart)
                if not len(take):
                    continue
                start, stop, of = fields["start"][take].astype(np.int64), fields["stop"][take].astype(np.int64), row[take]
                if apart:  # every window by itself
                    count = fields["count"][take].astype(np.int64)
                    start = common.ranges(start, count)
                    take, of, stop = np.repeat(take, count), np.repeat(of, count), start + length
                columns = {c: place[c][take] for c in ("key", "mark")} | {"start": start} | {c: fields[c][take] for c in ("bucket", "count", "many")}
                contexts: list[bytes] = []
                ends = np.searchsorted(of, np.arange(len(texts) + 1))
                for text, x, y in zip(texts, ends.tolist(), ends[1:].tolist(), strict=False):
                    if x < y:
                        contexts += context(text, start[x:y].tolist(), stop[x:y].tolist())
                if not apart:
                    yield told(columns, contexts)
                    continue
                held.append((columns, contexts))
                rows_held += len(contexts)
                if rows_held >= HELD:
                    yield from windows(held)
                    held, rows_held = [], 0
        if held:
            yield from windows(held)

    def decide(rows: pa.Table) -> pa.Table:
        place = [rows.column(c).to_numpy() for c in ("start", "mark", "key", "bucket")]
        order = np.lexsort(place)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for x in place:
            new[1:] |= x[order][1:] != x[order][:-1]
        order = order[new]  # rows that agree bring each place once
        bucket = place[-1]
        number = lambda c: rows.column(c).to_numpy()[order]
        sure_, order = order[bucket[order] < 0], order[bucket[order] >= 0]
        known = [rows.column(c).to_numpy()[sure_] for c in ("key", "mark", "start", "count")]
        contexts = rows.column("context").take(pa.array(order)).to_pylist()
        found = resolve(number("key"), number("mark"), number("start").astype(np.int64), number("count").astype(np.int64), number("many"), contexts, bucket[order])
        spans = known[0], known[1], known[2].astype(np.int64), known[2].astype(np.int64) + known[3]
        return _span_rows(joined(*(np.concatenate(x) for x in zip(spans, found, strict=True))))

    # All columns of docs, so that with_spans joins the same exchange of the texts.
    fetched = docs.join(asked, ["key", "mark"]).mapInArrow(fetch, "block int, key long, mark long, start int, bucket long, count int, many int, context binary")
    return sure.unionByName(fetched.groupBy("block").applyInArrow(decide, SPAN))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Keyed documents with the array spans of (start, stop), null where there are none."""
    listed = spans.groupBy("key", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.join(listed, ["key", "mark"], "left")


def united(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans of one document in order, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def blocks_of(buckets: np.ndarray, sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive rows cut into blocks of whole buckets with about `limit` in total."""
    out, at, total = [], 0, 0
    ends = np.flatnonzero(np.concatenate((buckets[1:] != buckets[:-1], [True]))) + 1 if len(buckets) else []
    sums = np.concatenate(([0], np.cumsum(sizes)))
    for end in ends:
        total = int(sums[end] - sums[at])
        if total >= limit:
            out.append((at, int(end)))
            at = int(end)
    if at < len(buckets):
        out.append((at, len(buckets)))
    return out
