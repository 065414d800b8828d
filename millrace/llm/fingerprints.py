"""Document fingerprints (operator 6): improbable-feature digests.

Every window of WINDOW bytes has the entropy of its bytes. Texts have most
windows near one entropy, so the further from it, the rarer a window. Among each
SPREAD consecutive windows the rarest (the first of equals) gets a vote; windows
with VOTES or more are a document's features. They go, by position, into a chain
of Bloom filters of BITS bits with at most LOAD features each. Two fingerprints
are compared filter by filter: bits in common, less what chance gives, over the
most there could be.

Scale: a document's next one by id is found by one shuffle of the texts into
ranges of ids, twice as many as shuffle partitions and a task each, sorted within
each; the first document of each range is sent to the range before as well. The
driver sees one id for each range.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common

WINDOW = 64
SPREAD = 64
VOTES = 16
BITS = 2048
LOAD = 160
PROBES = 5
#: Entropy, in bits, where windows are commonest, and below which a window says too little. Fixed rather than learnt,
#: so that fingerprints of different corpora compare; in the prose, web pages, conversations and questions at hand
#: half of the windows have more than 3.7 to 3.9 bits, and one in twenty less than 3.4 or more than 4.1 to 4.5.
COMMON = 3.75
LEAST = 1.0
CHUNK = 1 << 20
_N = np.arange(WINDOW + 1, dtype=np.float64)
#: n log2 n in units of 2**-16: whole numbers, so that sums do not depend on what came before.
_NLOGN = np.rint(_N * np.log2(np.maximum(_N, 1)) * 65536).astype(np.int64)
_GAIN = np.concatenate(([0], np.diff(_NLOGN)))
_FAR = np.uint64(1) << np.uint64(62)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy in bits of each WINDOW consecutive bytes of data.

    Moving a window by one byte changes the count of the byte that leaves and of
    the one that comes. Both counts are numbers of equal bytes within WINDOW
    places, read off from the places sorted by byte.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0)
    order = np.argsort(data, kind="stable")
    key = (data[order].astype(np.int64) << 40) + order
    rank = np.arange(n)
    ahead = np.empty(n, np.int32)
    behind = np.empty(n, np.int32)
    ahead[order] = np.searchsorted(key, key + (WINDOW - 1), "right") - rank
    behind[order] = rank + 1 - np.searchsorted(key, key - (WINDOW - 1), "left")
    first = _NLOGN[np.bincount(data[:WINDOW])].sum()
    step = _GAIN[behind[WINDOW:]] - _GAIN[ahead[: n - WINDOW]]
    total = np.concatenate(([first], first + np.cumsum(step)))
    return np.log2(WINDOW) - total / (WINDOW * 65536)


def rarity(entropy: np.ndarray) -> np.ndarray:
    """Order of windows, 0 to 1023, the rarest first; 1023 for those with too little in them."""
    away = np.abs(entropy - COMMON)
    rank = np.clip(1000 - away * 250, 0, 1000).astype(np.uint64)
    rank[entropy < LEAST] = 1023
    return rank


def features(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every feature, by place. data: documents with one gap byte after each.

    A document shorter than a window has one feature, all of its bytes; an empty
    one none. If no window has votes enough, the rarest of the first ones stands in.
    """
    n = len(data)
    roll = common.Rolling(common.byte_values(data))
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    docs, places = [short], [starts[short]]
    hashes = [roll.slices(starts[short], starts[short] + sizes[short])]
    long = np.flatnonzero(sizes >= WINDOW)
    if len(long):
        key = np.full(n + SPREAD, _FAR)
        entropy = entropies(data)
        key[: len(entropy)] = (rarity(entropy) << np.uint64(32)) | np.arange(len(entropy), dtype=np.uint64)
        windows = sizes[long] - WINDOW + 1
        inside = np.zeros(n + SPREAD + 1, np.int8)
        inside[starts[long]] += 1
        inside[starts[long] + windows] -= 1
        key[np.cumsum(inside[:-1]) == 0] = _FAR
        chosen = common.sliding_min(key, SPREAD)
        groups = np.maximum(1, windows - SPREAD + 1)
        at = common.ranges(starts[long], groups)
        votes = np.bincount((chosen[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=n)
        popular = votes >= VOTES
        total = np.concatenate(([0], np.cumsum(popular)))
        none = total[starts[long] + windows] == total[starts[long]]
        popular[(chosen[starts[long][none]] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
        place = np.flatnonzero(popular)
        docs.append(np.searchsorted(starts, place, "right") - 1)
        places.append(place)
        hashes.append(roll.slices(place, place + WINDOW))
    doc, place, code = np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)
    order = np.lexsort((place, code, doc))  # each feature of a document once, at its first place
    doc, place, code = doc[order], place[order], code[order]
    once = np.concatenate(([True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))) if len(doc) else np.zeros(0, bool)
    doc, place, code = doc[once], place[once], code[once]
    order = np.lexsort((place, doc))
    return doc[order], code[order]


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its filters, as rows of BITS / 8 bytes."""
    if not texts:
        return []
    _, data, starts, sizes = common.flat(pa.array(texts, pa.binary()))
    doc, code = features(data, starts, sizes)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    filters = -(-count // LOAD)
    base = np.cumsum(filters) - filters
    row = base[doc] + (np.arange(len(doc)) - first[doc]) // LOAD
    bits = np.zeros((int(filters.sum()), BITS), np.uint8)
    for probe in range(PROBES):
        bits[row, ((code >> np.uint64(11 * probe)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1) if len(bits) else np.zeros((0, BITS // 8), np.uint8)
    return [packed[b : b + k] for b, k in zip(base, filters, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean, over the shorter chain's filters, of the best overlap in the other chain.

    Two empty chains are alike (1), an empty and another are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    in_a, in_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for row, ones in zip(a, in_a, strict=True):
        both = np.bitwise_count(row[None] & b).sum(1, dtype=np.int64)
        chance = ones * in_b / BITS
        most = np.minimum(ones, in_b)
        total += float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(a)


def told(filters: np.ndarray) -> str:
    """A fingerprint as text: the filters in order, in base64; "" for an empty text."""
    return base64.b64encode(filters.tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    """The filters of told()."""
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each whole text; null as empty."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.StringType())])

    def run(batches):
        for batch in common.pieces(batches, "text", CHUNK):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([told(d) for d in digests(texts)], pa.string())], schema.names)

    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _at_most(cuts: list[int], key: Column, strictly: bool) -> Column:
    """How many of the sorted cuts are at most the key (or below it): two searches of the root of their number."""
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    before = (lambda c: c < key) if strictly else (lambda c: c <= key)
    passed = F.size(F.filter(longs(g[-1] for g in groups), before))
    inside = F.try_element_at(F.array(*map(longs, groups)), passed + 1)
    return F.least(passed * step, F.lit(len(cuts))) + F.coalesce(F.size(F.filter(inside, before)), F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows sorted by (_range, _tail, _key, _mark, text) within partitions, each range a partition of its own.

    A range's rows are its documents in ascending order, then (_tail = 1) the
    document after its last: the first of the next range, or of all. An id that
    many rows share fills several ranges, by the hash of the text.
    """
    n = 2 * common.tasks(docs)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("_key"),
        F.xxhash64(text).alias("_mark"),
    )
    cuts = sorted(keyed.select(F.percentile_approx("_key", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("cuts")).first()["cuts"] or [])
    if cuts:
        below, upto = _at_most(cuts, F.col("_key"), True), _at_most(cuts, F.col("_key"), False)
        keyed = keyed.withColumns({"_below": below, "_same": upto - below})
        place = F.floor((F.shiftrightunsigned("_mark", 1).cast("double") / F.lit(2.0**63)) * F.col("_same"))
        spread = F.col("_below") + F.when(F.col("_same") > 1, 1 + F.least(place, F.col("_same") - 1)).otherwise(F.col("_same"))
        keyed = keyed.withColumn("_range", spread.cast("int")).drop("_below", "_same")
    else:
        keyed = keyed.withColumn("_range", F.lit(0))
    # The marks' order is that of their bits without a sign, as the ranges have it.
    keyed = keyed.withColumn("_mark", F.col("_mark").bitwiseXOR(F.lit(-(1 << 63))))
    firsts = keyed.groupBy("_range").agg(F.min(F.struct("_key", "_mark")).alias("first")).orderBy("_range").collect()
    own = F.struct(F.col("_range"), F.lit(0).alias("_tail"))
    if firsts:
        first: list = [None] * (len(cuts) + 1)
        for k, r in enumerate(firsts):
            first[r["_range"]] = (r["first"]["_key"], r["first"]["_mark"], firsts[k - 1]["_range"])
        told = [F.element_at(F.array(*(F.lit(f and f[i]).cast("long") for f in first)), F.col("_range") + 1) for i in range(3)]
        before = F.when((told[0] == F.col("_key")) & (told[1] == F.col("_mark")), F.struct(told[2].cast("int").alias("_range"), F.lit(1).alias("_tail")))
        keyed = keyed.withColumn("_at", F.explode(F.array_compact(F.array(own, before))))
    else:
        keyed = keyed.withColumn("_at", own)
    return (
        keyed.select("doc_id", "text", "_key", "_mark", F.col("_at._range").alias("_range"), F.col("_at._tail").alias("_tail"))
        .repartitionById(len(cuts) + 1, "_range")
        .sortWithinPartitions("_range", "_tail", "_key", "_mark", "text")
    )


def against_edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside its edited text's and the next document's.

    The edited text has its last half replaced by as much of the next document's
    beginning; the document after the last is the first, which for a single
    document is itself. Documents are ordered by doc_id, null first, then by a
    hash of the text: rows that repeat an id follow one another. Null and empty
    texts have an empty fingerprint. An empty table gives an empty result. Other
    columns are not read.
    """
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *map(T.StructField, names, kinds)])

    def run(batches):
        import hashlib

        ids: list = []
        texts: list[str] = []
        ranges: list[tuple[int, int]] = []

        def rows():
            # All rows but the last have their next one; tails, and whatever follows a tail of its range, are no documents.
            take = [i for i in range(len(ids) - 1) if not ranges[i][1]]
            if take:
                edited = []
                for i in take:
                    half = len(texts[i]) // 2
                    edited.append((texts[i][: len(texts[i]) - half] + texts[i + 1][:half]).encode("utf-8", "replace"))
                need = sorted({*take, *(i + 1 for i in take)})
                own = dict(zip(need, digests([texts[i].encode("utf-8", "replace") for i in need]), strict=True))
                other = digests(edited)
                columns = [
                    pa.array([ids[i] for i in take], pa.int64()),
                    pa.array([len(texts[i]) for i in take], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([told(own[i]) for i in take]),
                    pa.array([told(e) for e in other]),
                    pa.array([likeness(own[i], e) for i, e in zip(take, other, strict=True)], pa.float64()),
                    pa.array([likeness(own[i], own[i + 1]) for i in take], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
            del ids[:-1], texts[:-1], ranges[:-1]

        for batch in common.pieces(batches, "text", CHUNK):
            ids += batch.column("doc_id").to_pylist()
            texts += [(x or b"").decode("utf-8", "replace") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            ranges += zip(batch.column("_range").to_pylist(), batch.column("_tail").to_pylist(), strict=True)
            yield from rows()

    common.small_batches(docs.sparkSession)
    return with_next(docs).select("doc_id", "text", "_range", "_tail").mapInArrow(run, schema)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return against_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
