"""MinHash near-dedup with odd sketches (operator 2).

Documents are sets of word shingles; two are linked if 100 * |A and B| is at
least `percent` * |A or B|. Each set has HASHES MinHash samples, which serve
twice: in bands of ROWS they give candidates (at similarity 0.8 all bands miss
with probability 5e-8), and folded into a parity bitmap, the odd sketch, they
give an estimate: the population count of two sketches' exclusive or tells how
many samples differ, most precisely where few do. Candidates whose sketches
differ too much for the threshold (by five standard deviations) are dropped,
the others are confirmed on the full sets.

Equal sets are one class, so copies cost one row. Links are needed for
components only, so no bucket emits all its pairs: first every member is
compared with a few of them; then, in buckets that still hold several
components, members outside the commonest one with those of other components,
by finer sketches first and by a bitmap of whole sets, whose exclusive or never
has more bits than elements that differ. Where more than CROWD members are
outside, they first meet a few hubs of their buckets, the members that are in
the largest buckets: of copies edited each in its own place, most are near to
those. Who stays outside, as in a family of texts made from one template, meets
others over shingles instead of the bucket: in the order of their frequency,
rarest first, two sets that are linked share a shingle among the first few of
both. That rules out no link, whatever the sizes. No link between components
is left.

Scale: texts are read twice and never shuffled whole. Sets are sent only for
classes in some candidate pair, told by a bitmap of fixed size (a false hit
costs a row, no result). Buckets and classes with a third of all rows meet only
in partial aggregates and in joins that adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common, graph

WORDS = 5
PERCENT = 80
#: Samples that make the bands, and rows of a band.
HASHES, ROWS = 128, 4
#: Samples folded into a sketch, and its bits.
FOLDED, SKETCH = 256, 1024
#: The same of the finer sketches that members of buckets with several components get.
FINE, FINE_SKETCH = 1024, 4096
#: Bits of a whole set's parity bitmap.
WHOLE = 4096
#: Members of each bucket that may be its centres, and how many of those it meets
#: in all its buckets (bands times CENTRES at most) a class is compared with at
#: first: the LEAST least and DEALT by a hash. The rest is for the second step.
CENTRES, LEAST, DEALT = 3, 2, 4
#: Members outside a bucket's commonest component that meet all its members there.
CROWD = 64
#: Hubs of a bucket, in its commonest component and outside, and those that a member
#: outside meets at most. The rest is for the steps that follow.
HUBS, MET = 4, 8
#: Shingles whose counts order the others (4 MB of broadcast), and those counted at once in a task.
RANKED, COUNTED = 1 << 18, 1 << 21
#: Rarer shingles that a row of a prefix names at most, so that a pair which shares one of them meets there only.
RARER = 32
#: Standard deviations allowed for when a sketch rules a pair out.
DEVIATIONS = 5
#: Bits of the broadcast bitmap (4 MB).
BITMAP = 1 << 25

_random = np.random.default_rng(20)
_XOR = _random.integers(0, 1 << 32, FINE, dtype=np.uint32)
_TIMES = _random.integers(0, 1 << 31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's distinct shingles, sorted, one text after another.

    A shingle is `words` consecutive words with A-Z lower-cased; fewer words are
    one shingle together; no words, none.
    """
    _, data, starts, _ = common.flat(texts)
    begin, end = common.word_spans(data)
    first = common.word_docs(begin, starts)
    count = np.diff(first)
    grams = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    at = common.ranges(first[:-1], grams)
    doc = np.repeat(np.arange(len(count)), grams)
    codes = common.Rolling(common.word_hashes(data, begin, end, lower=True)).slices(at, np.minimum(at + words, first[1:][doc]))
    order = np.lexsort((codes, doc))
    codes, doc = codes[order], doc[order]
    new = np.concatenate(([True], (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])))[: len(codes)]
    codes, doc = codes[new], doc[new]
    return codes, np.searchsorted(doc, np.arange(len(count) + 1))


def classes(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set; the empty set's is 0."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mix(codes ^ np.uint64(0x5851F42D4C957F2D)))))
    count = np.diff(first).astype(np.uint64)
    name = common.mix((total[first[1:]] - total[first[:-1]]) ^ (count * np.uint64(0x9E3779B97F4A7C15)))
    return np.where(count > 0, name, 0).astype(np.uint64).view(np.int64)


def samples(codes: np.ndarray, first: np.ndarray, hashes: int = FOLDED) -> np.ndarray:
    """MinHash samples of each nonempty set, a row each."""
    starts = first[:-1][np.diff(first) > 0]
    short = (codes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), hashes), np.uint32)
    turned = np.empty_like(short)
    for i in range(hashes):
        np.bitwise_xor(short, _XOR[i], out=turned)
        np.multiply(turned, _TIMES[i], out=turned)
        out[:, i] = np.minimum.reduceat(turned, starts) if len(starts) else 0
    return out


def _named(sample: np.ndarray, salt: int) -> np.ndarray:
    """Samples as 64-bit elements that differ by position."""
    place = np.arange(sample.shape[1], dtype=np.uint64) << np.uint64(40)
    return common.mix(sample.astype(np.uint64) + place + np.uint64(salt << 52))


def bands(sample: np.ndarray) -> np.ndarray:
    """Bucket names from the first HASHES samples: HASHES / ROWS for each row."""
    named = _named(sample[:, :HASHES], 1).reshape(len(sample), HASHES // ROWS, ROWS)
    out = named[:, :, 0].copy()
    for k in range(1, ROWS):
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + named[:, :, k])
    return out.view(np.int64)


def odd_sketches(sample: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Parity bits for each row of samples, as numbers of 64 bits."""
    bit = (_named(sample, 2) % np.uint64(bits)).astype(np.int64)
    flat = (np.arange(len(sample))[:, None] * bits + bit).ravel()
    odd = (np.bincount(flat, minlength=len(sample) * bits) & 1).astype(np.uint8).reshape(len(sample), bits)
    return np.packbits(odd, axis=1).view(np.int64).reshape(len(sample), bits // 64)


def most_odd(percent: int, hashes: int = FOLDED, bits: int = SKETCH) -> int:
    """Bits in which two sketches may differ at a similarity of percent / 100.

    The samples that differ are binomial, each such pair of samples turns two
    bits, and turned bits that meet cancel: mean and variance of both steps,
    and DEVIATIONS standard deviations more.
    """
    similar = percent / 100
    turned = 2 * hashes * (1 - similar)
    once, twice = math.exp(-2 * turned / bits), math.exp(-4 * turned / bits)
    variance = once**2 * 4 * hashes * similar * (1 - similar) + bits / 4 * (1 - twice) - turned * twice
    return min(bits, math.ceil(bits / 2 * (1 - once) + DEVIATIONS * math.sqrt(variance)))


def _lists(flat: np.ndarray, width: int) -> pa.Array:
    rows = len(flat)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(flat).ravel(), pa.int64()))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, class, n_shingles, sketch and bands (null for empty sets) of each whole text."""

    def run(batches):
        for batch in common.pieces(batches):
            codes, first = shingles(batch.column("text"), words)
            count = np.diff(first)
            some = count > 0
            sample = samples(codes, first)
            row = pa.array(np.where(some, np.cumsum(some) - 1, 0), pa.int32(), mask=~some)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(classes(codes, first), pa.int64()),
                    pa.array(count, pa.int64()),
                    _lists(odd_sketches(sample), SKETCH // 64).take(row),
                    _lists(bands(sample), HASHES // ROWS).take(row),
                ],
                ["doc_id", "class", "n_shingles", "sketch", "bands"],
            )

    common.small_batches(docs.sparkSession)
    return common.doc_rows(docs).mapInArrow(run, "doc_id long, class long, n_shingles long, sketch array<long>, bands array<long>")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """BITMAP bits, those of the ids' hashes set; the driver gets at most BITMAP / 64 numbers."""
    place = ids.select(F.pmod(F.xxhash64("id"), F.lit(BITMAP)).alias("place"))
    words = place.selectExpr("place div 64 AS word", "shiftleft(1L, cast(place % 64 AS int)) AS bit")
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _first_rows(keys: Iterable) -> np.ndarray:
    """The first row of each key in a batch, in order."""
    seen: dict = {}
    for row, key in enumerate(keys):
        seen.setdefault(key, row)
    return np.fromiter(seen.values(), np.int64, len(seen))


def _wanted(docs: DataFrame, ids: DataFrame, words: int, name: str, make, kind: str = "array<long>") -> DataFrame:
    """(class, name), a row each, of the classes that have documents of these ids, and of a few more: make(codes, first).

    A false hit of the bitmap gives a class that no one asked for; joins by
    class leave it out. Copies are told by size too, so that those joins deal
    the rows anew and adaptive execution can split them.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(ids.select("id")))
    rows = common.doc_rows(docs).withColumn("_place", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)))

    def run(batches):
        for batch in common.pieces(batches):
            place = batch.column("_place").to_numpy()
            hit = (bits.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            codes, first = shingles(batch.column("text"), words) if batch.num_rows else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
            some = np.diff(first) > 0
            if some.any():
                first = np.concatenate((first[:-1][some], first[-1:]))
                named = classes(codes, first)
                made = pa.RecordBatch.from_arrays([pa.array(named), pa.array(np.diff(first)), make(codes, first)], ["class", "size", name])
                yield made.take(pa.array(_first_rows(named.tolist())))

    return rows.mapInArrow(run, f"class long, size long, {name} {kind}").dropDuplicates(["class", "size"]).select("class", name)


def _sets(codes: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(codes.view(np.int64), pa.int64()))


def parities(codes: np.ndarray, first: np.ndarray, bits: int = WHOLE) -> np.ndarray:
    """Parity bits of each whole set, as numbers of 64 bits: every element turns one."""
    rows = len(first) - 1
    bit = (common.mix(codes ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)).astype(np.int64)
    flat = np.repeat(np.arange(rows), np.diff(first)) * bits + bit
    odd = (np.bincount(flat, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(odd, axis=1).view(np.int64).reshape(rows, bits // 64)


_FINER = "struct<odd:array<long>,whole:array<long>>"


def _finer(codes: np.ndarray, first: np.ndarray) -> pa.Array:
    odd = odd_sketches(samples(codes, first, FINE), FINE_SKETCH)
    return pa.StructArray.from_arrays([_lists(odd, FINE_SKETCH // 64), _lists(parities(codes, first), WHOLE // 64)], ["odd", "whole"])


def _differing(sketch: Column, other: Column) -> Column:
    return F.aggregate(F.zip_with(sketch, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _may_link(whole: Column, other: Column, n: Column, m: Column, percent: int) -> Column:
    """False only for pairs that are no link: bits that differ are at most the elements that do."""
    return _differing(whole, other) * (100 + percent) <= (n + m) * (100 - percent)


def _alike(sketch: Column, other: Column, n: Column, m: Column, percent: int, most: int) -> Column:
    """Whether sizes, and sketches that may differ in `most` bits, allow for the similarity."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (_differing(sketch, other) <= most)


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes, with documents id_a and id_b, that are linked by their full sets."""
    ids = pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id")))
    sets = _wanted(docs, ids, words, "set", _sets)
    left = pairs.join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    both = left.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return common.written(both.where(shared * 100 >= (F.size("set_a") + F.size("set_b") - shared) * percent).select("a", "b"), "links")


def _held_often(sets: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(least, shingles in order, how many sets each is in): all shingles in at least `least` sets, at most RANKED of them.

    Sets are counted within tasks, so what most sets of a task share is one row there.
    """

    def run(batches):
        held, size = [], 0

        def counted():
            code, rows = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(rows, pa.int64())], ["shingle", "sets"])

        for batch in batches:
            held.append(batch.column("set").flatten().to_numpy())
            size += len(held[-1])
            if size >= COUNTED:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    each = sets.select("set").mapInArrow(run, "shingle long, sets long").groupBy("shingle").agg(F.sum("sets").alias("sets"))
    each = common.written(each.where("sets > 1"), "held").withColumn("power", F.floor(F.log2("sets")))
    least, total = 1 << 62, 0
    for power, shingles_ in sorted(each.groupBy("power").agg(F.count("*")).collect(), reverse=True):
        total += shingles_
        if total > RANKED:
            break
        least = 1 << power
    often = each.where(F.col("sets") >= least).select("shingle", "sets").toArrow()
    code, rows = often.column("shingle").to_numpy(), often.column("sets").to_numpy()
    order = np.argsort(code)
    return (2 if total <= RANKED else least), code[order], rows[order]


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of sets (b, label, n, set and more), a row each: shingle, pos, short, rarer and the sets' other columns.

    pos counts from 1 in the order of how many sets have a shingle, as far as
    that is among the RANKED largest counts, the others before them by value; any
    order that all sets keep is exact. Those of one set alone are left out of the
    rows where all counts are known. A partner that is no larger shares at
    least percent / 100 of n, one that is no smaller 2 * percent / (100 + percent)
    of it, so the first shingle in common lies in a prefix of the rest and one
    more; short says that it is in the second, shorter one. rarer has the first
    RARER shingles before this one.
    """
    own = [field for field in sets.schema.fields if field.name != "set"]
    schema = T.StructType([*own, *(T.StructField(x, T.LongType()) for x in ("shingle", "pos")), T.StructField("short", T.BooleanType()), T.StructField("rarer", T.ArrayType(T.LongType()))])
    most, names = RARER, [field.name for field in own]
    least, code, rows = _held_often(sets)
    often = sets.sparkSession.sparkContext.broadcast((code, rows))

    def run(batches):
        code, rows = often.value
        for batch in batches:
            listed = batch.column("set")
            n = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            shingle, row = listed.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            held = np.zeros(len(shingle), np.int64)
            if len(code):
                at = np.minimum(np.searchsorted(code, shingle), len(code) - 1)
                held = np.where(code[at] == shingle, rows[at], 0)
            order = np.lexsort((shingle, held, row))
            pos = common.ranges(np.ones(len(n), np.int64), n)
            reach = n - (n * percent + 99) // 100 + 1
            keep = pos <= reach[row]
            if least == 2:
                keep &= held[order] > 0
            row, pos, shingle = row[keep], pos[keep], shingle[order][keep]
            short = pos <= (n - (2 * n * percent + 99 + percent) // (100 + percent) + 1)[row]
            begin = np.searchsorted(row, row)
            before = np.minimum(np.arange(len(row)) - begin, most)
            ends = np.concatenate(([0], np.cumsum(before)))
            rarer = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(shingle[common.ranges(begin, before)], pa.int64()))
            whose = [batch.column(c).take(pa.array(row)) for c in names]
            yield pa.RecordBatch.from_arrays([*whose, pa.array(shingle, pa.int64()), pa.array(pos, pa.int64()), pa.array(short), rarer], schema.names)

    return sets.select(*names, "set").mapInArrow(run, schema)


def _usual(rows: DataFrame, key: str) -> DataFrame:
    """key, usual (its commonest label) and outside (how many rows have another), of keys with several labels."""
    held = rows.groupBy(key, "label").agg(F.count("*").alias("rows"))
    most = held.groupBy(key).agg(F.max(F.struct("rows", "label")).alias("most"), F.sum("rows").alias("all"), F.count("*").alias("labels"))
    return most.where("labels > 1").select(key, F.col("most.label").alias("usual"), (F.col("all") - F.col("most.rows")).alias("outside"))


def _hub_pairs(crowd: DataFrame) -> DataFrame:
    """Pairs (a, b) of members outside their buckets' commonest component and hubs of those buckets.

    crowd has bucket, size, b, label and usual. A hub is the member in the
    largest buckets among those that a hash deals to it.
    """
    weight = crowd.groupBy("b").agg(F.sum("size").alias("weight"))
    at, own = F.pmod(F.xxhash64("b"), F.lit(HUBS)), F.col("label") == F.col("usual")
    first = [F.max(F.when((at == k) & side, F.struct("weight", "b", "label"))) for k in range(HUBS) for side in (own, ~own)]
    hubs = crowd.join(weight, "b").groupBy("bucket").agg(F.array_compact(F.array(*first)).alias("hubs"))
    met = crowd.where(~own).join(hubs, "bucket").groupBy("b", "label").agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("hubs"))
    few = F.slice(F.sort_array(F.filter("hubs", lambda hub: hub["label"] != F.col("label")), asc=False), 1, MET)
    return met.select("b", F.explode(few).alias("hub")).select(F.least("b", "hub.b").alias("a"), F.greatest("b", "hub.b").alias("b")).distinct()


def _rare_pairs(sets: DataFrame, sketches: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels among sets that share a rare shingle where a link's first one may lie, as sketches allow.

    sketches has b and sketch, unless sets have them. A pair meets at the first
    shingle that it shares, as far as the rows name those before.
    """
    found = common.written(prefixes(sets, percent), "prefixes")
    rows = found.join(_usual(found, "shingle").drop("outside"), "shingle")
    rows = common.written(rows if sketches is None else rows.join(sketches, "b"), "prefixes")
    side = lambda c: rows.select("shingle", *(F.col(x).alias(f"{x}_{c}") for x in ("b", "label", "n", "pos", "short", "rarer", "usual", "sketch")))
    large, small = side("x"), side("y").where("short_y")
    sized = ((F.col("n_x") > F.col("n_y")) | (F.col("n_x") == F.col("n_y")) & (F.col("b_x") < F.col("b_y"))) & (F.col("n_y") * 100 >= F.col("n_x") * percent)
    left = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) + 1
    fit = sized & (F.col("label_x") != F.col("label_y")) & (left * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent)
    fit &= ~F.arrays_overlap("rarer_x", "rarer_y")
    fit &= _alike(F.col("sketch_x"), F.col("sketch_y"), F.col("n_x"), F.col("n_y"), percent, most_odd(percent))
    both = [(large.where("label_x <> usual_x"), small), (large.where("label_x = usual_x"), small.where("label_y <> usual_y"))]
    one, two = (x.join(y, "shingle").where(fit).select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")) for x, y in both)
    return one.unionByName(two).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    component_id is the smallest doc_id reachable over links, the row's own
    included; kept says whether that is the row's own. Null, empty and blank
    texts have no shingles, are linked with nothing and kept. Rows that agree
    are linked and get equal results; a null doc_id counts in no minimum unless
    all are null. An empty table gives none. Only doc_id and text are read.
    """
    every, named = _labelled(docs, words, percent)
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    found = named.join(least, "label").select("class", "component_id")
    rows = every.select("doc_id", "n_shingles", "class")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = rows.where("n_shingles > 0").join(found, "class").select("doc_id", "n_shingles", "component_id")
    return alone.unionByName(linked).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component of near duplicates: of the smallest id, any of the rows that repeat it.

    A null id is the largest. Rows without shingles are linked with nothing: one
    of each id stays, and all with null ids. Other columns pass through, whatever
    they are called.
    """
    named = _labelled(docs, words, percent)[1]
    best = named.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "class")).alias("best")).select("best.*")
    class_, id_, row_, best_ = own = [common.unused(n, docs.columns) for n in ("_class", "_id", "_row", "_best")]
    best = common.written(best.select(F.col("class").alias(class_), F.coalesce("id", "class").alias(id_), F.lit(True).alias(best_)), "best")
    names, schema = [F.col(f"`{c}`") for c in docs.columns], T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in own[:3])])

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in common.pieces(batches):
            codes, first = shingles(batch.column("text"), words)
            named = pa.array(classes(codes, first), pa.int64())
            ids = batch.column("doc_id").cast(pa.int64())
            # Rows without shingles and id are told apart by their number.
            number = np.where((np.diff(first) == 0) & ids.is_null().to_numpy(zero_copy_only=False), np.arange(at + 1, at + 1 + batch.num_rows), 0)
            at += batch.num_rows
            columns = [*batch.columns, named, pc.coalesce(ids, pc.if_else(pa.array(number > 0), pa.array(number), named)), pa.array(number)]
            key = zip(ids.to_pylist(), named.to_pylist(), number.tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(columns, schema.names).take(pa.array(_first_rows(key)))

    common.small_batches(docs.sparkSession)
    rows = docs.mapInArrow(run, schema).join(best, [class_, id_], "left").where(F.col(best_) | (F.col(class_) == 0))
    return rows.dropDuplicates([class_, id_, row_]).select(*names)


def _labelled(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows; class, id and label of each class with shingles, one label for a component)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = common.written(signatures(docs, words), "signatures")
    some = every.where("n_shingles > 0")
    known = common.written(some.groupBy("class").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "classes")

    # Buckets with several classes; every class is compared with a few centres.
    member = known.select(F.col("class").alias("b"), F.posexplode("bands").alias("band", "bucket"))
    centres = F.array_distinct(F.array(F.min("b"), *(F.min_by("b", F.xxhash64("b", F.lit(k))) for k in range(1, CENTRES))))
    heads = member.groupBy("bucket").agg(centres.alias("centres"), F.count("*").alias("size")).where("size > 1")
    members = common.written(member.join(heads, "bucket"), "members")
    side = lambda c: known.select(F.col("class").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("id", "n", "sketch")))
    fit = _alike(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"), percent, most_odd(percent))
    met = members.select("b", F.explode("centres").alias("c")).where("c <> b").groupBy("b").agg(F.collect_set("c").alias("met"))
    dealt = F.transform(F.array_sort(F.transform("met", lambda c: F.struct(F.xxhash64("b", c).alias("at"), c.alias("c")))), lambda x: x["c"])
    few = F.array_union(F.slice(F.array_sort("met"), 1, LEAST), F.slice(dealt, 1, DEALT))
    stars = met.select(F.col("b").alias("a"), F.explode(few).alias("b"))
    ends = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    ordered = [ends("a", "b").alias("a"), ends("b", "a").alias("b"), ends("id_a", "id_b").alias("id_a"), ends("id_b", "id_a").alias("id_b")]
    fitting = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").where(fit).select(*ordered)
    labels = graph.components(_confirmed(common.written(fitting(stars).distinct(), "pairs"), docs, words, percent))
    starred = lambda labels: labels.select(F.col("node").alias("a"), F.col("label").alias("b"))  # noqa: E731  components known so far, as links

    # Buckets whose members are not one component. Where many are outside the
    # commonest one, they meet its hubs and some of their own first.
    def mixed_buckets(rows: DataFrame, labels: DataFrame) -> DataFrame:
        told = rows.select("bucket", "band", "size", "b").join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
        mixed = _usual(told, "bucket").withColumn("crowded", F.col("outside") > CROWD).drop("outside")
        return common.written(told.join(mixed, "bucket"), "mixed")

    rest = mixed_buckets(members, labels)
    found = common.written(fitting(_hub_pairs(rest.where("crowded"))), "pairs")
    if not found.isEmpty():
        labels = graph.components(starred(labels).unionByName(_confirmed(found, docs, words, percent)))
        rest = mixed_buckets(rest, labels)

    # Those still outside against all of other components, each pair in the first bucket that it shares.
    wanted = rest.groupBy(F.col("b").alias("class")).agg(F.min("label").alias("label"), F.max("crowded").alias("crowded"))
    wanted = common.written(wanted.join(known, "class"), "wanted")
    finer = _wanted(docs, wanted, words, "fine", _finer, _FINER)
    facts = finer.join(wanted.select("class", "id", "n", "bands"), "class").withColumnRenamed("class", "b")
    crowd = wanted.where("crowded")
    crowded = not crowd.isEmpty()
    if crowded:
        facts = common.written(facts, "facts")
    full = common.written(rest.where("not crowded").join(facts, "b"), "mixed")
    mine = lambda c, *more: [F.col(x).alias(f"{x}_{c}") for x in ("b", "id", "label", "n", "fine", "bands", *more)]
    one = full.where("label <> usual").select("bucket", "band", *mine("x"))
    two = full.select("bucket", *mine("y", "usual"))
    first_shared = F.array_position(F.zip_with("bands_x", "bands_y", lambda x, y: x == y), True) == F.col("band") + 1
    once = (F.col("label_y") == F.col("usual_y")) | (F.col("label_x") < F.col("label_y"))
    near = _alike(F.col("fine_x")["odd"], F.col("fine_y")["odd"], F.col("n_x"), F.col("n_y"), percent, most_odd(percent, FINE, FINE_SKETCH))
    near &= _may_link(F.col("fine_x")["whole"], F.col("fine_y")["whole"], F.col("n_x"), F.col("n_y"), percent)
    cross = one.join(two, (one["bucket"] == two["bucket"]) & (F.col("label_x") != F.col("label_y")) & once & first_shared & near)
    cross = cross.select(F.col("b_x").alias("a"), F.col("b_y").alias("b"), F.col("id_x").alias("id_a"), F.col("id_y").alias("id_b"))

    # Crowded buckets: their members meet over rare shingles, all at once.
    if crowded:
        sets = _wanted(docs, crowd, words, "set", _sets).join(crowd.select("class", "label", "n", "sketch"), "class")
        sets = common.written(sets.withColumnRenamed("class", "b"), "sets")
        fact = lambda c, end: facts.select(F.col("b").alias(end), F.col("id").alias(f"id_{end}"), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}"))
        rare = common.written(_rare_pairs(sets, None, percent), "rare")
        cross = cross.unionByName(rare.join(fact("x", "a"), "a").join(fact("y", "b"), "b").where(near).select("a", "b", "id_a", "id_b"))
    cross = common.written(cross, "pairs")
    if not cross.isEmpty():
        more = _confirmed(cross, docs, words, percent)
        labels = graph.components(starred(labels).unionByName(more))

    named = known.select("class", "id").join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "id", F.coalesce("label", "class").alias("label"))
    return every, named


def op2_minhash_odd_sketch(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 2-word shingles: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=2)


OP2_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{common.WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS shingles FROM d
), members AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members AS a JOIN members AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS root, doc_id AS node FROM sets UNION SELECT root, b FROM reached JOIN links ON node = a
)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT root, min(node) AS component_id FROM reached GROUP BY root) ON root = doc_id
"""
