"""LM scoring with a log-frequency Bloom filter (operator 5).

Words and word pairs of the training documents are counted exactly. A count c
between 2**k and 2**(k + 1) is quantised to one of these two, up with the chance
that keeps its mean, drawn from a hash of the n-gram; it is put into a Bloom
filter with the levels 1 to q = 1 + log2 of that. A count is read back by probing
level after level until one is missing. The score interpolates the pair's share
of its first word with the word's own add-one estimate, which stands alone after
a word that was never seen (Jelinek-Mercer):

    p(w | h) = PAIRS * c~(h, w) / c(h) + (1 - PAIRS) * (c~(w) + 1) / (S + V + 1)

c~ is probed, c(h) exact, V the number of words and S the sum of their c~. The
estimates of single words sum to 1 over the V words and one unknown; the shares
of pairs sum to 1 but for rounding, whose mean is 0, and false hits, which raise a
level in one of a hundred cases.

The filter has a part that is broadcast, with a bound: the n-grams with at least
one in HEAVY of all tokens (HEAVY words and HEAVY pairs at most) and these words'
exact counts. The rest of it, whose size follows the corpus, stays in its parts.

Scale: counts leave a map task as packed blobs, one for each part and flush,
already summed over the flush, so a word or pair that stands in a third of all
rows is one entry per flush. Texts are read twice. Each part of the n-grams has
a segment of its own in the filter, of ITEM_BITS for each stored level, so
segments are made in parallel and false hits stay as rare in any corpus. Each
flush asks every part for the counts and levels of its distinct words and pairs
that are not broadcast by a shuffle join, and its words follow as numbers to
where it is summed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

FOLDS, HELD = 7, 2
#: Bits of the filter for each stored level.
ITEM_BITS = 10
#: Weight of word pairs in the interpolation.
PAIRS = 0.2
#: An n-gram with one in so many of all tokens is broadcast.
HEAVY = 10_000
FLUSH = 12 << 20
#: Documents of one flush at most: their numbers are sent as 16 bits.
FLUSH_DOCS = 60_000

_U = np.uint64
_LOW = _U((1 << 40) - 1)
_END = _U(0x9D39247E33776D41)
_START = _U(0x2AF7398005AAA5C7)
_PAIR, _LEVEL = _U(1 << 60), _U(1 << 48)
_GOLD = _U(0x9E3779B97F4A7C15)
_DRAW = _U(0x6A09E667F3BCC909)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): the words of each text, A-Z lower-cased, and an end after them, as 64-bit codes."""
    _, data, starts, _ = common.flat(texts)
    begin, end = common.word_spans(data)
    words = common.word_hashes(data, begin, end, lower=True)
    first = common.word_docs(begin, starts)
    n = len(first) - 1
    first = first + np.arange(n + 1)
    codes = np.full(len(words) + n, _END)
    is_word = np.ones(len(codes), bool)
    is_word[first[1:] - 1] = False
    codes[is_word] = words
    return codes, first


def pairs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each token's word before, or a start; code of the pair)."""
    before = np.concatenate((codes[:1], codes[:-1]))
    before[first[:-1]] = _START
    return before, common.mix(before * _GOLD + codes)


def _part(codes: np.ndarray, parts: int) -> np.ndarray:
    return ((codes >> _U(40)) % _U(parts)).astype(np.int64)


def _cells(keys: np.ndarray, level: int, pair: bool, probes: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit places of (key, level) within its segment of `bits` bits, one array for each probe."""
    x = common.mix((keys & _LOW) + _U(level) * _LEVEL + (_PAIR if pair else _U(0)))
    y = (x >> _U(17)) | _U(1)
    bits = np.asarray(bits, np.uint64)
    return (((x + _U(i) * y) % bits).astype(np.int64) for i in range(probes))


def levels(counts: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """Quantised counts: 1 for 1, 2 for 2, 3 for 4, ...; between them the lower, or by keys either so that the mean is kept.

    Only the keys' low 40 bits count.
    """
    counts = np.maximum(counts, 1)
    low = np.frexp(counts.astype(np.float64))[1].astype(np.int64)  # 2 ** (low - 1) <= count
    if keys is None:
        return low
    above = counts / np.exp2(low - 1.0) - 1
    return low + ((common.mix((keys & _LOW) ^ _DRAW) >> _U(11)).astype(np.float64) * 2.0**-53 < above)


def segment(words: np.ndarray, word_counts: np.ndarray, couples: np.ndarray, couple_counts: np.ndarray, item_bits: int = ITEM_BITS) -> tuple[np.ndarray, int]:
    """(the bits of one part's segment as 64-bit numbers, probes)."""
    q, p = levels(word_counts, words), levels(couple_counts, couples)
    items = int(q.sum() + p.sum())
    bits = max(64, items * item_bits // 64 * 64)
    probes = int(np.clip(round(bits / max(items, 1) * np.log(2)), 1, 7))
    flags = np.zeros(bits, bool)
    for keys, q, pair in ((words, q, False), (couples, p, True)):
        for level in range(1, int(q.max(initial=0)) + 1):
            keys, q = keys[q >= level], q[q >= level]
            for cell in _cells(keys, level, pair, probes, bits):
                flags[cell] = True
    return np.packbits(flags, bitorder="little").view(np.uint64), probes


class Filter:
    """All segments, to be probed by n-gram codes."""

    def __init__(self, segments: list[tuple[int, int, bytes]], parts: int):
        self.parts = parts
        self.bits, self.base = np.full(parts, 64, np.uint64), np.zeros(parts, np.int64)
        self.probes = np.ones(parts, np.int64)
        words, at = [np.zeros(1, np.uint64)], 1
        for part, probes, blob in segments:
            words.append(np.frombuffer(blob, np.uint64))
            self.bits[part], self.base[part], self.probes[part] = len(blob) * 8, at * 64, probes
            at += len(blob) // 8
        self.words = np.concatenate(words)

    def counts(self, codes: np.ndarray, pair: bool) -> np.ndarray:
        """The counts that the stored levels stand for; 0 for what is not there."""
        return stands_for(self.levels(codes, pair, _part(codes, self.parts)))

    def levels(self, codes: np.ndarray, pair: bool, part: np.ndarray) -> np.ndarray:
        """The levels stored for codes of the parts given, of which the low 40 bits count; 0 for what is not there."""
        found = np.zeros(len(codes), np.int64)
        alive = np.arange(len(codes))
        level = 0
        while len(alive):
            level += 1
            at = part[alive]
            most = int(self.probes[at].max())
            there = np.ones(len(alive), bool)
            for i, cell in enumerate(_cells(codes[alive], level, pair, most, self.bits[at])):
                place = cell + self.base[at]
                hit = (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & _U(1)
                there &= (hit == 1) | (self.probes[at] <= i)
            alive = alive[there]
            found[alive] = level
            if level >= 48:
                break
        return found


def stands_for(level: np.ndarray) -> np.ndarray:
    """The counts that levels stand for."""
    return np.where(level > 0, np.exp2(level - 1.0), 0.0)


def log_chances(single: np.ndarray, exact: np.ndarray, back: np.ndarray, both: np.ndarray, first: np.ndarray, starts: float, smooth: float) -> np.ndarray:
    """log10 of each token's chance, from probed and exact counts of distinct words, each token's word and the pairs' probed counts."""
    # Counts of the words before: the tokens' own, one place earlier; starts are as many as documents learnt from.
    ahead = np.concatenate(([0.0], exact[back][:-1]))
    ahead[first[:-1]] = starts
    alone = ((single + 1) / smooth)[back]
    share = np.divide(both, ahead, out=np.zeros(len(both)), where=ahead > 0)
    return np.log10(np.where(ahead > 0, PAIRS * share + (1 - PAIRS) * alone, alone))


def held_out(doc_id="doc_id"):
    """Whether a row is not learnt from: crc32 of its id as text, modulo FOLDS. A null id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _summed(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sums of their counts (1 each, if None)."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    if counts is None:
        return codes[first], np.diff(np.concatenate((first, [len(codes)])))
    return codes[first], np.add.reduceat(counts[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def _by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _flushes(batches, take):
    """take(batch pieces) for runs of pieces of about FLUSH bytes and at most FLUSH_DOCS rows."""
    held, size, rows = [], 0, 0
    for batch in common.pieces(batches):
        held.append(batch)
        size += int(common.lengths(batch.column("text")).sum())
        rows += batch.num_rows
        if size >= FLUSH or rows + 1000 > FLUSH_DOCS:
            yield from take(held)
            held, size, rows = [], 0, 0
    if held:
        yield from take(held)
    held = None
    common._trim()


def _pack_pairs(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Pair codes' low 40 bits and counts of 1 to 255 (larger ones as several entries), column by column."""
    more = (counts - 1) // 255
    if more.any():
        codes = np.concatenate((codes, np.repeat(codes, more)))
        counts = np.concatenate((counts - more * 255, np.full(int(more.sum()), 255)))
    return _pack_low(codes) + counts.astype(np.uint8).tobytes()


def _unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 6
    return _unpack_low(blob, n), np.frombuffer(blob, np.uint8, n, n * 5)


def _pack_low(codes: np.ndarray) -> bytes:
    """The low 40 bits of codes."""
    return np.ascontiguousarray((codes & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack_low(blob: bytes, n: int, at: int = 0) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8, n * 5, at).reshape(n, 5)
    return wide.view("<u8")[:, 0].astype(np.uint64)


def _squeezed(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(blob, asbytes=True)


def _full(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def _by_use(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, the commonest first; each token's place among them)."""
    words, back, uses = np.unique(codes, return_inverse=True, return_counts=True)
    order = np.argsort(-uses, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return words[order], place[back]


def _pack_text(words: np.ndarray, back: np.ndarray) -> bytes:
    """Distinct word codes and each token's place among them, byte by byte so that the high ones compress."""
    planes = np.ascontiguousarray(back.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return _squeezed(np.array([len(words)], np.int64).tobytes() + words.tobytes() + planes.tobytes())


def _unpack_text(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    blob = _full(blob)
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    planes = np.frombuffer(blob, np.uint8, offset=8 + 8 * n).reshape(4, -1)
    return np.frombuffer(blob, np.uint64, n, 8), np.ascontiguousarray(planes.T).view("<u4")[:, 0].astype(np.int64)


def _looked_up(known: np.ndarray, n: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Counts of words by the sorted codes and counts of a part; 0 for what is not there."""
    if not len(known):
        return np.zeros(len(word), np.int64)
    place = np.minimum(np.searchsorted(known, word), len(known) - 1)
    return np.where(known[place] == word, n[place], 0)


def count(docs: DataFrame, parts: int, heavy: int = HEAVY, item_bits: int = ITEM_BITS) -> DataFrame:
    """Rows for each part: kind 0 with word codes and counts, their sum, number and probed sum; kind 1 with the filter's segment and its probes; kind 2 with pairs that may be heavy."""

    def run(batches):
        def take(held):
            singles, couples = [], []
            for batch in held:
                batch = batch.filter(pc.invert(batch.column("held_out")))
                if batch.num_rows:
                    codes, first = tokens(batch.column("text"))
                    singles.append(codes)
                    couples.append(pairs(codes, first)[1])
            if not singles:
                return
            rows: tuple[list, list, list] = ([], [], [])
            for kind, found in ((0, singles), (1, couples)):
                codes, counts = _summed(np.concatenate(found))
                order, ends = _by_part(_part(codes, parts), parts)
                for p in range(parts):
                    at = order[ends[p] : ends[p + 1]]
                    if len(at):
                        rows[0].append(p)
                        rows[1].append(kind)
                        rows[2].append(codes[at].tobytes() + counts[at].astype(np.uint32).tobytes() if kind == 0 else _pack_pairs(codes[at], counts[at]))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int8()), pa.array(rows[2], pa.binary())], ["part", "kind", "blob"])

        yield from _flushes(batches, take)

    def gather(rows: pa.Table) -> pa.Table:
        part, kinds = rows.column("part")[0].as_py(), rows.column("kind").to_pylist()
        blobs = [b.as_buffer() for b in rows.column("blob")]
        split = [(b.size // 12, b) for b, k in zip(blobs, kinds, strict=True) if k == 0]
        words, word_counts = _summed(
            np.concatenate([np.frombuffer(b, np.uint64, n) for n, b in split] or [np.zeros(0, np.uint64)]),
            np.concatenate([np.frombuffer(b, np.uint32, n, n * 8) for n, b in split] or [np.zeros(0, np.uint32)]),
        )
        found = [_unpack_pairs(b) for b, k in zip(blobs, kinds, strict=True) if k == 1]
        found = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.uint64), np.zeros(0, np.uint8)]
        couples, couple_counts = _summed(*found)
        del found, split, blobs
        common._trim()
        bits, probes = segment(words, word_counts, couples, couple_counts, item_bits)
        often = couple_counts * heavy >= couple_counts.sum()  # of all pairs they can be no less
        common._trim()
        return pa.table(
            {
                "part": pa.array([part] * 3, pa.int32()),
                "kind": pa.array([0, 1, 2], pa.int8()),
                "blob": pa.array([words.tobytes() + word_counts.tobytes(), bits.tobytes(), couples[often].tobytes() + couple_counts[often].tobytes()], pa.binary()),
                "total": pa.array([int(word_counts.sum()), probes, 0], pa.int64()),
                "distinct": pa.array([len(words), 0, 0], pa.int64()),
                "probed": pa.array([float(stands_for(levels(word_counts, words)).sum()), 0.0, 0.0], pa.float64()),
            }
        )

    blobs = docs.mapInArrow(run, "part int, kind byte, blob binary")
    return common.written(blobs.groupBy("part").applyInArrow(gather, "part int, kind byte, blob binary, total long, distinct long, probed double"), "counts")


def _counted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 16
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.int64, n, n * 8)


def _heavy(counts: DataFrame, least: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of words (0) and pairs (2) with at least `least` tokens, sorted; of either as many as tokens / least at most."""

    def run(batches):
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                codes, n = _counted(blob)
                big = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(big.sum()), kind), pa.int32()), pa.array(codes[big].view(np.int64), pa.int64()), pa.array(n[big], pa.int64())], ["kind", "code", "n"])

    found = counts.where("kind <> 1").select("kind", "blob").mapInArrow(run, "kind int, code long, n long").toArrow()
    kinds, codes, n = found.column("kind").to_numpy(), found.column("code").to_numpy().view(np.uint64), found.column("n").to_numpy()
    out = {}
    for kind in (0, 2):
        order = np.argsort(codes[kinds == kind])
        out[kind] = codes[kinds == kind][order], n[kinds == kind][order]
    return out


class Head:
    """What is broadcast: the heavy words' exact counts, and a filter of the heavy words and pairs."""

    def __init__(self, heavy: dict[int, tuple[np.ndarray, np.ndarray]], least: int, item_bits: int = ITEM_BITS):
        (self.words, self.counts), (couples, couple_counts) = heavy[0], heavy[2]
        bits, probes = segment(self.words, self.counts, couples, couple_counts, item_bits)
        self.filter = Filter([(0, probes, bits.tobytes())], 1)
        #: All that is there has this level; another n-gram reaches it by as many false hits.
        self.least = int(levels(np.array([least]))[0])

    def word_levels(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether words are heavy, exact counts, levels); the latter two 0 where not."""
        exact = _looked_up(self.words, self.counts, word)
        return exact > 0, exact, np.where(exact > 0, self.filter.levels(word, False, np.zeros(len(word), np.int64)), 0)

    def pair_levels(self, couple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether pairs are heavy, levels; 0 where not)."""
        level = self.filter.levels(couple, True, np.zeros(len(couple), np.int64))
        there = level >= self.least
        return there, np.where(there, level, 0)


def scores(docs: DataFrame, heavy: int = HEAVY, item_bits: int = ITEM_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each whole text.

    A null or empty text is one token, the end. Rows that agree are counted and
    scored one by one. A null doc_id is learnt from. With nothing to learn from
    N and V are 0. An empty table gives none. Other columns are not read. heavy
    and item_bits: see HEAVY and ITEM_BITS.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = common.tasks(docs)
    docs = common.doc_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("held_out", held_out())
    counts = count(docs, parts, heavy, item_bits)
    facts = counts.where("kind = 0").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v"), F.sum("probed").alias("probed")).first()
    total, distinct, probed = (facts["n"] or 0, facts["v"] or 0, facts["probed"] or 0.0)
    least = total // heavy + 1
    shared = spark.sparkContext.broadcast(Head(_heavy(counts, least), least, item_bits))
    denominator = float(np.log10(total + distinct + 1))
    smooth = probed + distinct + 1

    def sent(flush: str, out: list[tuple[int, int, bytes]], held: list[pa.RecordBatch], size: np.ndarray) -> pa.RecordBatch:
        """Rows of a flush: out (part, kind, blob), and what it knows of its documents, as kind 1, to some part."""
        told = pa.record_batch({"doc_id": pa.concat_arrays([b.column("doc_id") for b in held]), "held_out": pa.concat_arrays([b.column("held_out") for b in held]), "size": pa.array(size)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, told.schema) as stream:
            stream.write_batch(told)
        part, kind, blob = zip(*out, (zlib.crc32(flush.encode()) % parts, 1, sink.getvalue().to_pybytes()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int8()), pa.array([flush] * len(part)), pa.array(blob, pa.binary())], ["part", "kind", "flush", "blob"])

    def ask(batches):
        """Kind 2 asks each part for its words and pairs, kind 3 has the texts."""
        from pyspark import TaskContext

        head = shared.value
        task, number = TaskContext.get().partitionId(), 0

        def take(held):
            nonlocal number
            flush, number = f"{task}:{number}", number + 1
            codes_of, couples_of, sizes = [], [], []
            for batch in held:
                codes, first = tokens(batch.column("text"))
                codes_of.append(codes)
                couples_of.append(pairs(codes, first)[1])
                sizes.append(np.diff(first))
            word, back = _by_use(np.concatenate(codes_of))
            couple = np.unique(np.concatenate(couples_of))
            rare, rare_couple = word[~head.word_levels(word)[0]], couple[~head.pair_levels(couple)[0]]
            (words, word_ends), (couples, couple_ends) = ((x[order], ends) for x in (rare, rare_couple) for order, ends in [_by_part(_part(x, parts), parts)])
            out = []
            for p in range(parts):
                w, c = words[word_ends[p] : word_ends[p + 1]], couples[couple_ends[p] : couple_ends[p + 1]]
                if len(w) or len(c):
                    out.append((p, 2, np.array([len(w), len(c)], np.int64).tobytes() + w.tobytes() + _pack_low(c)))
            out.append((zlib.crc32(flush.encode()) % parts, 3, _pack_text(word, back)))
            yield sent(flush, out, held, np.concatenate(sizes))

        yield from _flushes(batches, take)

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, blobs = left.column("kind").to_pylist(), left.column("blob").to_pylist()
        tables = {r["kind"]: r for r in right.to_pylist()}
        known, n = _counted(tables[0]["blob"]) if tables else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        grams = Filter([(0, tables[1]["total"], tables[1]["blob"])] if 1 in tables else [], 1)
        out = []
        for kind, blob in zip(kinds, blobs, strict=True):
            if kind != 2:
                out.append(blob)
                continue
            words, couples = np.frombuffer(blob, np.int64, 2).tolist()
            word, couple = np.frombuffer(blob, np.uint64, words, 16), _unpack_low(blob, couples, 16 + 8 * words)
            found = [grams.levels(x, pair, np.zeros(len(x), np.int64)) for x, pair in ((word, False), (couple, True))]
            exact = _looked_up(known, n, word)
            out.append(_squeezed(np.array([words], np.int64).tobytes() + exact.tobytes() + np.concatenate(found).astype(np.uint8).tobytes()))
        common._trim()
        return left.select(["part", "flush", "kind"]).append_column("blob", pa.array(out, pa.binary()))

    def sum_up(rows: pa.Table) -> pa.Table:
        """Base sums, known tokens and scores of a flush's documents, from what the parts have answered."""
        head = shared.value
        got = sorted((r["part"], r["kind"], r["blob"]) for r in rows.select(["part", "kind", "blob"]).to_pylist())
        told = pa.ipc.open_stream(next(b for _, k, b in got if k == 1)).read_all()
        size = told.column("size").to_numpy()
        word, back = next(_unpack_text(b) for _, k, b in got if k == 3)
        first, doc = np.concatenate(([0], np.cumsum(size))), np.repeat(np.arange(len(size)), size)
        couple, back_couple = np.unique(pairs(word[back], first)[1], return_inverse=True)
        common._trim()
        (heavy, exact, single), (heavy_couple, both) = head.word_levels(word), head.pair_levels(couple)
        rare, rare_couple = np.flatnonzero(~heavy), np.flatnonzero(~heavy_couple)
        (words, word_ends), (couples, couple_ends) = (_by_part(_part(x, parts), parts) for x in (word[rare], couple[rare_couple]))
        for part, kind, blob in got:
            if kind == 2:
                blob = _full(blob)
                n = int(np.frombuffer(blob, np.int64, 1)[0])
                levels_told = np.frombuffer(blob, np.uint8, offset=8 + 8 * n)
                at = rare[words[word_ends[part] : word_ends[part + 1]]]
                exact[at], single[at] = np.frombuffer(blob, np.int64, n, 8), levels_told[:n]
                both[rare_couple[couples[couple_ends[part] : couple_ends[part + 1]]]] = levels_told[n:]
        starts = float(exact[np.flatnonzero(word == _END)[0]])
        chance = log_chances(stands_for(single), exact, back, stands_for(both)[back_couple], first, starts, smooth)
        sums = lambda x: np.bincount(doc, x, len(size))
        base, n_known, score = sums(np.log10(exact + 1.0)[back]), sums((exact > 0)[back]).astype(np.int64), sums(chance)
        common._trim()
        return pa.table(
            {
                "doc_id": told.column("doc_id"),
                "held_out": told.column("held_out"),
                "n_tokens": pa.array(size, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array(np.full(len(size), total), pa.int64()),
                "base_score": pa.array(base - size * denominator, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    blobs = docs.mapInArrow(ask, "part int, kind byte, flush string, blob binary")
    table = counts.where("kind <= 1").select("part", "kind", "total", "blob")
    looked = blobs.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(look_up, "part int, flush string, kind byte, blob binary")
    return looked.groupBy("flush").applyInArrow(sum_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Every document's scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
