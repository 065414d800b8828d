"""Alignment of two tokenizers' vocabularies over a corpus (operator 12).

Both tokenizers cut the same bytes. Their tokens are linked where their byte
ranges overlap, and byte offsets at which both end cut a text into groups. How
many documents hold a pair of ids linked tells which ids stand for one another.

1. Map: texts are tokenised, aligned and folded: a flush of documents is written
   with each document's distinct pairs as places among the flush's own, and the
   flush's distinct pairs, with how many of its documents hold them, as one row
   for each stripe. A stripe is ROWS ids of the first tokenizer.
2. Counts: stripe rows are dealt by stripe and added into one dense block of
   ROWS x ids of the other tokenizer at a time (np.add.at), first by salted parts
   of a stripe and then by stripe. Row maxima give each id's best partners.
3. Answers: the counts meet the flushes' stripe rows by stripe again, and go back
   to their flush: scores are summed where the links are.

Tokens never cross a space that follows something else than white space, so such
a unit has the same tokens, links and groups everywhere: workers keep the units
they have met. Texts that a tokenizer cannot give back are taken whole.

Scale: tokens are never shuffled. A flush's rows are at most its distinct pairs,
so a word in every document costs one entry for each flush. All three reduce
steps stream over sorted partitions: a worker holds one block or one flush.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ids of the first tokenizer in one dense block.
ROWS = 64
#: Distinct (document, pair) entries of one flush, unless one document has more.
FLUSH = 1 << 22
#: Bytes of units in each of the two generations that a worker keeps.
HELD = 80 << 20

_WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_CUT = re.compile(r"(?<=\S) (?! *\Z)")
_BLANK = "▁"


def read(name: str, path: str | None = None) -> bytes:
    """A tokenizer's file: the one at path, or the public one of that name."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


def units(text: str) -> list[str]:
    """text cut at spaces that follow something else than white space; each unit stands without its first space."""
    if text.endswith(" ") or any(w + " " in text for w in _WHITE):
        return _CUT.split(text)
    return text.split(" ")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Two tokenizers, and what they make of texts."""

    def __init__(self, first: bytes, second: bytes, rows: int = ROWS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(first.decode())
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        byte = _byte_of()
        entries = self.a.get_vocab()
        self.spelled_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.spelled_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        piece = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.spelled_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(piece)]
        #: Units are no larger than texts unless a piece goes on after a space.
        self.cuts = not any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in piece)
        self.length_a, self.length_b = (np.array([len(x) for x in s], np.int64) for s in (self.spelled_a, self.spelled_b))
        self.width, self.height, self.rows = len(self.spelled_b), len(self.spelled_a), rows
        self.stripes = -(-self.height // rows)
        self.names = [f"{i}{end}".encode() for i in range(self.height) for end in ",|"] + [f"{i}{end}".encode() for i in range(self.width) for end in ",;"]
        #: Units met since the last change of generations, and those of the one before.
        self.known: dict[str, tuple[int, bytes, bytes] | None] = {}
        self.before: dict[str, tuple[int, bytes, bytes] | None] = {}
        self.held = 0

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Ids of the first tokenizer in the order of stripes: neighbours, whose frequency is alike, lie in different ones."""
        return ids % self.stripes * self.rows + ids // self.stripes

    def align(self, texts: list[str]) -> list[tuple[int, bytes, bytes] | None]:
        """(tokens of the first, groups as text with ; after each, codes of the links as uint32) of each text.

        None for a text that one of the two does not give back. A code is the
        place of the first id times the second's width plus the second id.
        """
        if not texts:
            return []
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        want = [b" " + t.encode() for t in texts]
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        ends = np.cumsum(np.fromiter(map(len, want), np.int64))
        stop_a, stop_b = (np.cumsum(np.fromiter(map(len, ids), np.int64)) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        whole = b"".join(want)
        if not all(
            b"".join(map(spelled.__getitem__, ids.tolist())) == whole and np.array_equal(np.concatenate(([0], end))[stop], ends)
            for spelled, ids, end, stop in ((self.spelled_a, a, end_a, stop_a), (self.spelled_b, b, end_b, stop_b))
        ):
            sound = [b"".join(map(self.spelled_a.__getitem__, x)) == b"".join(map(self.spelled_b.__getitem__, y)) == w for x, y, w in zip(ids_a, ids_b, want, strict=True)]
            rest = iter(self.align([t for t, s in zip(texts, sound, strict=True) if s]))
            return [next(rest) if s else None for s in sound]
        cuts = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        codes = (self.place(a[at_a]) * self.width + b[at_b]).astype(np.uint32).tobytes()
        both = cuts[(end_a[at_a] == cuts) & (end_b[at_b] == cuts)]
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = 2 * a + (both[group_a] == end_a)
        names[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * self.height + 2 * b + (both[group_b] == end_b)
        spelled = list(map(self.names.__getitem__, names.tolist()))
        items, links = (stop_a + stop_b).tolist(), (4 * np.searchsorted(cuts, ends, "right")).tolist()
        return [
            (len(ids), b"".join(spelled[i:j]), codes[x:y])
            for ids, i, j, x, y in zip(ids_a, [0, *items], items, [0, *links], links, strict=False)
        ]

    def _keep(self, unit: str, found: tuple[int, bytes, bytes] | None) -> None:
        self.known[unit] = found
        self.held += 300 + len(unit) + (len(found[1]) + len(found[2]) if found else 0)

    def documents(self, texts: list[str]) -> list[tuple[int, bytes, bytes] | None]:
        """align(), unit by unit where that gives the same."""
        if not self.cuts:
            return [self.align([t])[0] if t else None for t in texts]
        if self.held > HELD:
            self.known, self.before, self.held = {}, self.known, 0
        parts = [units(t) if t else [] for t in texts]
        new = []
        for u in set(chain.from_iterable(parts)).difference(self.known):
            if u in self.before:
                self._keep(u, self.before[u])
            else:
                new.append(u)
        for u, found in zip(new, self.align(new), strict=True):
            self._keep(u, found)
        out = []
        for text, p in zip(texts, parts, strict=True):
            found = list(map(self.known.__getitem__, p))
            if not p:
                out.append(None)
            elif None in found:
                out.append(self.align([text])[0])
            else:
                out.append((sum([f[0] for f in found]), b"".join([f[1] for f in found]), b"".join([f[2] for f in found])))
        return out


@lru_cache(maxsize=1)
def _aligner(first: bytes, second: bytes, rows: int) -> Aligner:
    return Aligner(first, second, rows)


def varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Non-negative integers at seven bits a byte, and where each one's bytes end."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1) << np.uint64(7 * k)
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[ends[on] - size[on] + k] = ((v[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[on] > k + 1) * np.uint8(128))
    return out.tobytes(), ends


def integers(data: bytes) -> np.ndarray:
    """The integers of varints()."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    shift = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * shift), first)


def _blobs(data: bytes, ends: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """data cut after so many of its integers."""
    at = np.concatenate(([0], ends))[np.concatenate(([0], stops))].tolist()
    return [data[x:y] for x, y in zip(at, at[1:], strict=False)]


_MAPPED = "flush long, stripe int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.strip().split(" ") for c in ddl.split(","))])


class _Flush:
    """Documents gathered in one task until they are written."""

    def __init__(self, number: int, aligner: Aligner):
        self.number, self.aligner = number, aligner
        self.told: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, found: list[tuple[int, bytes, bytes] | None]) -> None:
        codes = np.frombuffer(b"".join(f[2] for f in found if f), np.uint32).astype(np.int64)
        counts = np.array([len(f[2]) // 4 if f else 0 for f in found], np.int64)
        doc = np.repeat(np.arange(len(found)) + len(self.told), counts)
        keys, times = np.unique(doc << 32 | codes, return_counts=True)
        for i, f, n in zip(ids, found, counts.tolist(), strict=True):
            if f is None:
                self.told.append((i, 0, 0, 0, 0, ""))
            else:
                groups = f[1].count(b";")
                self.told.append((i, f[0], n + groups - f[0], groups, n, hashlib.sha256(f[1][:-1]).hexdigest()))
        self.keys.append(keys)
        self.times.append(times)
        self.size += len(keys)

    def rows_out(self) -> Iterator[pa.RecordBatch]:
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        pairs, place, docs = np.unique(keys & 0xFFFFFFFF, return_inverse=True, return_counts=True)
        stops = np.cumsum(np.bincount(keys >> 32, minlength=len(self.told)))
        first = np.concatenate(([0], stops[:-1]))
        step = np.diff(place, prepend=0)
        opens = first[first < stops]
        step[opens] = place[opens]
        schema, n = _schema(_MAPPED), len(self.told)
        columns = [[self.number] * n, [None] * n, *zip(*self.told, strict=True), _blobs(*varints(step), stops), _blobs(*varints(times - 1), stops)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
        if not len(pairs):
            return
        size = self.aligner.rows * self.aligner.width
        stripe = pairs // size
        there, first = np.unique(stripe, return_index=True)
        stops, n = np.append(first[1:], len(pairs)), len(there)
        step = np.diff(pairs, prepend=0)
        step[first] = (pairs % size)[first]
        columns = [[self.number] * n, there, *([None] * n for _ in range(6)), _blobs(*varints(step), stops), _blobs(*varints(docs), stops)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _mapped(docs: DataFrame, first: bytes, second: bytes, rows: int, limit: int) -> DataFrame:
    """Documents and stripe rows by flush (see _MAPPED), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(first, second, rows)
        number = TaskContext.get().partitionId() << 32
        flush = _Flush(number, aligner)
        for batch in common.pieces(batches):
            texts = batch.column("text").to_pylist()
            flush.add(batch.column("doc_id").to_pylist(), aligner.documents(texts))
            if flush.size >= limit:
                yield from flush.rows_out()
                number += 1
                flush = _Flush(number, aligner)
        if flush.told:
            yield from flush.rows_out()

    common.small_batches(docs.sparkSession)
    taken = common.doc_rows(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return common.written(taken.mapInArrow(run, _MAPPED), "links")


def _by(rows: DataFrame, parts: int, keys: list[str], then: list[str]) -> DataFrame:
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *then)


def _each(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


_COUNTED = "stripe int, salt int, codes binary, counts binary, best binary"


def _count(rows: int, width: int):
    """A streaming step: stripe rows with one (stripe, salt) after another are added into a dense block; one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros(rows * width, np.int64)
        now, met, size = None, [], 0

        def row() -> pa.RecordBatch:
            codes = np.unique(np.concatenate(met))
            counts = block[codes]
            top = np.zeros(rows, np.int64)
            np.maximum.at(top, codes // width, counts)
            block[codes] = 0
            best = (counts == top[codes // width]).astype(np.uint8).tobytes()
            columns = [[now[0]], [now[1]], [varints(np.diff(codes, prepend=0))[0]], [varints(counts)[0]], [best]]
            schema = _schema(_COUNTED)
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

        for stripe, salt, codes, counts in _each(batches, ("stripe", "salt", "codes", "counts")):
            if now != (stripe, salt):
                if now:
                    yield row()
                now, met, size = (stripe, salt), [], 0
            found = np.cumsum(integers(codes))
            np.add.at(block, found, integers(counts))
            met.append(found)
            size += len(found)
            if size > len(block):
                met = [np.unique(np.concatenate(met))]
                size = len(met[0])
        if now:
            yield row()

    return run


def _answer(size: int):
    """A streaming step: of each (stripe, salt) first the counts, then flushes' stripe rows, which get theirs: twice the count, and 1 for the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros(size, np.int64)
        now, met = None, []
        schema = _schema("flush long, stripe int, answer binary")
        for stripe, salt, flush, codes, counts, best in _each(batches, ("stripe", "salt", "flush", "codes", "counts", "best")):
            if now != (stripe, salt):
                for m in met:
                    block[m] = 0
                now, met = (stripe, salt), []
            found = np.cumsum(integers(codes))
            if flush is None:
                block[found] = 2 * integers(counts) + np.frombuffer(best, np.uint8)
                met.append(found)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(([flush], [stripe], [varints(block[found])[0]]), schema, strict=True)], schema=schema)

    return run


_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A streaming step: of each flush first the answers by stripe, then its documents."""
    schema = _schema(_SCORED)
    now, answers, values = None, [], None
    for batch in batches:
        out = []
        told = ("flush", "stripe", "answer", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
        for flush, stripe, answer, doc_id, n_a, n_b, n_groups, n_links, digest, places, times in _each(iter([batch]), told):
            if flush != now:
                now, answers, values = flush, [], None
            if stripe is not None:
                answers.append(integers(answer))
                continue
            if values is None:
                values = np.concatenate([*answers, np.zeros(0, np.int64)])
            mine, times = values[np.cumsum(integers(places))], integers(times) + 1
            out.append((doc_id, n_a, n_b, n_groups, n_links, int(((mine & 1) * times).sum()), int(((mine >> 1) * times).sum()), digest))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


class Alignment:
    """Two tokenizers aligned over docs: `pairs` of ids with their counts, and `documents` scored by them.

    A document is a row. A null or empty text, and one that a tokenizer does not
    give back, has no tokens: its numbers are 0 and its digest ''. Rows that
    repeat a doc_id, or have none, are documents of their own. An empty table
    gives empty results. Other columns are not read, whatever they are called.
    Among equal counts all partners of an id are its best. first and second are
    paths of the tokenizers' files; None stands for the public ones.
    """

    def __init__(self, docs: DataFrame, first: str | None = None, second: str | None = None, rows: int | None = None, flush: int | None = None):
        a, b, self.rows = read(FIRST, first), read(SECOND, second), rows or ROWS
        self.parts = common.tasks(docs)
        told = _aligner(a, b, self.rows)
        self.width, self.stripes = told.width, told.stripes
        self.mapped = _mapped(docs, a, b, self.rows, flush or FLUSH)
        # As many (stripe, salt) groups as partitions at least: flushes of one stripe are dealt over its salts.
        self.salts = -(-2 * self.parts // self.stripes)
        salt = F.pmod(F.xxhash64("flush"), F.lit(self.salts)).cast("int")
        self.asked = self.mapped.where("stripe IS NOT NULL").select("stripe", salt.alias("salt"), "flush", F.col("places").alias("codes"), F.col("times").alias("counts"))
        count = _count(self.rows, self.width)
        salted = _by(self.asked.select("stripe", "salt", "codes", "counts"), self.parts, ["stripe", "salt"], []).mapInArrow(count, _COUNTED)
        whole = _by(salted.select("stripe", F.lit(0).alias("salt"), "codes", "counts"), self.parts, ["stripe"], []).mapInArrow(count, _COUNTED)
        self.counted = common.written(whole.select("stripe", "codes", "counts", "best"), "counts")

    def pairs(self) -> DataFrame:
        """(a, b, documents, is_best): how many documents hold the pair linked, and whether no other b has more with this a."""
        rows, width, stripes = self.rows, self.width, self.stripes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for stripe, codes, counts, best in _each(batches, ("stripe", "codes", "counts", "best")):
                at = np.cumsum(integers(codes))
                yield pa.RecordBatch.from_arrays([pa.array(at // width * stripes + stripe), pa.array(at % width), pa.array(integers(counts)), pa.array(np.frombuffer(best, np.uint8).astype(bool))], ["a", "b", "documents", "is_best"])

        return self.counted.mapInArrow(run, "a long, b long, documents long, is_best boolean")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
        salts = F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt")
        told = self.counted.select("stripe", salts, F.lit(None).cast("long").alias("flush"), "codes", "counts", "best")
        asked = self.asked.withColumn("counts", F.lit(None).cast("binary")).withColumn("best", F.lit(None).cast("binary"))
        keyed = _by(told.unionByName(asked), self.parts, ["stripe", "salt"], ["flush"])  # null first
        answers = keyed.mapInArrow(_answer(self.rows * self.width), "flush long, stripe int, answer binary")
        docs = self.mapped.where("stripe IS NULL")
        both = docs.withColumn("answer", F.lit(None).cast("binary")).unionByName(answers, allowMissingColumns=True)
        both = both.repartition(self.parts, "flush").sortWithinPartitions("flush", F.col("stripe").asc_nulls_last())
        return both.mapInArrow(_score, _SCORED)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups and links under two tokenizers, scored by the whole corpus."""
    return Alignment(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).documents()
