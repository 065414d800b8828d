"""Byte-level BPE encoding and decoding (operator 4) by recursive DuckDB queries in each partition.

A partition's texts are cut by the tokenizer's pattern; each distinct piece that
the vocabulary lacks becomes the list of its bytes' ids. One recursive query
contracts all of them together: every step lays the unfinished pieces out as
token-position rows, joins neighbouring tokens with the merge table, and
contracts each piece's leftmost pair of least rank, until none is left. Decoding
joins token-position rows with the vocabulary and concatenates by position.

Scale: no shuffle. The rank file (under a megabyte; its size is checked) is
broadcast. A worker holds one chunk of text and caches of pieces of bounded
size, so memory does not follow the partition. Longer texts are taken in
segments, their ids and bytes in blocks that follow one another. Pieces beyond
LONG bytes, for which one step per merge would be slow, are contracted by a queue
of ranks instead, with the same order of merges.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text taken at once by one worker.
CHUNK = 1 << 20
#: Entries in each of a worker's two cache generations.
CACHE = 250_000
#: Pieces longer than this many bytes take the queue.
LONG = 64
#: Token positions that one decoding query takes.
BLOCK = 1 << 18
#: A rank file beyond this is refused, as it is broadcast.
MOST_BYTES = 64 << 20

#: White space as Unicode's White_Space property has it; Python's \s differs in U+001C to U+001F.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(f" (?=[^{_SPACE}])")
_BEGINS_WHITE = re.compile(f"[{_SPACE}]").match

#: A pair's rank and place are one number, the rank above PLACE_BITS bits, so that the least is one minimum.
PLACE_BITS = 8

_MERGE = f"""
WITH RECURSIVE state(piece, ids, open) AS (
  SELECT piece, ids, true FROM todo
  UNION ALL
  SELECT state.piece,
    CASE WHEN best IS NULL THEN state.ids
         ELSE state.ids[:(best & {(1 << PLACE_BITS) - 1}) - 1] || [(best >> {PLACE_BITS})::INTEGER] || state.ids[(best & {(1 << PLACE_BITS) - 1}) + 2:] END,
    best IS NOT NULL
  FROM state LEFT JOIN (
    SELECT piece, min(merges.rank << {PLACE_BITS} | place) AS best
    FROM (SELECT piece, generate_subscripts(ids, 1) AS place, unnest(ids)::BIGINT AS id, unnest(ids[2:])::BIGINT AS next
          FROM state WHERE open) AS tokens
    JOIN merges ON merges.pair = (id << 32 | next)
    GROUP BY piece) AS found ON found.piece = state.piece
  WHERE state.open
)
SELECT piece, ids FROM state WHERE NOT open
"""

_DECODE = "SELECT string_agg(bytes, '' ORDER BY place) FROM tokens JOIN vocabulary USING (id)"


def read_ranks(path: str | None = None) -> bytes:
    """The rank file's content, read by the driver; one line per token: base64 and rank."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    with open(path, "rb") as file:
        content = file.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes; it would be broadcast")
    return content


class Cache:
    """A dict in two generations of about CACHE entries each: what was not asked for lately goes."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def absent(self, keys: set[str]) -> list[str]:
        """The keys that are not there; all others are in the young generation afterwards."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old, absent = self.young, self.old, []
        for key in keys.difference(young):
            if (ids := old.get(key)) is not None:
                young[key] = ids
            else:
                absent.append(key)
        return absent


class Codec:
    """One worker's encoder and decoder."""

    def __init__(self, content: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        spelled = pattern.replace("[^\\s", f"[^{_SPACE}").replace("\\S", f"[^{_SPACE}]").replace("\\s", f"[{_SPACE}]")
        self.pattern = regex.compile(spelled)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        self.db.execute("SET preserve_insertion_order = false")
        self.units, self.pieces = Cache(), Cache()
        width = np.zeros(max(self.ranks.values()) + 1, np.int64)
        width[list(self.ranks.values())] = [len(k) for k in self.ranks]
        self.width = width
        self.ready = {"merges": False, "vocabulary": False}

    def _table(self, name: str) -> None:
        """Make the merge table or the vocabulary when it is first needed."""
        if self.ready[name]:
            return
        ranks = self.ranks
        if name == "merges":
            pairs = [(ranks[k[:i]] << 32 | ranks[k[i:]], v) for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
            rows = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([v for _, v in pairs], pa.int64())})
        else:
            rows = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": [k.decode("latin-1") for k in ranks]})
        self.db.register("made", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM made")
        self.db.unregister("made")
        self.ready[name] = True

    def _contract(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces that are no tokens themselves, packed as int32."""
        if not pieces:
            return []
        self._table("merges")
        ends = np.cumsum([0] + [len(p) for p in pieces]).astype(np.int32)
        ids = pa.ListArray.from_arrays(ends, self.byte[np.frombuffer(b"".join(pieces), np.uint8)])
        self.db.register("todo", pa.table({"piece": np.arange(len(pieces), dtype=np.int32), "ids": ids}))
        done = self.db.sql(_MERGE).to_arrow_table()
        self.db.unregister("todo")
        piece = done.column("piece").to_numpy()
        ids = done.column("ids").combine_chunks()
        flat, ends = ids.flatten().to_numpy().tobytes(), ids.offsets.to_numpy() * 4
        ends = (ends - ends[0]).tolist()
        out: list = [None] * len(pieces)
        for k, a, b in zip(piece.tolist(), ends, ends[1:], strict=False):
            out[k] = flat[a:b]
        return out

    def _contract_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, over a linked list of places.

        Places wait by the rank of the pair that begins there; ranks are taken
        in order, the places of one from the left. A merge may bring a pair of
        the present rank or a lower one: such pairs go through a heap of their own.
        """
        n, ranks = len(piece), self.ranks
        tokens: dict[int, bytes] = {}  # bytes of the ids in use
        ids = array("i", self.byte[np.frombuffer(piece, np.uint8)].tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        alive = bytearray(b"\x01") * n
        known: dict[tuple[int, int], int | None] = {}
        waiting: dict[int, array] = {}
        order: list[int] = []
        for i in set(ids):
            tokens[i] = bytes([int(np.flatnonzero(self.byte == i)[0])])

        def rank_at(i: int) -> int | None:
            j = after[i]
            if j >= n:
                return None
            pair = ids[i], ids[j]
            if pair not in known:
                known[pair] = ranks.get(tokens[pair[0]] + tokens[pair[1]])
            return known[pair]

        def wait(rank: int, i: int) -> None:
            if rank not in waiting:
                waiting[rank] = array("i")
                heapq.heappush(order, rank)
            waiting[rank].append(i)

        for i in range(n - 1):
            if (rank := rank_at(i)) is not None:
                wait(rank, i)
        while order:
            now = heapq.heappop(order)
            places, at, late = array("i", np.sort(np.frombuffer(waiting.pop(now), np.int32)).tobytes()), 0, []
            while at < len(places) or late:
                # A late pair precedes if its rank is lower, or the same further left.
                if late and (at >= len(places) or late[0] < (now, places[at])):
                    rank, i = heapq.heappop(late)
                else:
                    rank, i = now, places[at]
                    at += 1
                if not alive[i] or rank_at(i) != rank:
                    continue
                j = after[i]
                tokens[rank] = tokens[ids[i]] + tokens[ids[j]]
                ids[i], alive[j], after[i] = rank, 0, after[j]
                if after[i] < n:
                    before[after[i]] = i
                for k in (before[i], i):
                    if k >= 0 and (new := rank_at(k)) is not None:
                        if new <= now:
                            heapq.heappush(late, (new, k))
                        else:
                            wait(new, k)
        return np.frombuffer(ids, np.int32)[np.frombuffer(alive, bool)].tolist()

    def _learn(self, units: list[str]) -> None:
        """Put the ids of units, packed as int32, into the cache.

        A unit of letters alone is one piece, with the space before it.
        """
        cut = [([" " + u] if u.isalpha() else self.pattern.findall(u[1:] if u[0] == " " else " " + u)) for u in units]
        cache, short = self.pieces, {}
        for piece in cache.absent(set().union(*cut)):
            raw = piece.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if rank is not None:
                cache.young[piece] = rank.to_bytes(4, sys.byteorder)
            elif len(raw) <= LONG:
                short[piece] = raw
            else:
                cache.young[piece] = array("i", self._contract_long(raw)).tobytes()
        cache.young.update(zip(short, self._contract(list(short.values())), strict=True))
        known, learnt = cache.young, self.units.young
        for unit, pieces in zip(units, cut, strict=True):
            learnt[unit] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])

    def encode(self, texts: list[str], continued: list[bool] | None = None) -> list[bytes]:
        """Each text's ids, packed as int32.

        A space before anything but white space always begins a match of the
        pattern, so texts are first cut there: the units repeat, and are cached,
        without that space. A text's first unit has none, unless the text is
        continued after such a space; it is told from the others, which begin
        with no white space, by a space before it.
        """
        cut = [t.split(" ") if t else [] for t in texts]
        first = [" " if u and not more else "" for u, more in zip(cut, continued or [False] * len(cut), strict=True)]
        for units, mark in zip(cut, first, strict=True):
            if mark:
                units[0] = mark + units[0]
        missing = self.units.absent(set().union(*cut))
        odd = {u for u in missing if not u or (u[0] != " " and _BEGINS_WHITE(u))}
        if odd:  # white space after a space: the space is no place to cut
            for k, units in enumerate(cut):
                if not odd.isdisjoint(units):
                    cut[k] = _CUT.split(texts[k])
                    cut[k][0] = first[k] + cut[k][0]
            missing = self.units.absent(set().union(*cut))
        for i in range(0, len(missing), 50_000):
            self._learn(missing[i : i + 50_000])
        known = self.units.young
        return [b"".join([known[u] for u in units]) for units in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, by blocks of token positions."""
        self._table("vocabulary")
        out = []
        for at in range(0, len(ids), BLOCK):
            block = ids[at : at + BLOCK]
            self.db.register("tokens", pa.table({"place": np.arange(len(block), dtype=np.int32), "id": block}))
            out.append(self.db.sql(_DECODE).fetchall()[0][0].encode("latin-1"))
            self.db.unregister("tokens")
        return b"".join(out)

    def ends(self, ids: np.ndarray, counts: np.ndarray) -> list[int]:
        """Where the bytes of runs of ids, so many each, end among the bytes of all."""
        total = np.concatenate(([0], np.cumsum(self.width[ids])))
        return total[np.cumsum(counts)].tolist()

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """Each id's decimal digits and a comma, padded, and which bytes count."""
        if not hasattr(self, "_digits"):
            told = [b"%d," % i for i in range(len(self.width))]
            most = max(map(len, told))
            self._digits = np.frombuffer(b"".join(t.ljust(most) for t in told), np.uint8).reshape(-1, most)
            self._digits = self._digits, self._digits != 32
        return self._digits

    def spell(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, a comma after each."""
        digits, there = self.spelled()
        return digits[ids][there[ids]].tobytes()


def segments(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[list[int], list[str], list[bool]]]:
    """(row, text, whether it continues one) in groups of about `limit` characters, long texts in several, in order.

    Texts are cut at spaces before anything but white space, which begin a match
    of the pattern and are left out (see Codec.encode).
    """
    rows: list[int] = []
    parts: list[str] = []
    more: list[bool] = []
    size = 0
    for row, text in enumerate(texts):
        at = 0
        while True:
            found = _CUT.search(text, at + limit) if len(text) - at > limit else None
            end = found.start() if found else len(text)
            rows.append(row)
            parts.append(text[at:end])
            more.append(at > 0)
            size += end - at
            if size >= limit:
                yield rows, parts, more
                rows, parts, more, size = [], [], [], 0
            if not found:
                break
            at = found.end()
    if rows:
        yield rows, parts, more


_codecs: dict = {}


def _codec(content: bytes, pattern: str) -> Codec:
    """This worker's codec for a rank file; made once."""
    key = (hash(content), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content, pattern)
    return _codecs[key]


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern


def _texts(batch: pa.RecordBatch) -> list[str]:
    """The texts of a batch's last column."""
    return [(x or b"").decode("utf-8", "replace") for x in batch.columns[-1].cast(pa.binary()).to_pylist()]


def _kept(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, str]:
    """The columns named in keep, and the text under a name that none of them has, which is told."""
    name = common.unused("_text", keep)
    return docs.select(*keep, F.col("text").alias(name)), name


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns named in keep, and ids array<int> of each whole text.

    A null or empty text has an empty array. Bytes that are no UTF-8 count as
    U+FFFD. Repeated rows give repeated rows; an empty table gives none. Columns
    that are not kept are not read, whatever their names; a kept column must not
    be called ids.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    pattern = _pattern(pattern)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    rows, name = _kept(docs, keep)

    def run(batches):
        codec = _codec(content.value, pattern)
        for batch in common.pieces(batches, name, CHUNK):
            packed: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for row, texts, more in segments(_texts(batch)):
                for r, ids in zip(row, codec.encode(texts, more), strict=True):
                    packed[r].append(ids)
            joined = [b"".join(p) for p in packed]
            ends = np.cumsum([0] + [len(p) // 4 for p in joined]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(joined), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], schema.names)

    common.small_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None) -> DataFrame:
    """The columns named in keep, and decoded binary: the bytes of the column ids (null: none).

    A kept column must not be called decoded; others are not read.
    """
    content = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    pattern = _pattern(None)
    schema = T.StructType([tokens.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        codec = _codec(content.value, pattern)
        for batch in batches:
            at, n = 0, batch.num_rows
            count = _list_sizes(batch.columns[-1])
            total = np.cumsum(count)
            while at < n:
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, "right")))
                part = batch.slice(at, end - at)
                ids = part.columns[-1].flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                whole, ends = codec.decode(ids), codec.ends(ids, count[at:end])
                out = [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], schema.names)
                at = end

    common.small_batches(tokens.sparkSession)
    return tokens.select(*keep, F.col("ids").alias(common.unused("_ids", keep))).mapInArrow(run, schema)


def _list_sizes(lists: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def digests(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """keep, n_tokens, ids_sha256 and decoded_sha256: the texts encoded, and the ids decoded again.

    As encode() and decode(), but one worker does both for each chunk, so ids
    never travel, and a long text's ids and bytes go into its digests block by
    block. Rows behave as in encode(); the three names must not be kept.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    pattern = _pattern(pattern)
    told = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([docs.schema[c] for c in keep] + told)
    rows, name = _kept(docs, keep)

    def run(batches):
        codec = _codec(content.value, pattern)
        for batch in common.pieces(batches, name, CHUNK):
            sums = [(hashlib.sha256(), hashlib.sha256()) for _ in range(batch.num_rows)]
            tokens = np.zeros(batch.num_rows, np.int64)
            for row, texts, more in segments(_texts(batch)):
                packed = codec.encode(texts, more)
                count = np.array([len(p) // 4 for p in packed], np.int64)
                ids = np.frombuffer(b"".join(packed), np.int32)
                whole, at = codec.decode(ids), [0, *codec.ends(ids, count)]
                for k, r in enumerate(row):
                    if count[k]:
                        spelled = codec.spell(np.frombuffer(packed[k], np.int32))
                        sums[r][0].update((b"," if tokens[r] else b"") + spelled[:-1])
                        sums[r][1].update(whole[at[k] : at[k + 1]])
                        tokens[r] += count[k]
            columns = [pa.array(tokens), *(pa.array([s[k].hexdigest() for s in sums]) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema.names)

    common.small_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
