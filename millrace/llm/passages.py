"""Substring dedup (operator 7): prefix-partitioned suffix trees over words.

Every word covered by a window of LENGTH words whose word sequence also starts
anywhere else is removed. Suffixes are put into buckets by content (see
repeats); within a block of buckets, prefixes of words of variable length split
them into groups that fit the memory asked for. Each group's subtree is built
from the top, all nodes of a level side by side: an edge is as long as all
suffixes below it agree, and where they part a node has a child for each word.
The first nodes at LENGTH words or deeper on each way down have two leaves or
more that agree in as many words and no further: a repeat, maximal to the right.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import common, repeats

LENGTH = 35
GRAM = 8
#: Bytes of contexts taken into one word list, and suffixes of one subtree group at most (unless they share LENGTH words).
BLOCK = 4 << 20
GROUP = 200_000


def _split(codes: np.ndarray, at: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes by the word at a depth: (suffixes, node of each), sorted, without leaves."""
    word = codes[at + depth]
    order = np.lexsort((word, node))
    at, node, word = at[order], node[order], word[order]
    new = np.concatenate(([True], (node[1:] != node[:-1]) | (word[1:] != word[:-1])))
    alone = new & np.concatenate((new[1:], [True]))
    return at[~alone], (np.cumsum(new) - 1)[~alone]


def _groups(codes: np.ndarray, at: np.ndarray, limit: int, length: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Suffixes split by prefixes until each prefix has at most `limit`; prefixes of one length are packed together.

    Returns (suffixes, prefix of each, words of the prefixes).
    """
    out, node, depth = [], np.zeros(len(at), np.int64), 0
    while len(at):
        if depth == length or len(at) <= limit:
            out.append((at, node, depth))
            break
        at, node = _split(codes, at, node, depth)
        depth += 1
        if not len(at):
            break
        size = np.bincount(node)[node]
        small = size <= limit
        fit_at, fit_node = at[small], node[small]
        head = np.flatnonzero(np.concatenate(([True], fit_node[1:] != fit_node[:-1]))) if len(fit_node) else np.zeros(0, np.int64)
        begin = 0
        for k, h in enumerate(head):
            end = head[k + 1] if k + 1 < len(head) else len(fit_at)
            if end - begin > limit:
                out.append((fit_at[begin:h], fit_node[begin:h], depth))
                begin = h
        if begin < len(fit_at):
            out.append((fit_at[begin:], fit_node[begin:], depth))
        at, node = at[~small], node[~small]
    return out


def _edges(codes: np.ndarray, at: np.ndarray, end: np.ndarray, node: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Words, from its depth on, in which all suffixes of a node agree: one number for each node.

    at, end: each suffix's beginning and the end of its context; node: its node,
    numbered in order; depth: each node's.
    """
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    edge = np.zeros(len(depth), np.int64)
    mine, other = at + depth[node], at[first][node] + depth[node]
    stop, other_stop = end, end[first][node]
    k = 0
    while len(node):
        inside = (mine + k < stop) & (other + k < other_stop)
        agree = inside & (codes[np.where(inside, mine + k, 0)] == codes[np.where(inside, other + k, 0)])
        over = np.zeros(len(depth), bool)
        over[node[~agree]] = True
        edge[over] = k
        stay = ~over[node]
        mine, other, stop, other_stop, node = mine[stay], other[stay], stop[stay], other_stop[stay], node[stay]
        k += 1
    return edge


def deep_nodes(codes: np.ndarray, at: np.ndarray, length: int = LENGTH, limit: int = GROUP, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaves below the first internal nodes of depth `length` or more, the node of each, its depth).

    at: suffixes of at least `length` words; end: where each one's context ends (None: all where codes do).
    """
    ends = np.full(len(codes) + 1, len(codes))
    if end is not None:
        ends[at] = end
    leaves, nodes, depths, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for members, node, prefix in _groups(codes, at, limit, length):
        node = np.unique(node, return_inverse=True)[1]
        depth = np.full(int(node.max(initial=-1)) + 1, prefix, np.int64)
        if prefix == 0 and len(members) == 1:
            continue
        while len(members):
            depth = depth + _edges(codes, members, ends[members], node, depth)
            deep = depth[node] >= length
            if deep.any():
                leaves.append(members[deep])
                nodes.append(node[deep] + base)
                depths.append(depth[node[deep]])
                base += len(depth)
            members, node = members[~deep], node[~deep]
            if not len(members):
                break
            word = codes[members + depth[node]]
            order = np.lexsort((word, node))
            members, parent, word = members[order], node[order], word[order]
            new = np.concatenate(([True], (parent[1:] != parent[:-1]) | (word[1:] != word[:-1])))
            several = ~(new & np.concatenate((new[1:], [True])))
            child = (np.cumsum(new) - 1)[several]
            members, parent = members[several], parent[several]
            kept, node = np.unique(child, return_inverse=True)
            depth = depth[parent[np.searchsorted(child, kept)]] + 1
    return np.concatenate(leaves), np.concatenate(nodes), np.concatenate(depths)


def resolve(key, mark, start, count, many, contexts, bucket):
    """Spans of all repeats among the contexts, block by block; they cover all windows that have an equal one."""
    size = np.fromiter((len(c) for c in contexts), np.int64, len(contexts))
    out = []
    for a, b in repeats.blocks_of(bucket, size, BLOCK):
        words = [c.split(b" ") for c in contexts[a:b]]
        number: dict[bytes, int] = {}
        codes = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64)
        lengths = np.fromiter((len(ws) for ws in words), np.int64, len(words))
        base = np.cumsum(lengths) - lengths
        stop = base + lengths
        leaf, _, depth = deep_nodes(codes, common.ranges(base, count[a:b]), end=np.repeat(stop, count[a:b]))
        row = np.searchsorted(base, leaf, "right") - 1
        place = start[a + row] + leaf - base[row]
        out.append((key[a + row], mark[a + row], place, place + depth))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 4))


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, data, starts, _ = common.flat(texts)
    begin, end = common.word_spans(data)
    return common.word_hashes(data, begin, end), common.word_docs(begin, starts)


def _context(text: bytes, starts: list[int], stops: list[int]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a:b]) for a, b in zip(starts, stops, strict=True)]


def removable(docs: DataFrame) -> DataFrame:
    """Keyed documents with the spans of words to remove (see repeats.keyed for their order).

    A null or blank text has no words, and one of fewer than LENGTH words no
    window. Columns other than doc_id and text are not read. An empty table gives none.
    """
    rows = repeats.keyed(docs)
    return repeats.with_spans(rows, repeats.find(rows, _units, _context, resolve, LENGTH, GRAM, keep_first=False))


def kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(words, words removed, the others joined by a space); spans are in order and apart."""
    words = text.split()
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    out += words[at:]
    return len(words), len(words) - len(out), b" ".join(out)


def remove(docs: DataFrame) -> DataFrame:
    """doc_id and kept binary: each text's words without those of repeated windows, joined by a space."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in common.pieces(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rest = [kept(t, repeats.united(s))[2] for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rest, pa.binary())], schema.names)

    return removable(docs).select("doc_id", "text", "spans").mapInArrow(run, schema)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document: doc_id, n_words, n_removed, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for batch in common.pieces(batches, "text"):
            rows: list[tuple] = []
            for text, listed in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words, removed, rest = kept(text, repeats.united(listed))
                rows.append((words, removed, hashlib.sha256(rest).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], schema.names)

    return removable(docs).select("doc_id", "text", "spans").mapInArrow(run, schema)


OP7_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{common.WORD}') AS w FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {LENGTH} + 1, 0) + 1)) AS i FROM d)
), repeats AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1
), runs AS (
  SELECT r, min(i) AS a, max(i) + {LENGTH} AS b
  FROM (SELECT r, i, sum(CASE WHEN i - before <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM repeats)) GROUP BY r, run
), kept AS (
  SELECT r, sum(b - a)::BIGINT AS n_removed, max(b) AS tail, flatten(list(w[until_:a - 1] ORDER BY a)) AS head
  FROM (SELECT runs.*, w, coalesce(lag(b) OVER (PARTITION BY runs.r ORDER BY a), 1) AS until_ FROM runs JOIN d USING (r)) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n_removed IS NULL THEN w ELSE list_concat(head, w[tail:]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
