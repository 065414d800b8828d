"""Quality classifier (operator 9): attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words; only the bag has a label. Each
passage is counted (classes of bytes, word lengths, word shapes, repeats, hashed
words) and encoded by a dense layer. Gated attention weighs the passages
(a tanh branch times a sigmoid branch, softmax within the document), and a
logistic unit scores the weighted passage representation. Encoder, attention and
score are learnt together from document labels by Adam.

Training rows are bounded: the SAMPLE labelled documents whose hashed ids are
least, out of all that may be learnt from, with all their passages. Scoring
covers every passage of every document in one pass without a shuffle; the model
is a few tens of kilobytes and travels with the task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common

PASSAGE = 64
HASHED = 64
ENCODED = 32
ATTENTION = 16
#: Labelled documents to learn from, at most.
SAMPLE = 4000
EPOCHS = 30
BATCH = 64
RATE = 0.005
DECAY = 1e-4
SEED = 11
FOLDS, HELD = 5, 0
THRESHOLD = 0.3

_CLASSES = 16
_LENGTHS = 12


def _classes() -> np.ndarray:
    """Class of each byte: letters by case, digits, common marks one by one, other bytes by kind."""
    kind = np.full(256, 15, np.int64)
    kind[0x61:0x7B], kind[0x41:0x5B], kind[0x30:0x3A] = 0, 1, 2
    kind[[0x20, 0x09]], kind[[0x0A, 0x0B, 0x0C, 0x0D]] = 3, 4
    for k, marks in enumerate((b".", b",;:", b"!?", b"'\"`", b"()[]{}<>", b"|/\\_", b"#$%&*+=~^@", b"-"), 5):
        kind[list(marks)] = k
    kind[0x80:0xC0], kind[0xC0:] = 13, 14
    return kind


_KIND = _classes()
#: Counts by byte class and word length, hashed words, and seven shapes.
WIDTH = _CLASSES + _LENGTHS + HASHED + 7


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counted passages of all texts, and how many each text has (1 at least, empty for no words)."""
    _, data, starts, _ = common.flat(texts)
    begin, end = common.word_spans(data)
    first = common.word_docs(begin, starts)
    words = np.diff(first)
    passages = np.maximum(1, -(-words // PASSAGE))
    base = np.cumsum(passages) - passages
    total = int(passages.sum())
    out = np.zeros((total, WIDTH), np.float32)
    if not len(begin):
        return out, passages
    doc = np.repeat(np.arange(len(words)), words)
    inside = np.arange(len(begin)) - first[doc]
    passage = base[doc] + inside // PASSAGE
    size = np.bincount(passage, minlength=total).astype(np.float32)
    some = np.maximum(size, 1)
    # A passage's bytes reach from its first word's beginning to its last word's end.
    opens = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    left = begin[opens]
    right = end[np.concatenate((opens[1:], [len(begin)])) - 1]
    owner = np.repeat(passage[opens], right - left)
    place = common.ranges(left, right - left)
    counts = np.bincount(owner * _CLASSES + _KIND[data[place]], minlength=total * _CLASSES).reshape(total, _CLASSES)
    length = end - begin
    letters = np.maximum(counts.sum(1, keepdims=True), 1)
    out[:, :_CLASSES] = counts / letters
    at = _CLASSES
    out[:, at : at + _LENGTHS] = np.bincount(passage * _LENGTHS + np.minimum(length, _LENGTHS) - 1, minlength=total * _LENGTHS).reshape(total, _LENGTHS) / some[:, None]
    at += _LENGTHS
    code = common.word_hashes(data, begin, end, lower=True)
    out[:, at : at + HASHED] = np.bincount(passage * HASHED + (code % np.uint64(HASHED)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED) / np.sqrt(some)[:, None]
    at += HASHED
    head, tail = _KIND[data[begin]], _KIND[data[end - 1]]
    again = np.concatenate(([False], (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])))
    order = np.lexsort((code, passage))
    seen = np.concatenate(([False], (code[order][1:] == code[order][:-1]) & (passage[order][1:] == passage[order][:-1])))
    share = lambda flag, by=passage: np.bincount(by, weights=flag, minlength=total) / some
    shapes = (share(head == 1), share((tail >= 5) & (tail <= 12)), share((tail >= 11) | (tail == 7)), share(again), share(seen, passage[order]), share(length >= 20), np.log1p(size) / 5)
    for k, column in enumerate(shapes):
        out[:, at + k] = column
    return out, passages


class Model:
    """Weights of encoder, attention and score, with the passages' scaling."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = SEED):
        random = np.random.default_rng(seed)
        init = lambda a, b: (random.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.spread = mean, spread
        zero = lambda n: np.zeros(n, np.float32)
        self.w = {"E": init(WIDTH, ENCODED), "e": zero(ENCODED), "V": init(ENCODED, ATTENTION), "v": zero(ATTENTION), "U": init(ENCODED, ATTENTION), "u": zero(ATTENTION), "a": init(ATTENTION, 1)[:, 0], "s": init(ENCODED, 1)[:, 0], "b": zero(1)}

    def forward(self, passages: np.ndarray, counts: np.ndarray) -> dict:
        w = self.w
        x = np.clip((passages - self.mean) / self.spread, -6, 6)
        h = np.tanh(x @ w["E"] + w["e"])
        t = np.tanh(h @ w["V"] + w["v"])
        g = 1 / (1 + np.exp(-(h @ w["U"] + w["u"])))
        start = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        score = (t * g) @ w["a"]
        score = np.exp(score - np.maximum.reduceat(score, start)[bag])
        weight = score / np.add.reduceat(score, start)[bag]
        z = np.add.reduceat(h * weight[:, None], start, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["s"] + w["b"][0], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "start": start, "bag": bag, "weight": weight, "z": z, "p": p}

    def score(self, passages: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(passages, counts)["p"].astype(np.float64)

    def gradient(self, passages: np.ndarray, counts: np.ndarray, label: np.ndarray) -> dict:
        w, f = self.w, self.forward(passages, counts)
        bag, weight, start, h = f["bag"], f["weight"], f["start"], f["h"]
        off = ((f["p"] - label) / len(label)).astype(np.float32)
        dz = off[:, None] * w["s"]
        dh = dz[bag] * weight[:, None]
        dweight = (dz[bag] * h).sum(1)
        dscore = weight * (dweight - np.add.reduceat(weight * dweight, start)[bag])
        dgate = dscore[:, None] * w["a"]
        dt = dgate * f["g"] * (1 - f["t"] ** 2)
        dg = dgate * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ w["V"].T + dg @ w["U"].T
        de = dh * (1 - h**2)
        return {"E": f["x"].T @ de, "e": de.sum(0), "V": h.T @ dt, "v": dt.sum(0), "U": h.T @ dg, "u": dg.sum(0), "a": (f["t"] * f["g"]).T @ dscore, "s": f["z"].T @ off, "b": off.sum(keepdims=True)}


def learn(passages: np.ndarray, counts: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model fitted to bags; deterministic. Without bags it scores all alike."""
    if not len(counts):
        return Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), seed)
    model = Model(passages.mean(0), passages.std(0) + np.float32(0.01), seed)
    rate = np.clip(label.mean(), 0.01, 0.99)
    model.w["b"][0] = np.log(rate / (1 - rate))
    first = np.cumsum(counts) - counts
    random = np.random.default_rng(seed)
    one = {k: np.zeros_like(v) for k, v in model.w.items()}
    two = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        speed = RATE * (1 - epoch / epochs)
        order = random.permutation(len(counts))
        for at in range(0, len(order), BATCH):
            take = order[at : at + BATCH]
            rows = common.ranges(first[take], counts[take])
            step += 1
            for k, d in model.gradient(passages[rows], counts[take], label[take]).items():
                d = d + DECAY * model.w[k]
                one[k] = 0.9 * one[k] + 0.1 * d
                two[k] = 0.999 * two[k] + 0.001 * d * d
                model.w[k] -= (speed * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id="doc_id"):
    """Whether a row may not be learnt from: crc32 of its id as text, modulo FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.quality from at most `sample` documents outside the held-out fold.

    Labels that are null or neither 0 nor 1, and ids with labels of both kinds,
    teach nothing. The sample's ids (bounded by `sample`) are broadcast, and its
    counted passages come to the driver.
    """
    known = (
        labels.select("doc_id", "quality")
        .where(F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
        .where(F.col("quality") == F.col("_other"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .select("doc_id", F.col("quality").cast("int").alias("_label"))
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches):
        for batch in common.pieces(batches):
            passages, counts = encode(batch.column("text"))
            ends = np.cumsum(counts)
            blobs = [passages[e - n : e].astype(np.float16).tobytes() for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), pa.array(blobs, pa.binary())], ["doc_id", "label", "passages"])

    common.small_batches(docs.sparkSession)
    found = rows.mapInArrow(run, "doc_id long, label int, passages binary").toArrow().sort_by([("doc_id", "ascending"), ("passages", "ascending")])
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in found.column("passages").to_pylist()]
    counts = np.array([len(b) for b in bags], np.int64)
    stacked = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, WIDTH), np.float32)
    return learn(stacked, counts, found.column("label").to_numpy().astype(np.float32))


def scored(docs: DataFrame, model: Model, keep: Sequence[str] | None = None, name: str = "_score") -> DataFrame:
    """The columns named in keep (all of docs, if None) with `name`: the model's
    probability of label 1 for each whole text.

    Null and empty texts are one empty passage. Only the text is read for the
    score; a column that is kept must not be called `name`, others may have any
    name. Rows that agree get equal scores; an empty table gives none.
    """
    keep = list(docs.columns if keep is None else keep)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    text = common.unused("_text", keep)

    def run(batches):
        for batch in common.pieces(batches, text):
            passages, counts = encode(batch.columns[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(passages, counts), pa.float64())], schema.names)

    common.small_batches(docs.sparkSession)
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias(text)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, keep: Sequence[str] | None = None, sample: int = SAMPLE, name: str = "_score") -> DataFrame:
    """docs (or its columns in keep) with the score, learnt from labels."""
    return scored(docs, fit(docs, labels, sample), keep, name)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
