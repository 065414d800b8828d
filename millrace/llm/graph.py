"""Connected components of links between 64-bit nodes, in DataFrame functions and Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

#: Rounds before giving up; they grow with the logarithm of the longest path.
MOST_ROUNDS = 60
#: Links that a task takes at once.
FOLDED = 1 << 19


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component) of the links a to b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[label]


def _folded(links: DataFrame) -> DataFrame:
    """(node, label) of links (a, b), b an array: each node once, with the least one that it reaches, for every FOLDED links of a task."""
    most = FOLDED

    def run(batches):
        a, b, size = [], [], 0

        def told():
            nodes, label = least_labels(np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(label, pa.int64())], ["node", "label"])

        for batch in batches:
            ends = batch.column("b")
            b.append(ends.flatten().to_numpy())
            a.append(np.repeat(batch.column("a").to_numpy(), ends.value_lengths().to_numpy()))
            size += len(b[-1])
            if size >= most:
                yield told()
                a, b, size = [], [], 0
        if size:
            yield told()

    return links.select("a", "b").mapInArrow(run, "node long, label long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): the label is the component's least node.

    Every task folds its links; a node then has one label from each fold, so no
    key has more rows than there are folds. Labels that meet at a node are the
    links of the next step, which is the same again, and labels take on what
    the steps after them say. Where a step leaves over half of its links, as
    for long paths, the rest is done in rounds.
    """
    steps, before, rest = [], None, links.where("a <> b").select("a", F.array("b").alias("b"))
    while True:
        held = _folded(rest).groupBy("node").agg(F.min("label").alias("label"), F.collect_set("label").alias("labels"))
        steps.append(common.written(held, "labels"))
        left = steps[-1].agg(F.sum(F.size("labels") - 1)).first()[0]
        if not left:
            found = steps.pop().select("node", "label")
            break
        rest = steps[-1].where("size(labels) > 1").select(F.col("label").alias("a"), F.col("labels").alias("b"))
        if before is not None and 2 * left > before:
            found = _rounds(rest.select("a", F.explode("b").alias("b")))
            break
        before = left
    if not steps:
        return found
    for held in reversed(steps):
        above = found.select(F.col("node").alias("label"), F.col("label").alias("least"))
        found = held.select("node", "label").join(above, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return common.written(found, "labels")


def _nearest(edges: DataFrame) -> DataFrame:
    """edges (a, b) with the least b of each a; minima are partly taken before the shuffle."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("least")), "a")


def _rounds(links: DataFrame) -> DataFrame:
    """components, by rounds over all links.

    Rounds of two steps: every node sends its larger neighbours to the least of
    its neighbours and itself, then its smaller ones and itself, until all point
    at their component's least node. Each round is written to the shared folder,
    so no lineage grows, and a round's rows are at most the links and nodes.
    A node with very many links is one skewed join key of 16-byte rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _nearest(both).where("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b")).where("a <> b").distinct()
        near = _nearest(large)
        small = near.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(near.select("a", F.col("least").alias("b")))
        edges = common.written(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
