"""Approximate nearest neighbours (operator 1) by collision counting.

Largest inner products become nearest points: vectors are scaled into the unit
ball and given one more coordinate that puts them on the sphere; a query is
scaled to length 1 with 0 there. Vectors much shorter than the longest would all
lie near that coordinate's pole, so those of each RATIO of lengths are scaled, and
searched, on their own, the longest first; a range whose longest vector cannot
reach a query's k-th score so far is passed over, which loses nothing. Every range
of a block of vectors keeps one sorted array of projections for each of as many orthogonal directions as there are components
(PROJECTIONS at least), a whole basis: with fewer, collisions say too little
about the angle, and recall falls with the dimension. A query opens a window around its own projection in each array; a vector collides in as many
windows as hold it. Virtual rehashing widens all windows by the factor WIDEN
until vectors that collide in at least SHARE of the arrays reach the quota; all
of these are verified: their inner products are computed on the original
vectors, in double precision.

Scale: vectors are dealt into blocks of about BLOCK rows and the stated queries
into blocks of about QUERIES, of fewer rows where they are longer; each pair of
blocks is one independent task of bounded memory that returns at most k rows a
query. The queries grow with the table, so the pairs do with its square: n
vectors of up to 64 components with a twentieth of them as queries are some
n * n / 220,000 rows sent, and an index is built once for QUERIES queries. No
index is shared, and no vector is left out of the arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors and of queries, up to WIDTH components; less in proportion beyond.
BLOCK = 32768
QUERIES = 16384
WIDTH = 64
#: Sorted arrays at least.
PROJECTIONS = 64
#: Longest over shortest vector of a range, and ranges at most: the last one has all that are shorter still.
RATIO, RANGES = 1.3, 8
#: Queries whose window edges are looked up together.
TOGETHER = 512
#: Collisions asked for, as a share of the arrays.
SHARE = 0.8
#: First half-width of the windows, in units of a random unit vector's spread along a direction.
FIRST = 1.0
WIDEN = 1.2
#: Candidates asked for before widening ends: this share of the block, and so many at least.
QUOTA = 0.1
LEAST = 256
SEED = 7


class Sorted:
    """The sorted arrays of one block, over vectors in the unit ball."""

    def __init__(self, points: np.ndarray, directions: np.ndarray):
        self.n, self.m = len(points), directions.shape[1]
        at = (points @ directions).astype(np.float32)
        order = np.argsort(at, axis=0, kind="stable")
        self.values = [np.ascontiguousarray(at[order[:, j], j]) for j in range(self.m)]
        self.rows = np.ascontiguousarray(order.T).astype(np.int32)

    def edges(self, centres: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """For each array and centre, where the window of that half-width begins and ends."""
        columns = list(zip(self.values, centres.T, strict=True))
        return np.stack([v.searchsorted(c - half, "left") for v, c in columns]), np.stack([v.searchsorted(c + half, "right") for v, c in columns])

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each vector, the number of arrays whose window holds it.

        Rows are counted on the smaller side of all the windows' edges.
        """
        sides = list(zip(self.rows, low.tolist(), high.tolist(), strict=True))
        if int((high - low).sum()) * 2 <= self.n * self.m:
            return np.bincount(np.concatenate([r[a:b] for r, a, b in sides]), minlength=self.n)
        return self.m - np.bincount(np.concatenate([x for r, a, b in sides for x in (r[:a], r[b:])]), minlength=self.n)


def directions(dimension: int, count: int, seed: int = SEED) -> np.ndarray:
    """count directions, orthogonal to each other in groups as large as the dimension allows."""
    random = np.random.default_rng(seed)
    groups = [np.linalg.qr(random.standard_normal((dimension, dimension)))[0] for _ in range(-(-count // dimension))]
    return np.concatenate(groups, axis=1)[:, :count].astype(np.float32)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Of each row, by way of its largest component, whose square may be beyond a double."""
    most = np.abs(vectors).max(axis=1)
    return np.minimum(most * np.linalg.norm(vectors / most[:, None], axis=1), np.finfo(np.float64).max)


class Range:
    """The vectors of a block whose lengths are within a ratio, and the queries' windows over them."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, size: np.ndarray, aims: np.ndarray, k: int):
        self.rows, self.longest = rows, float(size.max())
        unit = vectors / self.longest
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", unit, unit)))
        flat = not (rest > 1e-6).any()  # all on the sphere already: the coordinate would be 0
        points = unit if flat else np.column_stack((unit, rest))
        arrays = max(PROJECTIONS, points.shape[1])
        axes = directions(points.shape[1], arrays)
        self.index = Sorted(points.astype(np.float32), axes)
        self.centres = (aims if flat else np.column_stack((aims, np.zeros(len(aims))))).astype(np.float32) @ axes
        self.enough = min(len(rows), max(LEAST, 2 * k, math.ceil(QUOTA * len(rows))))
        self.needed = math.ceil(SHARE * arrays)
        self.first = FIRST / math.sqrt(vectors.shape[1])
        self.level, self.edges, self.at = 0, {}, -1

    def candidates(self, q: int) -> np.ndarray:
        """Rows that collide with query q often enough, in windows wide enough for the quota."""
        at = q - q % TOGETHER
        if at != self.at:
            self.edges, self.at = {}, at
        self.level = max(0, self.level - 1)
        while True:
            if self.level not in self.edges:
                self.edges[self.level] = self.index.edges(self.centres[at : at + TOGETHER], self.first * WIDEN**self.level)
            found = self.index.collisions(*(e[:, q - at] for e in self.edges[self.level])) >= self.needed
            if int(found.sum()) >= self.enough:
                return self.rows[found]
            self.level += 1


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """For each query its k best of the block as found: arrays (query id, id, score).

    The query's own id is no candidate.
    """
    size, reach = lengths(vectors), lengths(queries)
    aims = queries / reach[:, None]
    longest = size.max()
    step = np.minimum(np.floor(np.log(longest / size) / math.log(RATIO)), RANGES - 1)
    ranges = [Range(np.flatnonzero(step == r), vectors[step == r], size[step == r], aims, k) for r in np.unique(step)]
    out: list[tuple] = []
    for q, (query, query_id) in enumerate(zip(queries, query_ids, strict=True)):
        rows, order = np.zeros(0, np.int64), np.zeros(0)
        for part in ranges:
            with np.errstate(all="ignore"):
                if len(order) == k and order[-1] > part.longest * reach[q] * (1 + 1e-9):
                    break  # nor can those that follow, which are shorter
                new = part.candidates(q)
                new = new[ids[new] != query_id]
                score = vectors[new] @ query
            score = np.where(np.isnan(score), -np.inf, score)
            if len(new) > k:
                keep = score >= np.partition(score, len(new) - k)[len(new) - k]
                new, score = new[keep], score[keep]
            rows, order = np.concatenate((rows, new)), np.concatenate((order, score))
            best = np.lexsort((ids[rows], -order))[:k]
            rows, order = rows[best], order[best]
        with np.errstate(all="ignore"):
            out.append((np.full(len(rows), query_id), ids[rows], vectors[rows] @ query))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is neither null, zero nor with null or non-finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & F.exists("embedding", lambda x: x != 0))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k rows of largest inner product for each query, as found: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all
    rows but the query's own. Vectors that are null, zero or have null or
    non-finite components take no part, as queries or candidates. Those of each
    number of components are searched on their own. Rows that repeat a vec_id are
    one query, of the commonest number of components among all rows and the
    largest vector by its components, and none is a neighbour of that id; each of
    them is a candidate for others. Ties go to the smaller vec_id. Scores that
    overflow to no number come last. Fewer than k candidates are all returned; an
    empty table gives none. Other columns are not read.
    """
    rows = usable(embeddings.select("vec_id", "embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "query_id long, vec_id long, score double"
    rows = rows.withColumn("_size", F.size("embedding"))
    sizes = rows.groupBy("_size").agg(F.count("*").alias("_n"), F.count_if(F.col("vec_id") % every == 0).alias("_asked"))
    up = lambda n, most: F.ceil(F.col(n) * F.greatest(F.col("_size"), F.lit(WIDTH)) / (most * WIDTH)).cast("long")
    sizes = sizes.where("_asked > 0").withColumn("_blocks", up("_n", BLOCK)).withColumn("_query_blocks", up("_asked", QUERIES))
    rows = rows.join(F.broadcast(sizes), "_size")  # a row for each number of components
    own = lambda n, *keys: F.pmod(F.xxhash64(*keys), F.col(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # Rows that agree are dealt apart too, by their place in the table's files.
    data = rows.select("vec_id", "embedding", "_size", own("_blocks", "vec_id", F.monotonically_increasing_id()).alias("_block"), each("_query_blocks").alias("_queries"))
    one = F.max(F.struct("_n", "_size", "embedding", "_blocks", "_query_blocks")).alias("one")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(one).select("query_id", "one.*")
    asked = asked.select("query_id", "embedding", "_size", own("_query_blocks", "query_id").alias("_queries"), each("_blocks").alias("_block"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left, right = left.sort_by("vec_id"), right.sort_by("query_id")
        dimension = right.column("_size")[0].as_py()
        query_id, vec_id, score = search(
            _matrix(left.column("embedding"), dimension),
            left.column("vec_id").to_numpy(),
            _matrix(right.column("embedding"), dimension),
            right.column("query_id").to_numpy(),
            k,
        )
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.float64())})

    keys = ("_size", "_block", "_queries")
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(cell, schema)
    known = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(known.desc(), F.col("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann_collisions(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for each embedding whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
