"""Mixing sources to target weights (operator 10), in DataFrame functions alone.

Tokens are summed by source, each source gets a target, and the target's ratio
to what the source holds is its repetition rate. A document is emitted
floor(rate) times, and once more with probability equal to the fraction, drawn
from a hash of the seed and its id: reruns agree, whatever the partitions.

Scale: one pass over the texts sums sizes by source with map-side partial sums,
so a source with a third of all rows costs one row per task. The targets have
one row per source and are joined without a hint: adaptive execution broadcasts
them after measuring them, or splits skewed partitions if there are too many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.common import WORD

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Total to take, over the total size.
SHARE = 1.5
#: No source is repeated more often than this.
MOST = 2
SEED = "mix-1"


def size_of(text: Column | str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """totals (source, source_size) with the target of each source.

    Sharing by weight, capping at `most` times the size and resharing the excess
    ends at target = min(cap, level * weight) for one level. Going through the
    sources by cap / weight, the level that is left when all before are capped
    falls below that ratio at the first source that stays uncapped.
    The windows have no partition key: they run over one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by_need = Window.orderBy("_need", "_place")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    pick = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    )
    return (
        totals.withColumn("_place", place)
        .withColumn("_weight", pick.cast("long"))
        .withColumn("_cap", F.lit(int(most)) * F.col("source_size"))
        .withColumn("_need", F.col("_cap").cast("double") / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("_level", F.max(F.when(F.col("_need") > F.col("_level"), F.col("_level"))).over(every))
        .select(
            "source",
            "source_size",
            F.coalesce(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight")), F.col("_cap").cast("double")).alias("target"),
        )
    )


def draw(doc_id: Column | str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the id: 52 bits of a digest."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _goals(sized: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """_source, _source_size, _target and _rate of each source of sized (source, size)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return targets(totals, weights, share, most).select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), rate.alias("_rate"))


def _with_copies(rows: DataFrame, goals: DataFrame, seed: str) -> DataFrame:
    """rows (doc_id, source and whatever else) with their source's goals and _copies."""
    copies = F.floor("_rate") + (draw("doc_id", seed) < F.col("_rate") - F.floor("_rate")).cast("long")
    return rows.join(goals, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_copies", copies.cast("long"))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with _size, _source_size, _target and _copies.

    A null source is a source of its own, last in order. A null or blank text
    has size 0 and adds nothing; it is still emitted at its source's rate. A
    source without words has rate 0. Rows that repeat a doc_id share its draw.
    An empty table gives an empty table. Other columns pass through unread,
    whatever they are called; only columns that have one of the four names are
    replaced by the plan's.
    """
    added = ("_size", "_source_size", "_target", "_copies")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    rows = docs.select("doc_id", "source", size_of("text").alias("size"), F.struct(*kept).alias("row"))
    return _with_copies(rows, _goals(rows.select("source", "size"), weights, share, most), seed).select("row.*", F.col("size").alias("_size"), *added[1:])


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as often as its plan says, with the columns of docs, whatever they are called."""
    rows = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    planned = _with_copies(rows, _goals(docs.select("source", size_of("text").alias("size")), weights, share, most), seed)
    return planned.select("row", F.explode(F.expr("array_repeat(0, cast(_copies as int))"))).select("row.*")


def taken(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of each row; behaves as plan().

    Texts are read once: sizes are written to the shared folder and summed from there.
    """
    sized = common.written(docs.select("doc_id", "source", size_of("text").alias("size")), "sizes")
    planned = _with_copies(sized, _goals(sized, weights, share, most), seed)
    return planned.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).alias("taken"))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents, one row each: doc_id, size, source_size, target, taken."""
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM t
), w AS (
  SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM p
), n AS (
  SELECT *, cap::DOUBLE / weight AS need FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
      - coalesce(sum(cap) OVER (ORDER BY need, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / ((sum(weight) OVER ())::BIGINT
      - coalesce(sum(weight) OVER (ORDER BY need, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS level
  FROM n
), g AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * max(CASE WHEN need > level THEN level END) OVER ()), cap::DOUBLE) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + (CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)) * size AS taken FROM r
"""
