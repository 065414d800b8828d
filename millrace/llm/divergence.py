"""Source divergence audit (operator 11).

How far do the sources of a language differ in their words, and in which? Each
pair of sources is described by its joint count histogram: how many terms occur
x times in one and y times in the other. Only terms that both hold are counted
by a join; cells with a zero follow from each source's own histogram and the
size of the vocabulary. The divergence is evaluated once for each combination
(x, y) and multiplied by how many terms have it.

Scale: texts are read once. Words are counted in Arrow batches, a task's by
(lang, source, term) before they are shuffled, so a source or word with a third of
all rows costs one row for each flush and term; all else are DataFrame functions. Joined are terms with terms of their own language,
by term: as many rows as two sources share it. The result has all pairs of a
language's sources, as asked for; nothing else grows with the square of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

#: A term, here and in SQL, after A-Z became a-z: a run of letters a-z and characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a term must occur in.
LEAST = 10
#: Terms listed for each source.
TOP = 10
#: Probabilities are whole numbers out of this many, and added counts to each term.
UNIT, ADDED = 1_000_000_000, 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What each byte of a text becomes: A-Z as a-z, a space for what is in no term.
_BYTES = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in (x + 32 if 65 <= x <= 90 else x for x in range(256)))
#: Different (source, term) entries that a task holds before it sends them on.
HELD = 400_000


def terms(text: str) -> list[bytes]:
    """A text's terms in order, only A-Z lower-cased."""
    return text.encode().translate(_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences) and held (documents), summed over the flushes of a task."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, held) in groups.items():
            kinds = list(n)
            for at in range(0, len(kinds), 10_000):
                part = kinds[at : at + 10_000]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part]), pa.array([held[t] for t in part])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "held"])
        groups.clear()

    for batch in common.pieces(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            words = terms(text)
            n, held = groups.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            held.update(set(words))
        if sum(len(n) for n, _ in groups.values()) > HELD:
            yield from flush()
    yield from flush()


def weight(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * kinds)), exactly; null without kinds."""
    above = (count + F.lit(ADDED)).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = (total + F.lit(ADDED) * kinds).cast("decimal(19,0)")
    return F.when(kinds > 0, F.call_function("div", above, below) + F.lit(1))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)) of two weights, exactly."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n (occurrences) and total (in the language) of kept terms that occur; head marks one row of each term."""
    common.small_batches(docs.sparkSession)
    each = _named(docs).mapInArrow(_counted, "lang string, source string, term string, n long, held long")
    summed = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    term = Window.partitionBy("lang", "term")
    told = summed.withColumns({"total": F.sum("n").over(term), "in": F.sum("held").over(term), "head": F.col("source") == F.min("source").over(term)})
    return told.where(F.col("in") >= least).drop("held", "in")


def sources(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) that occurs, with n (kept occurrences), kinds (the language's terms) and total (its occurrences)."""
    there = _named(docs).select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    lang = kept.groupBy("lang").agg(F.count_if("head").alias("kinds"), F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return there.join(own, ["lang", "source"], "left").join(lang, "lang", "left").select("lang", "source", zero("n"), zero("kinds"), zero("total"))


def histograms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, x, y and terms: how many of the language's terms occur x times in source a and y times in b, for a before b.

    Cells with a zero are implied: of the terms that a holds x times, those that b
    does not hold are the ones left when the joint cells (x, y) are taken away.
    """
    one = lambda s, n: groups.select("lang", F.col("source").alias(s), "kinds") if s == "a" else groups.select("lang", F.col("source").alias(s))
    pairs = one("a", 0).join(one("b", 0), "lang").where("a < b")
    side = lambda s, n: kept.select("lang", "term", F.col("source").alias(s), F.col("n").alias(n))
    joint = side("a", "x").join(side("b", "y"), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "x", "y").agg(F.count(F.lit(1)).alias("m"))
    own = kept.groupBy("lang", F.col("source").alias("s"), "n").agg(F.count(F.lit(1)).alias("m"))
    cell = lambda x, y, m: F.struct(F.col(x).alias("x") if isinstance(x, str) else F.lit(x).cast("long").alias("x"), F.col(y).alias("y") if isinstance(y, str) else F.lit(y).cast("long").alias("y"), m.alias("m"))
    m, zero = F.col("m"), 0
    laid = lambda rows, *cells: rows.select("lang", "a", "b", F.explode(F.array(*cells)).alias("c"))
    every = (
        laid(pairs, cell(zero, zero, F.col("kinds")))
        .unionByName(laid(joint, cell("x", "y", m), cell("x", zero, -m), cell(zero, "y", -m), cell(zero, zero, m)))
        .unionByName(laid(pairs.join(own.withColumnRenamed("s", "a"), ["lang", "a"]), cell("n", zero, m), cell(zero, zero, -m)))
        .unionByName(laid(pairs.join(own.withColumnRenamed("s", "b"), ["lang", "b"]), cell(zero, "n", m), cell(zero, zero, -m)))
    )
    return every.groupBy("lang", "a", "b", F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.sum("c.m").alias("terms")).where("terms <> 0")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value, both ways."""
    first = groups.select("lang", F.col("source").alias("a"), F.col("n").alias("n_a"), "kinds")
    second = groups.select("lang", F.col("source").alias("b"), F.col("n").alias("n_b"))
    f = distance(weight(F.col("x"), F.col("n_a"), F.col("kinds")), weight(F.col("y"), F.col("n_b"), F.col("kinds")))
    told = histograms(kept, groups).join(first, ["lang", "a"]).join(second, ["lang", "b"])
    values = told.groupBy("lang", "a", "b").agg(F.sum(f * F.col("terms")).alias("value"))
    every = first.select("lang", "a").join(second.select("lang", "b"), "lang").where("a < b")
    whole = every.join(values, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return whole.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: each source beside the others of its language, and the terms that set it apart.

    A null text, lang or source is ''. Part pair has each other source of the
    language (none where it is alone), value 0 where the language keeps no term.
    Part term has the source's terms that are likelier in it than in the language,
    at most `top`. Ties go by item in UTF-8 order. Repeated rows, also of one
    doc_id, are documents of their own. An empty table gives an empty result.
    Other columns are not read, whatever they are called.
    """
    kept = common.written(counts(docs, least), "terms")
    groups = common.written(sources(docs, kept), "sources")
    p, q = weight(F.col("t.n"), F.col("g.n"), F.col("g.kinds")), weight(F.col("t.total"), F.col("g.total"), F.col("g.kinds"))
    own = kept.alias("t").join(groups.alias("g"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    apart = own.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(_pairs(kept, groups), "pair").unionByName(_ranked(apart, "term").where(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS words FROM documents
), t AS (
  SELECT uid, lang, source, unnest(words) AS term FROM d
), k AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT uid) >= {LEAST}
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), s AS (
  SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), l AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM s GROUP BY lang, term
), p AS (
  SELECT *, 1 + ({UNIT} * (n + {ADDED})) // ((sum(n) OVER w)::HUGEINT + {ADDED} * count(*) OVER w) AS p FROM s WINDOW w AS (PARTITION BY lang, source)
), q AS (
  SELECT *, 1 + ({UNIT} * (n + {ADDED})) // ((sum(n) OVER w)::HUGEINT + {ADDED} * count(*) OVER w) AS q FROM l WINDOW w AS (PARTITION BY lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), other AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), term AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q
), r AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS place FROM other
  UNION ALL BY NAME
  SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS place FROM term
)
SELECT lang, source, part, item, value, place::INTEGER AS rank FROM r WHERE part = 'pair' OR place <= {TOP}
"""
