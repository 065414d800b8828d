"""Benchmark decontamination (operator 13), in DataFrame functions alone.

Every `span` consecutive words of a benchmark item, normalised, are a window; a
shorter item is one window as a whole. The windows' 64-bit hashes are broadcast
as a hash set with the windows' words; each document's words are scanned window
by window, and where a hash is met the words themselves are compared. Words that
a window covers can be removed, or the documents that have some.

Scale: a document is scanned where it is read. Its words stay beside its windows
inside one generated stage and are never copied, written or shuffled; only what
was verified and one row for each document go on. The set is broadcast in parts
of at most PART_BYTES of windows, which are measured first: a benchmark of any
size takes as many scans as it has parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, here and in SQL, after A-Z became a-z: digits, a-z and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10
#: Bytes of windows that are broadcast at once.
PART_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """A text's words in order, only A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() is faster by far, and the same where all is ASCII.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _GAP), "")


def _hashed(column: str) -> Column:
    return F.transform(column, lambda w: F.xxhash64(w))


def windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """length, hash, window (words, joined by a space) and items (ids as strings, sorted) of each different window.

    A null or wordless text has no window. An item without an id has windows, but is in no list.
    """
    told = items.select(F.col("item_id").cast("string").alias("item"), words("text").alias("w"))
    sized = told.select("item", "w", F.least(F.size("w"), F.lit(span)).alias("length")).where("length > 0")
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at")
    each = sized.select("item", "length", "w", at).select("item", "length", F.slice("w", F.col("at"), F.col("length")).alias("w"))
    return each.groupBy("length", F.xxhash64(_hashed("w")).alias("hash"), F.array_join("w", " ").alias("window")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _met(rows: DataFrame, part: DataFrame) -> DataFrame:
    """rows with the windows that begin in them, verified word by word; each row also once without any, at place -1."""
    length, last = F.col("length"), F.size("codes") - F.col("length")
    begins = F.when(length == 0, F.array(F.lit(-1))).when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    each = rows.select("*", F.explode("lengths").alias("length")).select("*", F.explode(begins).alias("at"))
    hashed = each.withColumn("hash", F.xxhash64(F.slice("codes", F.greatest(F.col("at"), F.lit(0)) + 1, length)))
    side = part.select(F.col("length").alias("_length"), F.col("hash").alias("_hash"), "window", "items")
    # Words are compared only where hashes meet: an equality here would become a second key, made for each window.
    text = F.array_join(F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, length), " ")
    same = (F.col("hash") == F.col("_hash")) & (length <= F.col("_length")) & (length >= F.col("_length")) & F.startswith(text, F.col("window")) & F.startswith(F.col("window"), text)
    found = hashed.join(F.broadcast(side), same, "left").where("_hash IS NOT NULL OR length = 0")
    return found.select("key", "mark", "n_words", "at", "length", "items")


def hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, part_bytes: int = PART_BYTES) -> DataFrame:
    """key, mark, copies, n_words, places (of words that a window covers, from 0, sorted) and items of each different document.

    key is the doc_id and mark a hash of the text: rows that agree in both are
    one document with so many copies. The benchmark's windows are counted and
    summed first, and their lengths (at most `span` of them) come to the driver.
    """
    known = windows(benchmark, span)
    told = known.groupBy("length").agg(F.sum(F.length("window") + 64 + 24 * F.size("items")).alias("bytes")).collect()
    parts = max(1, -(-sum(r["bytes"] for r in told) // part_bytes))
    lengths = sorted(r["length"] for r in told)
    text = F.coalesce("text", F.lit(""))
    taken = docs.select(F.col("doc_id").cast("long").alias("key"), F.xxhash64(text).alias("mark"), words("text").alias("w"))
    scans = []
    for k in range(parts):
        # Length 0 stands for the document itself, once.
        listed = F.array(*(F.lit(n) for n in ([0] if k == 0 else []) + lengths)).cast("array<int>")
        rows = taken.select("key", "mark", F.size("w").alias("n_words"), "w", _hashed("w").alias("codes"), listed.alias("lengths"))
        scans.append(_met(rows, known.where(F.pmod("hash", F.lit(parts)) == k)))
    each = reduce(DataFrame.unionByName, scans)
    spans = F.collect_set(F.when(F.col("length") > 0, F.struct("at", "length")))
    summed = each.groupBy("key", "mark").agg(F.count_if(F.col("length") == 0).alias("copies"), F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    return summed.select("key", "mark", "copies", "n_words", F.array_sort(F.array_distinct(covered)).alias("places"), F.array_sort("items").alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs.

    A null or empty text has no words. Rows that repeat a doc_id and text get
    equal results, once each; rows that repeat a doc_id only are told apart; a
    null doc_id is an id. Items of equal text are all counted. Without benchmark
    windows nothing is hit; an empty table gives an empty result. Other columns
    are not read, whatever they are called.
    """
    told = hits(docs, benchmark, span, part_bytes).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    n = F.size("places").cast("long")
    return told.select(F.col("key").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, whole: bool = False, span: int = SPAN, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs without what the benchmark's windows cover; the columns of docs, whatever they are called.

    whole: documents with a hit go. Otherwise the covered words go, what stands
    between words stays, and a document of covered words alone keeps the rest.
    Texts without a hit are untouched.
    """
    found = hits(docs, benchmark, span, part_bytes).where(F.size("places") > 0)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_mark"))
    on = F.col("_key").eqNullSafe(F.col("key")) & (F.col("_mark") == F.col("mark"))
    if whole:
        return rows.join(found, on, "left_anti").select("row.*")
    both = rows.join(found.select("key", "mark", "places"), on, "left")
    # The pattern also takes A-Z here, so that words stand as they are in the text.
    pattern = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    plain, gaps = F.regexp_extract_all(F.col("row.text"), F.lit(pattern), F.lit(0)), F.split(F.col("row.text"), pattern)
    split = both.withColumns({"_w": F.when(F.col("places").isNotNull(), plain), "_gaps": F.when(F.col("places").isNotNull(), gaps)})
    flags = F.map_from_arrays("places", F.transform("places", lambda p: F.lit(True)))
    rest = F.transform("_w", lambda w, i: F.concat(F.when(F.map_contains_key("_hit", i), F.lit("")).otherwise(w), F.element_at("_gaps", i + 2)))
    text = F.concat(F.element_at("_gaps", 1), F.array_join(rest, ""))
    made = split.withColumn("_hit", flags).withColumn("_text", F.when(F.col("places").isNull(), F.col("row.text")).otherwise(text))
    return made.select(*(F.col("_text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return report(read("documents").select("doc_id", "text"), read("benchmark").select("item_id", "text"))


OP13_SQL = f"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM benchmark
), n AS (
  SELECT item, w, least(len(w), {SPAN}) AS length FROM b WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item, length, array_to_string(list_slice(w, pos, pos + length - 1), ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - length + 2)) AS pos FROM n)
), d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents
), p AS (
  SELECT uid, w, length, unnest(range(1, len(w) - length + 2)) AS pos FROM d JOIN (SELECT DISTINCT length FROM g) ON len(w) >= length
), x AS (
  SELECT uid, pos, p.length, item FROM p JOIN g ON p.length = g.length AND array_to_string(list_slice(w, pos, pos + p.length - 1), ' ') = g.words
), h AS (
  SELECT uid, count(DISTINCT place) AS n_hit FROM (SELECT uid, unnest(range(pos, pos + length)) AS place FROM x) GROUP BY uid
), i AS (
  SELECT uid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM x WHERE item IS NOT NULL GROUP BY uid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (uid) LEFT JOIN i USING (uid)
"""
