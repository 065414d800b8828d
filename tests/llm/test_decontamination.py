import hashlib
import random
import re

import pytest

from millrace.llm import decontamination

SPAN = 4


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span=SPAN):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), span)
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), sorted(hit)))
    return out


def tables(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "été", "É1", "x", "42", "of", "漢"]) if rng.random() < 0.7 else "".join(rng.choice("abcd") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.randint(4, 12)))) for k in range(12)] + [(100, "Zeta"), (101, "two WORDS"), (102, ""), (103, None), (104, "..."), (None, "no id here at all")]
    items += [(200, items[0][1]), (9, items[1][1]), (10, "a'b c-d, e")]
    docs = []
    for k in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, 1), re.sub(" ", lambda m: rng.choice([" ", "\n", " - "]), rng.choice(items)[1] or ""))
        docs.append((k, rng.choice([" ", "!\n"]).join(parts)))
    docs += [(None, "zeta"), (None, None), (5, docs[5][1]), (5, "another text, two words"), (500, ""), (501, "A'B c/D;e"), (502, "the " * 200 + items[2][1])]
    return docs, items


@pytest.mark.parametrize(("seed", "bytes_"), [(1, 64 << 20), (2, 2000)])
def test_equals_brute_force(spark, seed, bytes_):
    docs, items = tables(seed)
    d = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id long, text string, key string, length int").repartition(3)
    b = spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, hash string")
    got = [tuple(r) for r in decontamination.report(d, b, SPAN, bytes_).collect()]
    want = [r[:6] for r in brute(docs, items)]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key) and any(r[5] for r in want) and not all(r[5] for r in want)


def test_cleaning_takes_covered_words_and_nothing_else(spark):
    docs, items = tables(3)
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, places string")
    b = spark.createDataFrame(items, "item_id long, text string")
    told = {(r[0], t): r for r, (_, t) in zip(brute(docs, items), docs, strict=True)}
    spans = decontamination.clean(d, b, span=SPAN)
    assert spans.columns == d.columns
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    want = []
    for doc, text in docs:
        hit, n = set(told[doc, text][6]), iter(range(10**6))
        want.append((doc, text if not hit else word.sub(lambda m: "" if next(n) in hit else m[0], text)))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["text"]) for r in spans.collect()), key=key) == sorted(want, key=key)
    left = decontamination.clean(d, b, whole=True, span=SPAN)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=key) == sorted((x for x in docs if not told[x][5]), key=key)


def test_without_python(spark):
    docs, items = tables(4)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontamination.report(d, b)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Cartesian|NestedLoop", plan)


def test_the_query(spark, tmp_path):
    docs = [(1, "w " * 300_000 + "a b c d e f g h i j k"), (2, None), (3, "a b c d e f g h i")]
    spark.createDataFrame(docs, "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "A b c d e f g h i j")], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in decontamination.op13_decontamination(spark, str(tmp_path)).collect()}
    assert {k: v[:3] + v[4:] for k, v in got.items()} == {1: (300_011, 10, 1, True), 2: (0, 0, 0, False), 3: (9, 0, 0, False)}
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r)[2:4] for r in decontamination.report(docs, empty).collect()} == {(0, 0)}
    assert decontamination.report(docs.limit(0), spark.read.parquet(str(tmp_path / "benchmark.parquet"))).collect() == []
