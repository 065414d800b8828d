import hashlib
import random

import corpus_pipeline as pipeline
from millrace.llm import bpe, mixing, pii

from .test_neardup import brute


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghil") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows(seed=6):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(20, 120)) for _ in range(260)]
    texts += [" ".join(["changed", *t.split(" ")[1:]]) for t in texts[:20]] + texts[30:40]
    texts += [prose(rng, 60).upper().replace(" ", "!! ") for _ in range(60)]
    texts += [f"{prose(rng, 20)} mail a{k}.b@example.com {prose(rng, 5)}" for k in range(10)] + [None, "", "one"]
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    table = rows()
    marks = [(i, 0 if t and "!!" in t else 1, 0) for i, t, *_ in table if i % 2]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = pipeline.classify(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    left = [tuple(r) for r in good.collect()]
    bad = {i for i, t, *_ in table if t and "!!" in t}
    assert sum(r[0] in bad for r in left) <= 3 and sum(r[0] not in bad for r in left) >= len(table) - len(bad) - 3
    one = pipeline.dedupe(spark, docs, "")
    want = {d for d, _, c, _ in brute([(i, t) for i, t, *_ in table], 5) if d == c}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == docs.columns
    clean = pipeline.redact(spark, docs, "")
    assert clean.columns == docs.columns
    for r in clean.collect():
        text = table[r["doc_id"]][1]
        assert r["text"] == (None if text is None else pii.masked(text)) and r["n_chars"] == (None if text is None else len(r["text"]))
    copies = {r["doc_id"]: r["_copies"] for r in mixing.plan(docs).collect()}
    mixed = [r["doc_id"] for r in pipeline.mix(spark, docs, "").collect()]
    assert all(mixed.count(i) == n for i, n in copies.items())
    codes = pipeline.encode(spark, docs, "").collect()
    assert all(r["decoded_sha256"] == hashlib.sha256((table[r["doc_id"]][1] or "").encode()).hexdigest() for r in codes)
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(out) and {r["doc_id"] for r in out} <= {i for i, *_ in table}
    assert bpe.digests(docs.limit(0)).count() == 0


def test_dedupe_keeps_one_row_of_each_component(spark):
    rng = random.Random(4)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    near = lambda t, w: " ".join([w, *t.split(" ")[1:]])
    table = [(3, a), (3, a), (5, near(a, "x")), (None, near(a, "y")), (None, b), (None, b), (None, near(b, "x")), (None, c), (8, d), (6, d), (6, c + " " + d)]
    table += [(7, ""), (7, ""), (9, None), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in table], SCHEMA).repartition(4)
    got = [(r["doc_id"], r["text"]) for r in pipeline.dedupe(spark, docs, "").collect()]
    of_b = [t for _, t in got if t in (b, near(b, "x"))]
    assert len(of_b) == 1
    want = [(3, a), (None, of_b[0]), (None, c), (6, d), (6, c + " " + d), (7, ""), (9, None), (None, ""), (None, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_and_long_texts(spark, tmp_path):
    """Extra columns called like the operators' own, and texts of megabytes, go through every stage."""
    rng = random.Random(12)
    clash = ["_text", "_score", "_kept", "_class", "_id", "_row", "_best", "_size", "_copy", "_copies", "_source", "_target", "_rate", "row", "size", "label", "class"]
    long = prose(rng, 400_000)
    table = [(i, t, "en", "s", 0) for i, t in enumerate([prose(rng, 40) for _ in range(30)] + [long, long + " more", None, ""])]
    schema = SCHEMA + "".join(f", `{c}` string" for c in clash)
    docs = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in clash)) for r in table], schema).repartition(3)
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in clash), name
        if name == "near duplicates":
            assert {r["doc_id"] for r in rows} == {*range(31), 32, 33}
    codes = {r["doc_id"]: r for r in pipeline.encode(spark, docs, "").collect()}
    assert codes[31]["decoded_sha256"] == hashlib.sha256((long + " more").encode()).hexdigest() and len(codes) == len(table)
