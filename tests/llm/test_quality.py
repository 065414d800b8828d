import zlib

import numpy as np
import pyarrow as pa

from millrace.llm import quality


def test_gradients():
    rng = np.random.default_rng(0)
    model = quality.Model(np.zeros(quality.WIDTH, np.float32), np.ones(quality.WIDTH, np.float32))
    x, counts, label = rng.random((9, quality.WIDTH)).astype(np.float32), np.array([2, 1, 6]), np.array([0, 1, 1], np.float32)

    def loss():
        p = model.forward(x, counts)["p"].astype(np.float64)
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    for name, d in model.gradient(x, counts, label).items():
        w = model.w[name].reshape(-1)
        for i in rng.integers(0, w.size, 3):
            keep, step = w[i], 1e-2
            w[i] = keep + step
            up = loss()
            w[i] = keep - step
            down = loss()
            w[i] = keep
            assert abs((up - down) / (2 * step) - d.reshape(-1)[i]) < 2e-3, name


def test_passages():
    texts = pa.array(["", None, "one two", "w " * 200, "a\n\nb"])
    passages, counts = quality.encode(texts)
    assert counts.tolist() == [1, 1, 1, 4, 1] and passages.shape == (8, quality.WIDTH)
    assert np.array_equal(passages[0], passages[1]) and not passages[0].any()
    alone, _ = quality.encode(texts.slice(3, 1))
    assert np.allclose(alone, passages[3:7])


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgilmnorst"), rng.integers(2, 9))) for _ in range(300)]
    rows, marks = [], []
    for i in range(1200):
        text = " ".join(rng.choice(words, rng.integers(20, 300)))
        bad = i % 6 == 0
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 4 else " ".join(w + "$$$" for w in text.split())
        rows.append((i, text, "zz"))
        marks.append((i, int(not bad), 0))
    rows += [(5000, None, "zz"), (5001, "", "zz"), (1, "repeated row", "zz")]
    marks += [(5000, None, 0), (5, 1, 0), (6, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).select("doc_id", quality.held_out().alias("held"), "_score").collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in marks if q is not None}
    held = [r for r in got if r["held"] and r["doc_id"] < 1200]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    right = [(r["_score"] >= quality.THRESHOLD) == bool(truth[r["doc_id"]]) for r in held]
    assert np.mean(right) > 0.95
    assert quality.classify(docs.limit(0), labels.limit(0)).count() == 0


def plain_passage(words, text):
    """Counts of one passage by their definition. words: (word, start, end) of it and the word before it in the text."""
    row = np.zeros(quality.WIDTH)
    raw = text[words[0][1] : words[0][3]]
    kinds = [int(quality._KIND[b]) for b in raw]
    for k in kinds:
        row[k] += 1 / len(kinds)
    n, at = len(words), quality._CLASSES
    codes = [int(quality.common.word_hashes(np.frombuffer(w + b" ", np.uint8), np.array([0]), np.array([len(w)]), lower=True)[0]) for w, *_ in words]
    for (w, *_), c in zip(words, codes):
        row[at + min(len(w), quality._LENGTHS) - 1] += 1 / n
        row[at + quality._LENGTHS + c % quality.HASHED] += 1 / n**0.5
    at += quality._LENGTHS + quality.HASHED
    ends = [int(quality._KIND[w[-1]]) for w, *_ in words]
    again = sum(w[4] for w in words) / n
    row[at:] = (
        sum(quality._KIND[w[0]] == 1 for w, *_ in words) / n,
        sum(5 <= e <= 12 for e in ends) / n,
        sum(e >= 11 or e == 7 for e in ends) / n,
        again,
        (n - len(set(codes))) / n,
        sum(len(w) >= 20 for w, *_ in words) / n,
        np.log1p(n) / 5,
    )
    return row


def test_scores_equal_brute_force():
    """Passages counted word by word, and each document's score passage by passage."""
    import re

    rng = np.random.default_rng(3)
    texts = ["", "one One two", "Wörter, und  (mehr) " * 60, " ".join("".join(rng.choice(list("abcDE.!é"), rng.integers(1, 24))) for _ in range(200))]
    model = quality.Model(rng.random(quality.WIDTH).astype(np.float32), rng.random(quality.WIDTH).astype(np.float32) + 0.5, 4)
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    want = []
    for text in texts:
        raw = text.encode()
        found = [(m[0], *m.span()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        low = [f[0].lower() for f in found]
        bags = [found[k : k + quality.PASSAGE] for k in range(0, len(found), quality.PASSAGE)]
        rows = []
        for b, bag in enumerate(bags):
            stop = bag[-1][2]
            first = b * quality.PASSAGE
            rows.append(plain_passage([(x, s, e, stop, first + i > 0 and low[first + i] == low[first + i - 1]) for i, (x, s, e) in enumerate(bag)], raw))
        rows = rows or [np.zeros(quality.WIDTH)]
        h = [np.tanh(np.clip((r - model.mean) / model.spread, -6, 6) @ w["E"] + w["e"]) for r in rows]
        gate = [np.exp((np.tanh(x @ w["V"] + w["v"]) / (1 + np.exp(-(x @ w["U"] + w["u"])))) @ w["a"]) for x in h]
        z = sum(g * x for g, x in zip(gate, h)) / sum(gate)
        want.append(1 / (1 + np.exp(-(z @ w["s"] + w["b"][0]))))
    got = model.score(*quality.encode(pa.array(texts)))
    assert np.allclose(got, want, atol=2e-5)


def test_the_query(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["good", "calm", "words"] * 9) if i % 3 else "!!! $$$ " * 30, "x", i) for i in range(120)] + [(None, None, "x", 0), (500, "calm words " * 200_000, "x", 0)]
    rng.shuffle(rows)
    spark.createDataFrame([(None if r[0] is None else int(r[0]), r[1], r[2], int(r[3])) for r in rows], "doc_id long, text string, _score string, quality int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = quality.op9_quality(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = out.collect()
    assert len(got) == 122 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["predicted"] == int(bool(r["doc_id"] % 3)) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 120)
