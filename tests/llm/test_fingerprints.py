import hashlib
import math
import random
from collections import Counter

import numpy as np

from millrace.llm import fingerprints as fp


def test_entropies_equal_definition():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcdefgh  e") for _ in range(700)) + b"z" * 100
    got = fp.entropies(np.frombuffer(data, np.uint8))
    for i in range(0, len(data) - fp.WINDOW + 1, 7):
        n = Counter(data[i : i + fp.WINDOW]).values()
        assert abs(got[i] + sum(c / 64 * math.log2(c / 64) for c in n)) < 1e-3


def prose(seed, n=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n)).encode()


def test_a_digest_does_not_depend_on_its_neighbours():
    texts = [prose(1), b"", b"short", prose(2, 9), b"x" * 64, prose(1), prose(3, 3000)]
    every = fp.digests(texts)
    for text, filters in zip(texts, every):
        assert np.array_equal(fp.digests([text])[0], filters)
    assert np.array_equal(every[0], every[5])
    assert len(every[1]) == 0 and len(every[2]) == 1 and len(every[6]) > 1


def test_likeness_ranks_edits():
    a, b = prose(1, 2000), prose(2, 2000)
    half, tenth = a[: len(a) // 2] + b[: len(a) // 2], a[: len(a) * 9 // 10] + b[: len(a) // 10]
    d = fp.digests([a, tenth, half, b])
    near = [fp.likeness(d[0], x) for x in d]
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3] and near[3] < 0.05
    assert fp.likeness(d[0], d[0][:0]) == 0.0 and fp.likeness(d[0][:0], d[0][:0]) == 1.0
    assert np.array_equal(fp.read(fp.told(d[0])), d[0])


def test_next_documents(spark):
    texts = {i: (None if i == 5 else "" if i == 9 else prose(i, 5 + i % 50).decode() + "é" * (i % 3)) for i in range(0, 400, 3)}
    rows = [(i, t, "x") for i, t in texts.items()]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = {r["doc_id"]: r for r in fp.against_edits(docs).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == fp.told(fp.digests([text.encode()])[0])
        assert got[i]["edited_fingerprint"] == fp.told(fp.digests([edited.encode()])[0])
    assert fp.against_edits(docs.limit(0)).count() == 0
    one = fp.against_edits(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"aba").hexdigest()
    twice = fp.against_edits(spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "q")], "doc_id long, text string"))
    assert twice.count() == 3


def plain_features(text):
    """The features of one text by their definition: every window, every group of windows, one by one."""
    n, w = len(text), fp.WINDOW
    if n < w:
        return [text] if text else []
    nlogn = lambda c: round(c * math.log2(max(c, 1)) * 65536)
    keys = []
    for i in range(n - w + 1):
        entropy = math.log2(w) - sum(nlogn(c) for c in Counter(text[i : i + w]).values()) / (w * 65536)
        keys.append((1023 if entropy < fp.LEAST else int(min(1000, max(0, 1000 - abs(entropy - fp.COMMON) * 250))), i))
    votes = Counter(min(keys[g : g + fp.SPREAD])[1] for g in range(max(1, len(keys) - fp.SPREAD + 1)))
    chosen = [i for i in sorted(votes) if votes[i] >= fp.VOTES] or [min(keys[: fp.SPREAD])[1]]
    return list(dict.fromkeys(text[i : i + w] for i in chosen))


def plain_chain(text):
    from millrace.llm import common

    chain, found = [], plain_features(text)
    for at in range(0, len(found), fp.LOAD):
        bits = np.zeros(fp.BITS, np.uint8)
        for f in found[at : at + fp.LOAD]:
            code = int(common.Rolling(common.byte_values(np.frombuffer(f, np.uint8))).slices(np.array([0]), np.array([len(f)]))[0])
            for probe in range(fp.PROBES):
                bits[(code >> (11 * probe)) % fp.BITS] = 1
        chain.append(np.packbits(bits))
    return chain


def plain_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    if len(a) == len(b) and all((x == y).all() for x, y in zip(a, b)):
        return 1.0
    a, b = (b, a) if len(a) > len(b) else (a, b)
    ones = lambda x: int(np.unpackbits(x).sum())
    best = []
    for x in a:
        shares = []
        for y in b:
            chance, most = ones(x) * ones(y) / fp.BITS, min(ones(x), ones(y))
            shares.append(min(1.0, max(0.0, (ones(x & y) - chance) / max(most - chance, 1e-9))))
        best.append(max(shares))
    return sum(best) / len(best)


def test_the_query_equals_brute_force(spark, tmp_path):
    texts = [prose(k, 20 + 12 * k).decode() for k in range(24)] + ["", None, "short é", "a" * 200, prose(3, 56).decode(), prose(1, 900).decode() + " " + "é漢" * 60]
    rows = [(2 * i + 1, t, "x", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, _range string, edited int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = fp.op6_fingerprints(spark, str(tmp_path))
    text, long, real = "string", "bigint", "double"
    assert out.dtypes == [("doc_id", long), ("n_chars", long), ("edited_sha256", text), ("fingerprint", text), ("edited_fingerprint", text), ("near_edited", real), ("near_next", real)]
    got = {r["doc_id"]: r for r in out.collect()}
    chains = [plain_chain((t or "").encode()) for t in texts]
    told = lambda chain: fp.told(np.array(chain, np.uint8).reshape(-1, fp.BITS // 8))
    assert len(got) == len(texts)
    for k, (doc_id, t, *_) in enumerate(rows):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = plain_chain((t[: len(t) - half] + after[:half]).encode())
        r = got[doc_id]
        assert r["fingerprint"] == told(chains[k]) and r["edited_fingerprint"] == told(edited)
        assert abs(r["near_edited"] - plain_likeness(chains[k], edited)) < 1e-9
        assert abs(r["near_next"] - plain_likeness(chains[k], chains[(k + 1) % len(texts)])) < 1e-9


def test_one_id_in_most_rows(spark):
    """Rows of one id, and of none, are spread over ranges by their texts, and still follow one another."""
    rows = [(7, prose(k, 4).decode()) for k in range(300)] + [(None, prose(500 + k, 4).decode()) for k in range(200)] + [(k, prose(900 + k, 4).decode()) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    placed = fp.with_next(docs).where("_tail = 0").groupBy("_range").count().collect()
    assert max(r["count"] for r in placed) < 170 and len(placed) >= 6
    ordered = [tuple(r) for r in fp.with_next(docs).where("_tail = 0").orderBy("_range", "_key", "_mark").select("doc_id", "text").collect()]
    assert sorted(map(str, ordered)) == sorted(map(str, rows)) and [x[0] or -1 for x in ordered] == sorted(x[0] or -1 for x in ordered)
    got = sorted((str(r["doc_id"]), r["edited_sha256"]) for r in fp.against_edits(docs).collect())
    want = []
    for k, (i, t) in enumerate(ordered):
        half = len(t) // 2
        want.append((str(i), hashlib.sha256((t[: len(t) - half] + ordered[(k + 1) % len(ordered)][1][:half]).encode()).hexdigest()))
    assert got == sorted(want)
