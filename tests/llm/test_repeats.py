import hashlib
import random

import numpy as np
import pytest

from millrace.llm import common, passages, repeats, substrings


def corpus(seed):
    """Texts with copies, near copies, shared lines, runs of one character and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    line = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(line))
        texts.append(rng.choice(["\n", " ", "  "]).join(parts))
    for _ in range(25):
        words = rng.choice(texts).split(" ")
        if words:
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [texts[3]] * 6 + ["a" * 400, "a" * 150, "ab " * 200, "", None, "short", "x y " * 60]
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute_bytes(rows, length):
    rows = sorted(rows, key=lambda r: r[0])
    seen, out = set(), {}
    for doc, text in rows:
        text = (text or "").encode()
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edge = np.diff(np.concatenate(([0], gone[:-1], [0])).astype(int))
        rest = bytes(b for b, g in zip(text, gone, strict=False) if not g)
        out[doc] = (len(text), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(rest).hexdigest())
    return out


def brute_words(rows, length):
    from collections import Counter

    words = {doc: (text or "").encode().split() for doc, text in rows}
    n = Counter(tuple(w[i : i + length]) for w in words.values() for i in range(len(w) - length + 1))
    out = {}
    for doc, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if n[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        rest = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(rest).hexdigest())
    return out


def table(spark, rows, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, mark int").repartition(6).write.mode("overwrite").parquet(path)
    return str(tmp_path)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_equal_brute_force(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 3000)
    rows = corpus(seed)
    got = {r[0]: tuple(r)[1:] for r in substrings.op3_suffix_dedup(spark, table(spark, rows, tmp_path)).collect()}
    assert got == brute_bytes(rows, substrings.LENGTH)


@pytest.mark.parametrize("seed", [3, 4])
def test_words_equal_brute_force(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 3000)
    monkeypatch.setattr(passages, "GROUP", 50)
    rows = corpus(seed)
    got = {r[0]: tuple(r)[1:] for r in passages.op7_substring_dedup(spark, table(spark, rows, tmp_path)).collect()}
    assert got == brute_words(rows, passages.LENGTH)


@pytest.mark.parametrize("words", [False, True])
def test_a_passage_before_many_texts(spark, tmp_path, words):
    """One bucket with more contexts than HOT, and a window that most of them share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(36))
    rows = [(i, f"{word()} {passage} {' '.join(word() for _ in range(12))}") for i in range(2500)]
    rows += [(5000 + i, rows[i][1] + " z" * i) for i in range(0, 40, 3)] + [(6000, passage), (6001, None)]
    query, brute, length = (passages.op7_substring_dedup, brute_words, passages.LENGTH) if words else (substrings.op3_suffix_dedup, brute_bytes, substrings.LENGTH)
    got = {r[0]: tuple(r)[1:] for r in query(spark, table(spark, rows, tmp_path)).collect()}
    assert got == brute(rows, length)


def test_odd_tables(spark, tmp_path):
    long = " ".join(str(i) for i in range(40))
    for query, removed in ((substrings.op3_suffix_dedup, len(long)), (passages.op7_substring_dedup, 40)):
        assert query(spark, table(spark, [], tmp_path)).count() == 0
        # Rows that agree are one document; one id with two texts is two documents.
        assert [r["n_removed"] for r in query(spark, table(spark, [(1, long), (1, long)], tmp_path)).collect()] == [0, 0]
        got = query(spark, table(spark, [(1, long), (1, long + " "), (None, None)], tmp_path)).collect()
        assert len(got) == 3 and sum(r["n_removed"] > 0 for r in got) == (1 if query is substrings.op3_suffix_dedup else 2)
        assert max(r["n_removed"] for r in got) == removed
        near = [(1, long + " a b"), (1, long + " a b"), (2, " ".join(str(i) for i in range(20, 40)) + " c " * 30)]
        assert [r["n_removed"] for r in query(spark, table(spark, near, tmp_path)).collect()] == [0, 0, 0]


def test_cover_reaches_every_difference():
    for r in (0, 1, 2, 3):
        period, residues = substrings.cover(r)
        assert len(residues) == 6 * r + 4 and (substrings.shifts(period, residues) >= 0).all()


def test_suffix_order_with_long_ties():
    rng = random.Random(9)
    core = bytes(rng.choice(b"ab") for _ in range(150))
    contexts = [core[k : k + 140] for k in range(8)] + [b"a" * 168] * 5 + [bytes(rng.choice(b"ab") for _ in range(130)) for _ in range(40)]
    counts = np.array([len(c) - 99 for c in contexts])
    context, offset, group = substrings.equal_windows(contexts, counts)
    windows = [contexts[c][o : o + 100] for c, o in zip(context, offset, strict=True)]
    assert windows == sorted(windows)
    assert len(set(windows)) == group[-1] + 1
    found = set(zip(context.tolist(), offset.tolist(), strict=True))
    every = [(c, o) for c in range(len(contexts)) for o in range(counts[c])]
    lone = [contexts[c][o : o + 100] for c, o in every if (c, o) not in found]
    assert len(lone) == len(set(lone)) and not set(lone) & set(windows)


def test_subtree_groups_do_not_change_the_nodes():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2, 3000)
    at = np.arange(2900)
    want = {}
    for i in at:
        want.setdefault(tuple(codes[i : i + 12]), []).append(int(i))
    want = sorted(v for v in want.values() if len(v) > 1)
    for limit in (1, 30, 10**6):
        leaf, node, depth = passages.deep_nodes(codes, at, 12, limit)
        got = {}
        for x, k in zip(leaf.tolist(), node.tolist(), strict=True):
            got.setdefault(k, []).append(x)
        assert sorted(sorted(v) for v in got.values()) == want
        for k in got:  # a node's leaves agree in as many words as it is deep, and no further
            d = int(depth[node == k][0])
            assert d >= 12 and (depth[node == k] == d).all() and len({tuple(codes[i : i + d]) for i in got[k]}) == 1
            assert max(got[k]) + d == len(codes) or len({int(codes[i + d]) for i in got[k]}) > 1


def test_nodes_end_with_their_contexts():
    codes = np.array([1, 2, 3, 4, 1, 2, 3, 4, 1, 2, 3, 9])
    leaf, _, depth = passages.deep_nodes(codes, np.array([0, 4, 8]), 3, 100, np.array([4, 8, 12]))
    assert sorted(leaf.tolist()) == [0, 4, 8] and depth.tolist() == [3, 3, 3]
    leaf, _, depth = passages.deep_nodes(codes, np.array([0, 4]), 3, 100, np.array([4, 8]))
    assert sorted(leaf.tolist()) == [0, 4] and depth.tolist() == [4, 4]
    assert [len(x) for x in passages.deep_nodes(codes, np.array([4]), 3, 100)] == [0, 0, 0]


def test_the_queries_columns(spark, tmp_path):
    path = table(spark, [(1, "a"), (None, None)], tmp_path)
    assert substrings.op3_suffix_dedup(spark, path).dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert passages.op7_substring_dedup(spark, path).dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]


def test_texts_of_megabytes(spark, tmp_path):
    rng = random.Random(7)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400_000))
    rows = [(1, long), (2, "x " + long[:300_000]), (3, "e" * 1_000_000), (4, "ab cd " * 100_000)]
    got = {r["doc_id"]: r for r in passages.op7_substring_dedup(spark, table(spark, rows, tmp_path)).collect()}
    words = len(long[:300_000].split())
    assert got[2]["n_words"] == words + 1 and words - 2 <= got[2]["n_removed"] <= words and got[1]["n_removed"] == got[2]["n_removed"]
    assert got[3]["n_removed"] == 0 and got[4]["n_removed"] == 200_000
    got = {r["doc_id"]: r for r in substrings.op3_suffix_dedup(spark, table(spark, rows, tmp_path)).collect()}
    assert [got[k]["n_removed"] for k in (1, 2, 3, 4)] == [0, 300_000, 999_999, 599_994]


def test_span_union():
    doc, a, b = common.merged(np.array([1, 0, 0, 1, 0]), np.array([5, 0, 3, 0, 9]), np.array([9, 4, 6, 5, 12]))
    assert list(zip(doc, a, b, strict=True)) == [(0, 0, 6), (0, 9, 12), (1, 0, 9)]


def test_different_grams_have_different_anchors():
    """Text without repeats asks for no context: no two of its runs are in one bucket, however many they are."""
    data = np.random.default_rng(4).integers(0, 256, 8 << 20, dtype=np.uint8)
    doc, made = repeats.runs(common.byte_values(data), np.array([0, len(data)]), substrings.LENGTH, substrings.GRAM)
    assert len(doc) > 200_000 and len(np.unique(made["anchor"])) == len(doc)
    assert made["anchor"].astype(np.int64).min() >= 0  # a bucket below 0 is none


def test_texts_are_shuffled_once(spark, tmp_path):
    """The join that fetches contexts and the one that gathers spans read one exchange of the texts, with equal results."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    lines = [" ".join(word() for _ in range(40)) for _ in range(30)]
    rows = [(i, " ".join([word(), rng.choice(lines), word(), rng.choice(lines)])) for i in range(60)]
    table(spark, rows, tmp_path)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query, brute, length in ((substrings.op3_suffix_dedup, brute_bytes, substrings.LENGTH), (passages.op7_substring_dedup, brute_words, passages.LENGTH)):
            out = query(spark, str(tmp_path))
            assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute(rows, length)
            ran = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert ran.count("SortMergeJoin") == 2 and ran.count("ReusedExchange") == 1, ran
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
