import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toks(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), "\0end"]


def corpus():
    rng = random.Random(8)
    common_words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        n = rng.randint(0, 80)
        rows.append((i, " ".join(rng.choice(common_words) if rng.random() < 0.7 else f"Rare{rng.randint(0, 4000)}é" for _ in range(n))))
    return [*rows, (400, None), (401, ""), (3, rows[3][1]), (None, "w1 w2 alone")]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(lm, "FLUSH", 3000)
    monkeypatch.setattr(lm, "HEAVY", 50)


def test_base_score_equals_definition(spark, small):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = lm.scores(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = toks(t)
        want.append((str(i), held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_model_prefers_what_it_has_learnt(spark):
    rng = random.Random(9)
    line = [f"a{i}" for i in range(60)]
    rows = [(i, " ".join(line[k : k + 30])) for i, k in ((i, rng.randrange(30)) for i in range(200))]
    shuffled = list(line[:30])
    rng.shuffle(shuffled)
    rows += [(1000 + i, " ".join(shuffled)) for i in range(1) if zlib.crc32(str(1000 + i).encode()) % 7 == 2]
    rows += [(i, t) for i, t in ((i, " ".join(shuffled)) for i in range(2000, 2030)) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    known = [r["score"] / r["n_tokens"] for r in got if r["held_out"] and r["doc_id"] < 1000]
    odd = [r["score"] / r["n_tokens"] for r in got if r["held_out"] and r["doc_id"] >= 1000]
    assert known and odd and np.mean(known) > np.mean(odd) + 0.3
    better = [r["score"] > r["base_score"] for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert all(better)


def test_filter_gives_the_levels_back():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    n = np.minimum(rng.zipf(1.6, len(codes)), 1 << 30)
    parts = 3
    part = lm._part(codes, parts)
    empty = np.zeros(0, np.uint64)
    made = [(p, *reversed(lm.segment(codes[part == p], n[part == p], empty, empty.astype(np.int64)))) for p in range(parts)]
    found = lm.Filter([(p, probes, bits.tobytes()) for p, probes, bits in made], parts)
    got = found.levels(codes, False, part)
    want = lm.levels(n, codes)
    assert (got >= want).all() and np.mean(got == want) > 0.97  # levels are never lost
    assert np.mean(found.counts(rng.integers(0, 1 << 63, 20_000).astype(np.uint64), False) > 0) < 0.02
    assert (lm.levels(n) <= want).all() and (want <= lm.levels(n) + 1).all() and lm.levels(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]
    many = rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
    for c in (3, 5, 6, 100):  # the mean is kept
        assert abs(lm.stands_for(lm.levels(np.full(len(many), c), many)).mean() / c - 1) < 0.01


def plain_scores(rows):
    """Scores by their definition, from quantised counts without false hits."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    code = {}

    def coded(words):
        for w in words:
            if w not in code:
                code[w] = lm._END if w == "\0end" else lm.tokens(pa.array([w]))[0][0]
        return [code[w] for w in words]

    follow = lambda h, w: lm.common.mix(np.array([h], np.uint64) * lm._GOLD + np.array([w], np.uint64))[0]
    singles, couples = Counter(), Counter()
    texts = [(i, coded(toks(t))) for i, t in rows]
    for i, t in texts:
        if not held(i):
            singles.update(t)
            couples.update((int(h), int(w)) for h, w in zip([lm._START, *t], t, strict=False))
    about = lambda n, key: float(lm.stands_for(lm.levels(np.array([n]), np.array([key], np.uint64)))[0]) if n else 0.0
    probed = {w: about(n, w) for w, n in singles.items()}
    smooth = sum(probed.values()) + len(probed) + 1

    def chance(h, w):
        alone, seen = (probed.get(w, 0.0) + 1) / smooth, singles[lm._END] if h == lm._START else singles[h]
        if not seen:
            return alone
        with np.errstate(over="ignore"):
            return lm.PAIRS * about(couples[int(h), int(w)], follow(h, w)) / seen + (1 - lm.PAIRS) * alone

    words = [*probed, np.uint64(12345)]
    return [sum(math.log10(chance(h, w)) for h, w in zip([lm._START, *t], t, strict=False)) for _, t in texts], [sum(chance(h, w) for w in words) for h in [lm._START, *list(probed)[:150], np.uint64(99)]]


@pytest.mark.parametrize("heavy", [50, 10_000])
def test_scores_equal_brute_force(spark, heavy):
    rows = corpus()
    want, sums = plain_scores(rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, held_out int, part string").repartition(3)
    got = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in lm.scores(docs, heavy, item_bits=64).collect())  # no false hits
    assert got == sorted((str(i), round(x, 6)) for (i, _), x in zip(rows, want, strict=True))
    # What a model gives to all words and an unknown one: 1, but for the rounding of pairs' counts.
    assert abs(sums[-1] - 1) < 1e-9 and abs(np.mean(sums) - 1) < 0.02 and max(abs(x - 1) for x in sums) < 0.2


def test_the_query(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id int, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    out = lm.op5_lm_scores(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    assert out.count() == 2


def test_filter_grows_with_the_levels():
    codes = np.arange(1, 50_001, dtype=np.uint64)
    bits, probes = lm.segment(codes, np.full(50_000, 4), codes, np.ones(50_000, np.int64))
    assert (len(bits) * 64, probes) == (4 * 50_000 * lm.ITEM_BITS, 7)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scores(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = lm.scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0)]


def test_pair_blobs_round_trip():
    codes = np.array([5, 1 << 39, 77], np.uint64)
    counts = np.array([1, 255, 1000])
    got = lm._summed(*lm._unpack_pairs(lm._pack_pairs(codes, counts)))
    assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == {5: 1, 1 << 39: 255, 77: 1000}
