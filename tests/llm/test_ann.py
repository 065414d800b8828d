import numpy as np
import pytest

from millrace.llm import ann


def frame(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute(vectors, query, k):
    score = vectors.astype(np.float32).astype(np.float64) @ vectors[query].astype(np.float32).astype(np.float64)
    order = [i for i in np.lexsort((np.arange(len(vectors)), -score)) if i != query]
    return order[:k]


@pytest.mark.parametrize("kind", ["sphere", "lengths", "clusters"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 1500)
    monkeypatch.setattr(ann, "QUERIES", 60)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((4000, 64))
    if kind == "clusters":
        v = v * 0.3 + rng.standard_normal((40, 64))[rng.integers(0, 40, 4000)]
    if kind != "lengths":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(frame(spark, v)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 4000, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(a[2] >= b[2] for a, b in zip(found, found[1:]))
        hit += len({i for _, i, _ in found} & set(brute(v, q, 20)))
    assert hit / (20 * len(got)) >= 0.9


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    v = list(rng.standard_normal((45, 8)))
    v[0] = None
    v[1] = np.zeros(8)
    v[2] = [None] + [1.0] * 7
    v[3] = [float("nan")] * 8
    v[4] = [float("inf")] * 8
    v[5] = [1.0] * 3
    v[21] = v[22]
    rows = ann.nearest(frame(spark, v)).collect()
    assert {r["query_id"] for r in rows} == {20, 40}
    found = {r["vec_id"] for r in rows}
    assert not found & {0, 1, 2, 3, 4, 5}
    ties = [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 20 and r["vec_id"] in (21, 22)]
    assert ties in ([], [21], [21, 22])
    assert ann.nearest(frame(spark, [])).count() == 0
    assert ann.nearest(frame(spark, [None, None])).count() == 0
    few = ann.nearest(frame(spark, list(rng.standard_normal((3, 4))), [20, 20, 7])).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(20, 7)]


def test_each_length_is_searched_on_its_own(spark):
    rng = np.random.default_rng(5)
    v = [*rng.standard_normal((60, 8)), *rng.standard_normal((1, 9)), *rng.standard_normal((30, 4))]
    ids = [*range(60), 100, *range(200, 230)]
    even = [tuple(r) for r in ann.nearest(frame(spark, v[:60])).collect()]
    got = [tuple(r) for r in ann.nearest(frame(spark, [*v, np.ones(3)], [*ids, 40])).collect()]
    assert len(even) == 60 and sorted(r for r in got if r[0] < 100) == sorted(even)
    small = {q: [i for r, i in sorted((r, i) for x, r, i, _ in got if x == q)] for q in (200, 220)}
    assert all(small[200 + q] == [200 + i for i in brute(np.array(v[61:]), q, 20)] for q in (0, 20))
    assert not any(100 in r[:3:2] for r in got)


@pytest.mark.parametrize("dimension", [16, 64, 256, 768])
@pytest.mark.parametrize("kind", ["sphere", "lengths", "clusters"])
def test_recall_at_any_dimension(dimension, kind):
    """Three blocks searched one by one, as the tasks do."""
    rng = np.random.default_rng(11)
    n = 6000
    v = rng.standard_normal((n, dimension))
    if kind == "clusters":
        v = v * 0.3 + rng.standard_normal((30, dimension))[rng.integers(0, 30, n)]
    if kind == "lengths":
        v *= rng.lognormal(0, 0.5, (n, 1))
    else:
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, asked = np.arange(n), np.arange(0, n, 200)
    found = [ann.search(v[ids % 3 == b], ids[ids % 3 == b], v[asked], asked, 20) for b in range(3)]
    query, row, score = (np.concatenate(x) for x in zip(*found))
    hit = 0
    for q in asked:
        mine = np.flatnonzero(query == q)
        mine = mine[np.lexsort((row[mine], -score[mine]))][:20]
        plain = v @ v[q]
        plain[q] = -np.inf
        hit += len(set(row[mine].tolist()) & set(np.lexsort((ids, -plain))[:20].tolist()))
        assert np.allclose(score[mine], plain[row[mine]], rtol=1e-12)
    assert hit / (20 * len(asked)) >= 0.9


def test_components_of_any_size(spark):
    rng = np.random.default_rng(12)
    v = rng.standard_normal((50, 6))
    for scale in (1e-170, 1e-310, 1e200, 3e307):
        rows = [(i, [float(x) for x in np.clip(row * scale, -1.7e308, 1.7e308)]) for i, row in enumerate(v)]
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert len(got) == 3 * 20 and {r["query_id"] for r in got} == {0, 20, 40}


def test_repeated_ids(spark):
    rng = np.random.default_rng(13)
    v = rng.standard_normal((40, 5)).round(3)
    rows = [(20, v[0].tolist()), (20, v[1].tolist()), *((7, v[2].tolist()) for _ in range(30)), (9, v[3].tolist())]
    first = None  # the largest of an id's vectors asks, whatever the order
    for seed in range(3):
        np.random.default_rng(seed).shuffle(rows)
        docs = spark.createDataFrame([(int(i), [float(x) for x in e]) for i, e in rows], "vec_id long, embedding array<double>").repartition(seed + 1)
        got = sorted(tuple(r) for r in ann.nearest(docs).collect())
        assert first in (None, got) and len(got) == 20 and not any(r[2] == 20 for r in got)
        first = got


def test_the_query(spark, tmp_path):
    rng = np.random.default_rng(14)
    v = rng.standard_normal((60, 4))
    rows = [(i, [float(x) for x in e], "x", 1) for i, e in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, _size string, query_id int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = ann.op1_ann_collisions(spark, str(tmp_path))
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out.collect()}
    for q in (0, 20, 40):
        score = v @ v[q]
        best = [int(i) for i in np.lexsort((np.arange(60), -score)) if i != q][:20]
        assert [got[q, k + 1][0] for k in range(20)] == best and np.allclose([got[q, k + 1][1] for k in range(20)], score[best], rtol=1e-13)
