from millrace.llm import mixing


def brute(totals, weights=(5, 2, 1), share=1.5, most=2):
    """Share by weight; stop at the cap; share the rest again, until none is above."""
    names = sorted((s for s in totals if s is not None)) + [s for s in totals if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    rest, open_, out = share * sum(totals.values()), set(names), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * totals[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = float(most * totals[s])
            rest -= out[s]
        open_ -= over
    return out


def test_targets_equal_resharing(spark):
    for sizes in ([10, 100, 5, 0, 1000, 3], [7], [0, 0], [1, 10_000, 1, 1], [5, 5, 5, 5, 5, 5, 5]):
        totals = {(f"s{k}" if k else None): n for k, n in enumerate(sizes)}
        df = spark.createDataFrame(list(totals.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = brute(totals)
        assert got.keys() == want.keys()
        for s in want:
            assert abs(got[s] - want[s]) < 1e-6, (sizes, s)


def test_rows(spark):
    rows = [(i, "w " * (i % 40), "a" if i % 3 else "b", "z") for i in range(3000)]
    rows += [(5000, None, None, "z"), (5001, "", None, "z"), (None, "x y", "a", "z"), (1, "w ", "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    planned = mixing.plan(docs).collect()
    assert len(planned) == len(rows)
    by = {}
    for r in planned:
        assert r["_copies"] * r["_size"] <= 2 * r["_size"]
        goal, taken = by.get(r["source"], (0, 0))
        by[r["source"]] = (r["_target"], taken + r["_copies"] * r["_size"])
    for goal, taken in by.values():
        assert abs(goal - taken) <= 0.1 * goal + 1
    assert sorted(r["_copies"] for r in mixing.plan(docs.repartition(7)).collect()) == sorted(r["_copies"] for r in planned)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["_copies"] for r in planned)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_the_query(spark, tmp_path):
    rows = [(1, "a b c", "x", "k"), (1, "a b c", "x", "k"), (2, None, None, "k"), (3, "d" * 3_000_000 + " e", "y", "k")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, _source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = mixing.op10_mix_sources(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = sorted((r["doc_id"], r["_size"], r["_source_size"], r["_target"], r["_copies"] * r["_size"]) for r in mixing.plan(docs).collect())
    assert sorted(map(tuple, out.collect())) == want
    assert [r["_source"] for r in mixing.plan(docs).collect()] == ["k"] * 4
