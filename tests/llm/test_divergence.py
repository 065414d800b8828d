import random
import re
from collections import Counter, defaultdict

from millrace.llm import divergence

LEAST = 3


def brute(rows, least=LEAST):
    """The whole audit, from dense counts of every source and term."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        held = Counter(t for r in mine for t in set(r[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        n = defaultdict(Counter)
        for _, source, words in mine:
            n[source].update(w for w in words if held[w] >= least)
        whole = sum(n.values(), Counter())

        def weights(c, kept=kept):
            return {t: 1 + (10**9 * (c[t] + 2)) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: weights(c) for s, c in n.items()}, weights(whole)
        for s in n:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in n if o != s))
            term = sorted(((-f(p[s][t], q[t]), t.encode(), t) for t in kept if n[s][t] and p[s][t] > q[t]))
            out += [(lang, s, "pair", item, -v, k) for k, (v, _, item) in enumerate(pair, 1)]
            out += [(lang, s, "term", item, -v, k) for k, (v, _, item) in enumerate(term[:10], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "the", "été", "É", "É", "漢字", "x1y", "a_b", "ÀB", "Zz"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3))) for _ in range(30)]
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None, "hot", "hot", "hot"])
        rows.append((rng.choice([" ", "\n", "-"]).join(rng.choice(words) for _ in range(rng.randint(0, 30))), lang, source))
    return rows + [(None, "en", "only null"), ("", "xx", "alone"), ("once", "yy", "p"), ("twice", "yy", "q"), ("same words", "zz", "k"), ("same words", "zz", "l")] * 2 + [("same words", "zz", "m")]


def test_equals_brute_force(spark, monkeypatch):
    for seed, held in ((1, 400_000), (2, 20)):
        monkeypatch.setattr(divergence, "HELD", held)
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, source string, n int, term string").repartition(5)
        assert sorted(map(tuple, divergence.audit(docs, LEAST).collect())) == brute(rows)


def test_implied_cells_fill_the_vocabulary(spark):
    docs = spark.createDataFrame(corpus(3), "text string, lang string, source string")
    kept = divergence.counts(docs, LEAST)
    groups = divergence.sources(docs, kept)
    kinds = {r["lang"]: r["kinds"] for r in groups.collect()}
    seen = defaultdict(int)
    for r in divergence.histograms(kept, groups).collect():
        assert r["terms"] > 0 and r["x"] >= 0 and r["y"] >= 0
        seen[r["lang"], r["a"], r["b"]] += r["terms"]
    assert seen and all(n == kinds[lang] for (lang, _, _), n in seen.items())


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(5 * 10**15 + 7, 9 * 10**15, 1000), (0, 10, 3), (3, 5, 0)]
    df = spark.createDataFrame(rows, "n long, total long, kinds long")
    got = [r[0] for r in df.select(divergence.weight(F.col("n"), F.col("total"), F.col("kinds"))).collect()]
    assert got == [1 + (10**9 * (n + 2)) // (t + 2 * k) if k else None for n, t, k in rows]


def test_the_query(spark, tmp_path):
    rows = [("word " * 300_000 + "x", "en", "a", 1), ("word other " * 20, "en", "b", 1)] * 10
    spark.createDataFrame(rows, "text string, lang string, source string, total int").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, divergence.op11_source_divergence(spark, str(tmp_path)).collect())) == brute([r[:3] for r in rows], 10)
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
