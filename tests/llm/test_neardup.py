import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import graph, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    sets = [brute_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)), key=lambda p: rows[p][0])
                parent[y] = x
    return sorted((rows[i][0], len(sets[i]), rows[root(i)][0], rows[i][0] == rows[root(i)][0]) for i in range(len(rows)))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    texts = [[word() for _ in range(rng.randint(1, 120))] for _ in range(60)]
    # A chain: each text differs a little from the one before, the ends too much to be linked.
    chain = [word() for _ in range(100)]
    for _ in range(12):
        chain = list(chain)
        for _ in range(3):
            chain[rng.randrange(100)] = word()
        texts.append(chain)
    # Near copies of one text, many of them not near each other.
    base = [word() for _ in range(80)]
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(1, 6)):
            t[rng.randrange(80)] = word()
        texts.append(t)
    out = [" ".join(t) for t in texts]
    out += [out[5]] * 4 + [out[7].upper(), out[8].replace(" ", "\n "), "", " ", None, "one", "One", "one two", "two one"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "words", "crowd"), [(1, 2, neardup.CROWD), (2, 5, neardup.CROWD), (1, 2, 0), (2, 5, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, words, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, class string, n int").repartition(5)
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs, words=words).collect())
    assert got == brute(rows, words)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (None, "q r"), (9, None)], "doc_id long, text string")
    got = neardup.near_duplicates(docs, words=2)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(4, 2, 4, True), (4, 2, 4, True), (None, 1, None, True), (9, 0, 9, True)]))
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_null_ids_are_linked(spark):
    rng = random.Random(3)
    one, two = ([f"{name}{rng.randrange(10**6)}" for _ in range(60)] for name in "xy")
    near = lambda t, k: " ".join([*t[:k], "changed", *t[k + 1 :]])
    rows = [(None, " ".join(one)), (None, near(one, 9)), (None, near(one, 9)), (7, near(one, 40)), (None, " ".join(two)), (None, near(two, 5)), (8, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in neardup.near_duplicates(docs, words=2).collect()]
    want = [(None, 59, 7, False)] * 3 + [(7, 59, 7, True)] + [(None, 59, None, True)] * 2 + [(8, 1, 8, True)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(2)
    for similar in (0.95, 0.85, 0.8):
        odd = []
        for _ in range(60):
            n = 400
            shared = int(n * 2 * similar / (1 + similar))
            common_words = rng.integers(0, 1 << 60, shared)
            texts = [" ".join(map(str, np.concatenate((common_words, rng.integers(0, 1 << 60, n - shared))))) for _ in range(2)]
            codes, first = neardup.shingles(pa.array(texts), 1)
            a, b = neardup.odd_sketches(neardup.samples(codes, first)).view(np.uint64)
            odd.append(int(np.bitwise_count(a ^ b).sum()))
        guess = 1 + neardup.SKETCH / (4 * neardup.FOLDED) * np.log(1 - 2 * np.mean(odd) / neardup.SKETCH)
        assert abs(guess - similar) < 0.03
        assert max(odd) <= neardup.most_odd(80)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(200)]
    parent = {x: x for pair in links for x in pair if pair[0] != pair[1]}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_parities_rule_out_no_link():
    random = np.random.default_rng(5)
    for size in (1, 3, 40, 400, 6000):
        for swapped in (0, 1, size // 20, size // 9, size // 8, size // 3):
            a = np.sort(random.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.sort(np.concatenate((a[swapped:], random.integers(0, 1 << 63, swapped, dtype=np.uint64))))
            both = neardup.parities(np.concatenate((a, b)), np.array([0, size, 2 * size])).view(np.uint64)
            odd = sum(int(x).bit_count() for x in both[0] ^ both[1])
            shared = len(np.intersect1d(a, b))
            assert odd <= 2 * (size - shared)
            if shared * 100 >= (2 * size - shared) * 80:
                assert odd * 180 <= 2 * size * 20
            elif size == 400:
                assert odd * 180 > 2 * size * 20 or shared * 100 > (2 * size - shared) * 78


def test_the_query(spark, tmp_path):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, long), (2, long + " one more"), (3, "e" * 1_000_000), (4, "ab cd " * 100_000), (5, "cd ab cd ab"), (6, None)]
    docs = [(i, t, "x", 0) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, component_id string, _class int").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    out = neardup.op2_minhash_odd_sketch(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(map(tuple, out.collect())) == brute(rows, 2)


def test_a_large_group_makes_pairs_in_proportion(spark, monkeypatch):
    """Near copies of one text, twice as many: the pairs that are confirmed grow in proportion, and all are linked as by brute force."""
    rng = random.Random(13)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    made = []
    written = neardup.common.written

    def counted(df, name):
        out = written(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(neardup.common, "written", counted)
    totals = []
    for n in (400, 800):
        rows = []
        for i in range(n):
            t = list(base)
            for _ in range(rng.randint(1, 9)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(t)))
        made.clear()
        got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=2).collect())
        assert got == brute(rows, 2)
        totals.append(sum(made))
    assert totals[1] < 2.6 * totals[0], totals


def family(rng, n, words, own, pairs):
    """n texts of one template, each with words of its own in the same places; some with a near copy, which differs in one word."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    slots = rng.sample(range(words), own)
    texts = []
    for i in range(n):
        if i % pairs == 1:
            t = list(texts[-1])
            t[rng.choice(slots)] = f"y{rng.randrange(10**6)}"
        else:
            t = list(base)
            for k in slots:
                t[k] = f"x{rng.randrange(10**6)}"
        texts.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def met(found):
    """Rows that prefixes (shingle, b, short) make when joined, before any filter but the labels' sides."""
    rows = found.toPandas()
    return sum(int((g.label != g.usual).sum() * g.short.sum() + (g.label == g.usual).sum() * ((g.label != g.usual) & g.short).sum()) for _, g in rows.groupby("shingle"))


def test_a_family_below_the_threshold_makes_rows_in_proportion(spark, monkeypatch):
    """Texts of one template, alike at about 0.65, twice as many: the rows that meet grow in proportion, components are those of brute force."""
    made, written = [], neardup.common.written

    def counted(df, name):
        out = written(df, name)
        if name == "prefixes" and "usual" in df.columns:
            made.append(met(out))
        elif name == "mixed" and "fine" in df.columns:
            made.append(out.count())
        elif name in ("rare", "pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(neardup.common, "written", counted)
    totals = []
    for n in (400, 800):
        rows = family(random.Random(n), n, 150, 17, 10)
        sets = [brute_set(t, 2) for _, t in rows[2:6]]
        alike = [len(a & b) / len(a | b) for a in sets for b in sets if a is not b]
        assert 0.55 < min(alike) and max(alike) < 0.75
        made.clear()
        got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=2).collect())
        assert got == brute(rows, 2)
        assert len({c for _, _, c, _ in got}) < n
        totals.append(sum(made))
    assert 0 < totals[0] and totals[1] < 2.3 * totals[0] and totals[1] < 100 * 800, totals


def test_prefixes_of_linked_sets_meet(spark):
    """Every pair at the threshold shares a prefix shingle, the smaller's a short one, for sets of any sizes."""
    rng = random.Random(8)
    base = [rng.randrange(1 << 40) for _ in range(60)]
    sets = [sorted(rng.sample(base, rng.randint(1, 60)) + [rng.randrange(1 << 40) for _ in range(rng.randint(0, 6))]) for _ in range(80)]
    sets += [sorted(rng.sample(s, max(1, len(s) - rng.randint(0, 8)))) for s in sets]
    table = spark.createDataFrame([(i, i, len(s), s) for i, s in enumerate(sets)], "b long, label long, n long, set array<long>")
    got = {}
    for r in neardup.prefixes(table, 80).collect():
        got.setdefault(r["b"], set()).add((r["shingle"], r["short"]))
    linked = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(set(x) & set(y))
            if i != j and len(x) >= len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
                linked += 1
                assert {s for s, _ in got.get(i, ())} & {s for s, short in got.get(j, ()) if short}, (i, j)
    assert linked > 50
    pairs = {(r["a"], r["b"]) for r in neardup._rare_pairs(table, table.selectExpr("b", "array_repeat(0L, 16) AS sketch"), 80).collect()}
    want = {(j, i) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))}
    assert want <= pairs


def test_members_outside_meet_hubs_of_their_buckets(spark):
    """Each member outside meets at most MET hubs, the heaviest first, never of its own component; without a crowd there are none."""
    rows = [(k, 10 + (b < 40) * k, b, 0 if b < 100 else b // 2, 0) for k in range(5) for b in range(160) if b < 40 or (b + k) % 2]
    names = "bucket long, size long, b long, label long, usual long"
    pairs = [tuple(r) for r in neardup._hub_pairs(spark.createDataFrame(rows, names)).collect()]
    label = {b: at for _, _, b, at, _ in rows}
    assert len(set(pairs)) == len(pairs) and all(a < b and label[a] != label[b] for a, b in pairs)
    outside = {b for b in label if label[b]}
    assert {b for _, b in pairs} >= outside and len(pairs) <= neardup.MET * len(outside)
    hubs = {a for a, _ in pairs if label[a] == 0}
    assert 0 < len(hubs) <= neardup.HUBS and max(hubs) < 40
    assert neardup._hub_pairs(spark.createDataFrame([], names)).count() == 0


def test_copies_at_the_threshold_are_linked_as_by_brute_force(spark, monkeypatch):
    """Copies each edited in its own places until about half are linked with few others, in crowded buckets."""
    rng, seen, written = random.Random(31), [], neardup.common.written

    def counted(df, name):
        seen.append(name)
        return written(df, name)

    monkeypatch.setattr(neardup.common, "written", counted)
    monkeypatch.setattr(neardup, "CROWD", 8)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        t = list(base)
        for k in rng.sample(range(len(t)), rng.randint(4, 16)):
            t[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=2).collect())
    assert got == brute(rows, 2)
    assert 1 < len({c for _, _, c, _ in got}) < 300 and seen.count("mixed") >= 2


@pytest.mark.parametrize("ranked", [neardup.RANKED, 30, 0])
def test_sets_are_counted_before_their_shingles_are_rows(spark, monkeypatch, ranked):
    """Prefixes take no set apart into a row for each shingle, and meet for all linked pairs however few counts order them."""
    monkeypatch.setattr(neardup, "RANKED", ranked)
    rng = random.Random(17)
    base = rng.sample(range(1 << 40), 200)
    sets = []
    for i in range(300):
        new = rng.randint(0, 30)
        sets.append(sorted(base[new:] + [rng.randrange(1 << 40) for _ in range(new)]))
    table = spark.createDataFrame([(i, i, len(x), x) for i, x in enumerate(sets)], "b long, label long, n long, set array<long>").repartition(2)
    made, written = [], neardup.common.written

    def counted(df, name):
        made.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(neardup.common, "written", counted)
    found = neardup.prefixes(table, 80)
    made.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(made) == 2 and not any("Generate" in plan or "Join" in plan for plan in made), made
    got = {}
    for r in found.collect():
        got.setdefault(r["b"], set()).add((r["shingle"], r["short"]))
    assert sum(map(len, got.values())) <= sum(len(x) - (len(x) * 80 + 99) // 100 + 1 for x in sets)
    linked = 0
    for i, x in enumerate(map(set, sets)):
        for j, y in enumerate(sets):
            both = len(x.intersection(y))
            if i != j and len(x) >= len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
                linked += 1
                assert {s for s, _ in got.get(i, ())} & {s for s, short in got.get(j, ()) if short}, (i, j)
    assert linked > 1000


def shuffles(monkeypatch):
    """Names of what is written from now on, each with the shuffles that its plan asks for."""
    made, written = [], neardup.common.written

    def counted(df, name):
        made.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return written(df, name)

    monkeypatch.setattr(neardup.common, "written", counted)
    return made


def test_components_of_large_groups_take_few_shuffles(spark, monkeypatch):
    """Groups around a few nodes, in several tasks: a shuffle for each step, not rounds of joins over all links."""
    rng = random.Random(5)
    links = [(g * 1000 + rng.randrange(8), g * 1000 + k) for g in range(6) for k in range(8, 400) for _ in range(2)]
    want = {x: x // 1000 for pair in links for x in pair}
    made = shuffles(monkeypatch)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {x: min(y for y in want if want[y] == g) for x, g in want.items()}
    assert sum(n for _, n in made) <= 12, made


def test_long_paths_settle(spark):
    """Paths whose links lie apart: labels go on from step to step, and rounds alone give the same."""
    links = [(p * 1000 + i, p * 1000 + i + 1) for p in range(3) for i in range(150)]
    random.Random(9).shuffle(links)
    table = spark.createDataFrame(links, "a long, b long").repartition(60)
    for found in (graph.components(table), graph._rounds(table)):
        assert {r["node"]: r["label"] for r in found.collect()} == {x: x // 1000 * 1000 for pair in links for x in pair}


def test_a_pair_meets_at_its_first_shared_shingle(spark):
    """Of many shingles that two sets share, one makes a row: none of those before it is shared."""
    rng = random.Random(21)
    base = [rng.randrange(1 << 40) for _ in range(120)]
    sets = [sorted(rng.sample(base, 112)) for _ in range(40)]
    table = spark.createDataFrame([(i, i, len(x), x) for i, x in enumerate(sets)], "b long, label long, n long, set array<long>").repartition(3)
    rows = {}
    for r in neardup.prefixes(table, 80).collect():
        rows.setdefault(r["b"], {})[r["shingle"]] = (r["pos"], set(r["rarer"]))
    shared = 0
    for i in range(40):
        assert max(len(before) for _, before in rows[i].values()) <= neardup.RARER
        for j in range(i):
            both = rows[i].keys() & rows[j].keys()
            shared += len(both)
            first = [s for s in both if not rows[i][s][1] & rows[j][s][1]]
            assert first == sorted(both, key=lambda s: rows[i][s][0])[:1]
    assert shared > 3 * 780


def test_hot_corpora_take_few_shuffles(spark, monkeypatch):
    """Large groups of near copies, in crowded buckets: plans ask for few shuffles, and the result is that of brute force."""
    monkeypatch.setattr(neardup, "CROWD", 8)
    rng = random.Random(31)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(200):
        t = list(base)
        for k in rng.sample(range(len(t)), rng.randint(4, 16)):
            t[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    made = shuffles(monkeypatch)
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=2).collect())
    assert got == brute(rows, 2)
    assert sum(n for _, n in made) <= 40, made
